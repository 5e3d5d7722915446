"""Session helpers shared by queries, tests and the bench."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(cores: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own."""
    os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("skerry")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package when it runs from a source checkout."""
    env = spark.sparkContext.environment
    env["PYTHONPATH"] = os.pathsep.join(dict.fromkeys(filter(None, [ROOT, *env.get("PYTHONPATH", "").split(os.pathsep)])))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Where it is unset, a local session gets one of its own; a cluster raises an error, since a local folder is another
    one on each machine.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or f"/tmp/checkpoints/{context.applicationId}")
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cuts lineage in the shared folder, so that a lost executor costs a reread only."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, rows: int = 0) -> tuple[DataFrame, str]:
    """df from files of at most `rows` rows (0: any) in the shared folder, and the folder, which the caller removes.

    For loops whose steps join the last one: a checkpoint keeps the plan's estimate of its size, and these estimates
    multiply from step to step until they are slow to compute; files have a size.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", rows).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def collect_garbage(spark: SparkSession) -> None:
    """Asks the driver to collect, upon which Spark removes shuffle files of frames that nobody holds any more."""
    spark._jvm.System.gc()


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever file system holds it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
