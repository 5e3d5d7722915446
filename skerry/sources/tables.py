"""Sources and sinks: sharded scans with global row numbers, resumable conversion, frozen subsets, guarded results."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skerry.operators import sampling
from skerry.session import remove_folder


def with_offsets(rows: DataFrame, shard_col: str, order_col: str, name: str = "gidx") -> DataFrame:
    """Rows with a global index: shards in order, rows by `order_col` within; shard counts are few beside the rows."""
    counts = rows.groupBy(shard_col).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy(shard_col).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(shard_col, before.alias("__start"))
    within = F.row_number().over(Window.partitionBy(shard_col).orderBy(order_col)) - 1
    return rows.withColumn("__k", within).join(starts, shard_col).withColumn(name, F.col("__start") + F.col("__k")).drop("__k", "__start")


def convert_missing(source: DataFrame, path: str, shard_col: str, transform: Callable[[DataFrame], DataFrame], force: bool = False) -> DataFrame:
    """Writes the transformed shards that `path` doesn't hold yet, one folder a shard, and reads all of them.

    Done shards are known by their folders, so a broken run resumes; Spark's commit keeps half a shard out. With
    `force` the shards of `source` are written anew and all others stay.
    """
    spark = source.sparkSession
    todo = source
    if not force and exists(spark, path):
        todo = source.join(spark.read.parquet(path).select(shard_col).distinct(), shard_col, "left_anti")
    if force:
        put_sections(transform(todo), path, shard_col)
    else:
        transform(todo).write.partitionBy(shard_col).mode("append").parquet(path)
    return spark.read.parquet(path)


def put_sections(rows: DataFrame, path: str, section_col: str) -> None:
    """Writes the sections that rows hold, each in place of its own earlier rows; other sections stay."""
    rows.write.partitionBy(section_col).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def fingerprint(*inputs: DataFrame) -> str:
    """Hash of the rows of all inputs, whatever their order; it changes with any value, column name or type."""
    seen = []
    for df in inputs:
        row = F.xxhash64(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"}))
        seen.append((df.schema.simpleString(), *df.agg(F.count("*"), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)), F.coalesce(F.bit_xor(row), F.lit(0))).first()))
    return hashlib.md5(repr(seen).encode()).hexdigest()


def stored(spark: SparkSession, path: str, build: Callable[[], DataFrame], inputs: list[DataFrame], **key) -> DataFrame:
    """The table stored under its key (such as n and seed), built anew where it isn't there or its inputs have changed.

    A table counts as stored once its write is committed, so a broken one is never read; the one of earlier inputs goes
    only after that.
    """
    base = "/".join([path, *(f"{k}={key[k]}" for k in sorted(key))])
    folder = f"{base}/inputs={fingerprint(*inputs)}"
    if not exists(spark, folder):
        build().write.mode("overwrite").parquet(folder)
        for other in folders(spark, base):
            if other != folder.rsplit("/", 1)[1]:
                remove_folder(spark, f"{base}/{other}")
    return spark.read.parquet(folder)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder, on any file system that Spark reads."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return [s.getPath().getName() for s in place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(place) if s.isDirectory()]


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds a finished write, on any file system that Spark reads."""
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


def frozen_subset(rows: DataFrame, path: str, id_col: str, size: int, valid: Column, seed: int) -> DataFrame:
    """The same seeded sample of valid rows each time: its ids are written once and joined ever after."""
    spark = rows.sparkSession
    if not exists(spark, path):
        sampling.uniform(rows.where(valid), id_col, size, seed).select(id_col).write.parquet(path)
    return rows.join(spark.read.parquet(path), id_col, "left_semi")


def save_arm(result: DataFrame, path: str, **config) -> None:
    """Writes a result under a folder named by its whole configuration; an existing one is never mixed with another."""
    folder = "/".join([path, *(f"{k}={config[k]}" for k in sorted(config))])
    result.write.mode("errorifexists").parquet(folder)
