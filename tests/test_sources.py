import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from skerry.sources import tables


def test_offsets_run_through_the_shards(spark):
    df = spark.createDataFrame([("b", 5), ("a", 2), ("a", 1), ("c", 0)], "shard string, k long")
    got = {(r.shard, r.k): r.gidx for r in tables.with_offsets(df, "shard", "k").collect()}
    assert got == {("a", 1): 0, ("a", 2): 1, ("b", 5): 2, ("c", 0): 3}


def test_conversion_resumes_and_subsets_stay(spark, tmp_path):
    df = spark.createDataFrame([(s, i) for s in (1, 2) for i in range(5)], "shard int, id long")
    path = str(tmp_path / "out")
    marked = lambda tag: lambda d: d.withColumn("tag", F.lit(tag))
    tables.convert_missing(df.where("shard = 1"), path, "shard", marked("first"))
    got = tables.convert_missing(df, path, "shard", marked("second")).groupBy("shard", "tag").count().collect()
    assert {tuple(r) for r in got} == {(1, "first", 5), (2, "second", 5)}
    rows = spark.range(100)
    one = tables.frozen_subset(rows, str(tmp_path / "ids"), "id", 10, F.col("id") % 2 == 0, 3)
    two = tables.frozen_subset(rows, str(tmp_path / "ids"), "id", 50, F.col("id") > 0, 4)
    assert sorted(r.id for r in one.collect()) == sorted(r.id for r in two.collect()) and one.count() == 10


def test_arms_never_mix(spark, tmp_path):
    tables.save_arm(spark.range(3), str(tmp_path / "arms"), n=3, seed=1)
    with pytest.raises(AnalysisException):
        tables.save_arm(spark.range(4), str(tmp_path / "arms"), n=3, seed=1)
    tables.save_arm(spark.range(4), str(tmp_path / "arms"), n=3, seed=2)
    assert spark.read.parquet(str(tmp_path / "arms")).count() == 7


def test_forced_shards_leave_the_others(spark, tmp_path):
    df = spark.createDataFrame([(s, i) for s in (1, 2, 3) for i in range(4)], "shard int, id long")
    path = str(tmp_path / "forced")
    marked = lambda tag: lambda d: d.withColumn("tag", F.lit(tag))
    tables.convert_missing(df, path, "shard", marked("first"))
    got = tables.convert_missing(df.where("shard = 2"), path, "shard", marked("second"), force=True)
    assert {tuple(r) for r in got.groupBy("shard", "tag").count().collect()} == {(1, "first", 4), (2, "second", 4), (3, "first", 4)}


def test_sections_and_stored_tables(spark, tmp_path):
    path = str(tmp_path / "sections")
    tables.put_sections(spark.createDataFrame([("a", 1), ("b", 2)], "section string, v int"), path, "section")
    tables.put_sections(spark.createDataFrame([("b", 3)], "section string, v int"), path, "section")
    assert sorted((r.section, r.v) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 3)]
    calls, source = [], spark.range(5)

    def run(rows, **key):
        return tables.stored(spark, str(tmp_path / "kept"), lambda: calls.append(1) or rows.selectExpr("id * 2 AS twice"), [rows], **key).count()

    assert [run(source, n=5, seed=1), run(source.repartition(3), n=5, seed=1), run(source, n=5, seed=2)] == [5, 5, 5] and len(calls) == 2
    assert run(spark.range(6), n=5, seed=1) == 6 and len(calls) == 3  # a changed input builds anew, and the old table goes
    base = tmp_path / "kept" / "n=5" / "seed=1"
    assert len(list(base.iterdir())) == 1
    (next(base.iterdir()) / "_SUCCESS").unlink()  # a write that broke off
    assert run(spark.range(6), n=5, seed=1) == 6 and len(calls) == 4
    assert tables.fingerprint(source) != tables.fingerprint(source.withColumnRenamed("id", "x")) and tables.fingerprint(source) == tables.fingerprint(source.repartition(2))
