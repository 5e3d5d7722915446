import random

from pyspark.sql import functions as F

from skerry.operators import hot_keys
from skerry.operators.graphs import components


def test_join_gives_the_same_rows_whether_keys_are_hot_or_not(spark):
    rng = random.Random(2)
    rows = [(rng.choice([7] * 20 + list(range(20))), i) for i in range(600)]
    df = spark.createDataFrame(rows, "k int, i int")
    side = df.where("k <> 3").groupBy("k").agg(F.count("*").alias("n"), F.max("i").alias("top"))
    top = {r.k: r.top for r in side.collect()}
    for least in (0, 20, 1000):
        got = hot_keys.hot_join(df, side, ["k"], len(rows), least=least)
        assert sorted((r.k, r.i, r.top) for r in got.collect()) == sorted((k, i, top[k]) for k, i in rows if k in top)


def test_running_totals_of_a_hot_key(spark):
    rows = [("a", i, 1 + i % 5) for i in range(3000) if i % 7] + [("b", 5, 2), ("b", 2047, 3)]
    got = {(r.k, r.o): r.before for r in hot_keys.running_totals(spark.createDataFrame(rows, "k string, o int, n int"), ["k"], "o", "n", block=64).collect()}
    for key in "ab":
        total = 0
        for k, o, n in sorted(r for r in rows if r[0] == key):
            assert got[k, o] == total
            total += n
    none = spark.createDataFrame([(o, 2) for o in range(10)], "o int, n int")
    assert sorted((r.o, r.before) for r in hot_keys.running_totals(none, [], "o", "n", block=3).collect()) == [(o, 2 * o) for o in range(10)]


def test_giant_star_with_broadcast_centres(spark, monkeypatch):
    monkeypatch.setattr(hot_keys.is_hot, "__defaults__", (20, 100_000))
    monkeypatch.setattr(hot_keys.hot_join, "__defaults__", ("n", 20))
    star = [(500, i) for i in range(400)] + [(1000 + i, 1001 + i) for i in range(30)] + [(2000, 399), (1030, 5000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(star, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in (*range(400), 500, 2000)}, **{i: 1000 for i in (*range(1000, 1031), 5000)}}
