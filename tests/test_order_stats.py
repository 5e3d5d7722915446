import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry.operators import order_stats as o


def table(spark, rows):
    return spark.createDataFrame(rows, "cat string, x double, row int, value string, c int")


def data():
    rng = random.Random(1)
    rows = [(rng.choice("aab") if k % 7 else None, rng.choice([None, float("nan"), 0.0, -0.0, rng.gauss(0, 1), float(rng.randint(-3, 3)), 1e300]), k, "v", 1) for k in range(900)]
    return rows + [("one", 2.5, 0, "v", 1), ("none", None, 0, "v", 1)]


@pytest.mark.parametrize("block", [3, 1024])
def test_quantiles_equal_numpy(spark, monkeypatch, block):
    monkeypatch.setattr(o, "BLOCK", block)
    rows, points = data(), [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {r.cat: (r.q, r.n) for r in o.quantiles(table(spark, rows), ["cat"], "x", points).collect()}
    want = {}
    for c, x, *_ in rows:
        if x is not None and x == x:
            want.setdefault(c, []).append(x)
    assert set(got) == set(want)
    for c, xs in want.items():
        assert got[c][1] == len(xs) and np.allclose(got[c][0], np.quantile(xs, points))
    every = [x for xs in want.values() for x in xs]
    assert np.allclose(o.quantiles(table(spark, rows), [], "x", points).first().q, np.quantile(every, points))


def test_ranks_and_empty_tables(spark):
    rows = data()
    got = {r.row: r.rank for r in o.average_ranks(table(spark, rows), ["cat"], "x", "rank").where("cat = 'a'").collect()}
    xs = {k: x for c, x, k, *_ in rows if c == "a" and x is not None and x == x}
    assert got == {k: sum(y < x for y in xs.values()) + (sum(y == x for y in xs.values()) + 1) / 2 for k, x in xs.items()}
    empty = table(spark, [])
    assert o.quantiles(empty, ["cat"], "x", [0.5]).collect() == [] and o.average_ranks(empty, ["cat"], "x", "r").collect() == []
    assert tuple(o.quantiles(empty, [], "x", [0.5]).first()) == ([None], 0)


def test_joined_quantiles_and_null_groups(spark):
    got = o.with_quantiles(table(spark, data()), ["cat"], "x", [0.5], "m")
    assert got.count() == len(data()) and got.columns == ["cat", "x", "row", "value", "c", "m"]
    assert got.where("cat IS NULL AND m IS NULL").count() == 0 and got.agg(F.max("cat")).first()[0] == "one"


def test_interpolation_on_a_curve(spark):
    from skerry.operators.variogram import interpolated

    curve = spark.createDataFrame([(2.0, 10.0), (1.0, 5.0), (4.0, 0.0), (None, 3.0), (3.0, None), (4.0, -1.0)], "x double, y double")
    targets = spark.createDataFrame([(k, v) for k, v in enumerate([0.0, 1.0, 1.5, 2.0, 3.0, 4.0, 9.0, None])], "k int, t double")
    got = [r.v for r in interpolated(targets, "t", curve, "x", "y", "v").orderBy("k").collect()]
    assert got == [5.0, 5.0, 7.5, 10.0, 5.0, 0.0, 0.0, None]
    assert {r.v for r in interpolated(targets, "t", curve.limit(0), "x", "y", "v").collect()} == {None}


def test_spearman_ranks_distinct_rows(spark, monkeypatch):
    """Repeated rows are counted before they are ranked, and change nothing."""
    from skerry.operators import grouping

    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 9, 40).astype(float), rng.integers(0, 5, 40).astype(float)
    rows = [("k", float(a), float(b)) for a, b in zip(x, y)] + [("k", None, 1.0), ("k", 1.0, float("nan"))]
    df = spark.createDataFrame(rows * 30, "cat string, x double, y double")
    seen = []
    real = o.value_places
    monkeypatch.setattr(o, "value_places", lambda r, *a: seen.append(r.count()) or real(r, *a))
    (got,) = grouping.spearman(df, ["cat"], "x", "y").collect()

    def ranks(v):
        _, at, n = np.unique(v, return_inverse=True, return_counts=True)
        return (np.cumsum(n) - n + (n + 1) / 2)[at]

    # x is ranked among the rows that hold an x, also one without a y
    rx = ranks(np.append(np.repeat(x, 30), [1.0] * 30))[:-30]
    assert got.n == 1200 and max(seen) <= 42 and abs(got.rho - np.corrcoef(rx, ranks(np.repeat(y, 30)))[0, 1]) < 1e-12
