import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry.operators import pair_order, variogram


def frame(spark, n=90, seed=4):
    rng = np.random.default_rng(seed)
    z = rng.integers(0, 3, size=(n, 4)).astype(float)  # with copies: distances of zero and many ties
    cat, y = np.arange(n) % 2, rng.normal(size=n)
    return z, cat, y, spark.createDataFrame([(i, [float(v) for v in z[i]], int(cat[i]), float(y[i])) for i in range(n)], "vec_id long, embedding array<double>, label int, y double").repartition(3)


@pytest.mark.parametrize("whole", [True, False])
def test_quantiles_and_curves_without_writing_pairs(spark, monkeypatch, whole):
    monkeypatch.setattr(pair_order, "TILE", 20)
    z, cat, y, df = frame(spark)
    i, j = np.nonzero((cat[:, None] == cat[None, :]) & (np.arange(90)[:, None] < np.arange(90)[None, :]))
    d, dy, g = np.sqrt(((z[i] - z[j]) ** 2).sum(1)), y[i] - y[j], np.zeros(len(i), int) if whole else cat[i]
    every = pair_order.Pairs(df, [(0, 4)], whole=whole)
    found = every.quantiles([0.0, 0.1, 0.5, 1.0])[1]
    for k in np.unique(g):
        assert np.allclose(found[k, 0], np.quantile(d[g == k], [0.0, 0.1, 0.5, 1.0]))
    assert every.histogram().count() < 40 < len(d)  # what leaves the tiles follows the values, not the pairs
    got = {(r.g, r.bin): r for r in variogram.pair_curve(df, 4, whole=whole).collect()}
    for k in np.unique(g):
        edges = np.quantile(d[g == k], [0.25, 0.5, 0.75])
        at = np.searchsorted(edges, d[g == k], "right")
        for b in np.unique(at):
            r = got.pop((k, b))
            assert np.allclose([r.lag, r.gamma, r.n], [np.median(d[g == k][at == b]), 0.5 * np.mean(dy[g == k][at == b] ** 2), (at == b).sum()])
    assert not got


def test_no_pairs(spark):
    df = frame(spark)[3].where("vec_id = 1")
    assert variogram.pair_curve(df, 4).count() == 0 and variogram.pair_curve(df.where(F.lit(False)), 4, "mean", upto=0.9).count() == 0


def ranks(v):
    _, at, n = np.unique(v, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - n + (n + 1) / 2)[at]


@pytest.mark.parametrize("ties", [True, False])
def test_rank_correlation_in_rounds(spark, monkeypatch, ties):
    """Several blocks a tile, parts a round and rounds; no pair's row is shuffled."""
    monkeypatch.setattr(pair_order, "TILE", 20)
    z, cat, y, df = frame(spark)
    if not ties:
        z, cat = np.random.default_rng(1).normal(size=(90, 4)), np.arange(90) % 2
    df = spark.createDataFrame([(i, [float(v) for v in z[i]], int(cat[i]), float(y[i])) for i in range(90)], df.schema).repartition(3)
    i, j = np.nonzero((cat[:, None] == cat[None, :]) & (np.arange(90)[:, None] < np.arange(90)[None, :]))
    d, a = np.sqrt(((z[i] - z[j]) ** 2).sum(1)), np.abs(y[i] - y[j])
    n, rho, loss = pair_order.rank_correlation(df, part=150 if ties else 20, most=400)
    assert n == len(i) and loss < pair_order.LOSS and rho == pytest.approx(np.corrcoef(ranks(d), ranks(a))[0, 1], abs=1e-8)
    assert pair_order.rank_correlation(df.where("vec_id = 1")) == (0, None, 0.0)
    assert pair_order.rank_correlation(df.where("vec_id < 3 AND label = 0"))[:2] == (1, None)
