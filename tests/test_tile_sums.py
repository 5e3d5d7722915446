"""Sums over the pairs of tiles against plain loops, with copies of vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry.operators import gaussian, pairs


def _rows(spark, n=60):
    z = np.random.default_rng(8).random((n, 3)) + 100
    z[5] = z[9]
    return z, spark.createDataFrame([(k, v.tolist(), k % 2, float(k * k % 11) + 50) for k, v in enumerate(z)], "vec_id long, embedding array<double>, label int, y double")


def test_tile_sums_take_each_pair_once(spark):
    z, rows = _rows(spark)
    whole = lambda x, y, same: [(gaussian.distances(x, y).sum() / (2 if same else 1)), len(x) * (len(x) - 1) / 2 if same else len(x) * len(y)]
    got = pairs.tile_sums(rows, ["d", "n"], whole, tile=16).groupBy("cat").agg(F.sum("d").alias("d"), F.sum("n").alias("n")).collect()
    for r in got:
        d = gaussian.distances(z[r["cat"] :: 2], z[r["cat"] :: 2])
        assert r["n"] == 30 * 29 / 2 and r["d"] == pytest.approx(d.sum() / 2, rel=1e-12)
    f = pairs.pair_correlation(rows, F.col("label"), "y").first()
    i, j = np.triu_indices(60, 1)
    i, j = i[(j - i) % 2 == 0], j[(j - i) % 2 == 0]
    y = np.array([k * k % 11 for k in range(60)], float)
    d, v = np.sqrt(((z[i] - z[j]) ** 2).sum(1)), 0.5 * (y[i] - y[j]) ** 2
    assert f["n"] == len(i) and f["corr"] == pytest.approx(np.corrcoef(d, v)[0, 1], abs=1e-9) and f["gamma"] == pytest.approx(v.mean())


def test_pooled_kernel_is_the_sandwich_product(spark):
    from skerry.operators import screens

    z, rows = _rows(spark)
    kernel = lambda a, b: gaussian.wendland_c2(gaussian.distances(a, b) / 0.6)
    k = kernel(z, z) * (np.arange(60)[:, None] % 2 == np.arange(60)[None, :] % 2)
    pool = np.eye(6)[np.arange(60) % 6]
    got = np.zeros((6, 6))
    for r in screens.pooled_kernel(rows, F.col("vec_id") % 6, kernel).collect():
        got[r["i"], r["j"]] = r["k"]
    assert np.allclose(got, pool.T @ k @ pool)


def test_vocabulary_scores_write_their_counts_once(spark, monkeypatch):
    from skerry.plans import vocab

    kept = []
    monkeypatch.setattr(vocab, "durable", lambda df, own=vocab.durable: kept.append(df.columns) or own(df))
    vocab.vocabulary_scores(spark, "/root/testdata/sf0.001")
    assert kept == [["gidx", "depth", "label", "cnt"], ["row", "col", "val"]]
