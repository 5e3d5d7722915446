import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry.operators import gaussian as gp
from skerry.operators import pairs, regression as reg


def frame(spark, n=120, d=6, seed=0, cats=3):
    rng = np.random.default_rng(seed)
    z = rng.normal(size=(n, d)) @ np.diag(np.linspace(1, 0.2, d))
    y = z[:, 0] * 2 - z[:, 1] + 0.3 * np.sin(3 * z[:, 2]) + 0.1 * rng.normal(size=n) + 4
    cat = np.arange(n) % cats
    rows = [(i, int(c), [float(v) for v in a], float(b), bool(i % 5)) for i, (c, a, b) in enumerate(zip(cat, z, y))]
    return z, y, cat, spark.createDataFrame(rows, "id long, cat int, z array<double>, y double, train boolean").repartition(3)


def test_ridge_matches_least_squares(spark):
    z, y, _, df = frame(spark)
    extra = df.unionByName(df.limit(1).withColumn("y", F.lit(None).cast("double")))
    m = reg.moments(extra, F.col("z"), F.col("y"))
    model = reg.ridge(m, 0.0)
    want, *_ = np.linalg.lstsq(np.column_stack([np.ones(len(z)), z]), y, rcond=None)
    assert np.allclose([model.intercept, *model.weights], want) and m.n == len(y)
    res = y - np.column_stack([np.ones(len(z)), z]) @ want
    assert math.isclose(reg.r2(m, model), 1 - res @ res / ((y - y.mean()) ** 2).sum())
    assert math.isclose(model.sigma2, res @ res / (len(y) - 7))
    h = np.column_stack([np.ones(len(z)), z])
    assert np.allclose(model.predict_variance(z), model.sigma2 * np.einsum("ij,jk,ik->i", h, np.linalg.inv(h.T @ h), h))
    got = {r.id: r.p for r in df.select("id", model.predict(F.col("z")).alias("p")).collect()}
    assert np.allclose([got[i] for i in range(len(y))], h @ want)
    with pytest.raises(ValueError):
        reg.moments(df.limit(0), F.col("z"), F.col("y"))


def nipals(x, y, k):
    x, y, scores = x - x.mean(0), y - y.mean(), []
    for _ in range(k):
        w = x.T @ y
        w /= np.linalg.norm(w)
        t = x @ w
        x = x - np.outer(t, x.T @ t) / (t @ t)
        y = y - t * (y @ t) / (t @ t)
        scores.append(t)
    return np.column_stack(scores)


@pytest.mark.parametrize("scaling", ["standard", "pareto", "center"])
def test_pls_spans_the_scores_of_nipals(spark, scaling):
    z, y, _, df = frame(spark)
    model = reg.pls(reg.moments(df, F.col("z"), F.col("y")), 3, scaling)
    got = {r.id: r.s for r in df.select("id", model.scores(F.col("z")).alias("s")).collect()}
    got = np.array([got[i] for i in range(len(y))])
    std = z.std(0)
    want = nipals((z - z.mean(0)) / {"standard": std, "pareto": np.sqrt(std), "center": 1}[scaling], y, 3)
    for a, b in zip(got.T, want.T):
        assert abs(np.corrcoef(a, b)[0, 1]) > 1 - 1e-9


@pytest.mark.parametrize("scaling", ["standard", "pareto", "center"])
def test_sparse_pls_equals_dense(spark, scaling):
    z, y, _, df = frame(spark, n=60)
    df = df.withColumn("z", F.transform("z", lambda x, k: F.when(k == 2, 7.0).when(F.abs(x) > 0.1, x).otherwise(0.0)))  # sparse, one column constant
    z = np.array([r.z for r in df.orderBy("id").collect()])
    rows = df.select(F.col("id").alias("row"), "y")
    long = df.select(F.col("id").alias("row"), F.posexplode("z").alias("col", "val")).where("val <> 0")
    got = reg.sparse_pls(long, rows, 3, scaling)
    dense = reg.pls(reg.moments(df, F.col("z"), F.col("y")), 3, scaling)
    assert got.columns == list(range(z.shape[1])) and np.allclose(got.weights, dense.weights) and np.allclose(got.mean, z.mean(0))
    want = {r.id: r.s for r in df.select("id", dense.scores(F.col("z")).alias("s")).collect()}
    more = long.unionByName(long.sparkSession.createDataFrame([(0, 99, 5.0)], "row long, col int, val double"))  # a column never seen
    every = rows.select("row").unionAll(rows.sparkSession.createDataFrame([(-1,)], "row long"))
    scores = {(r.row, r.component): r.score for r in got.scores(more, every).collect()}
    assert all(np.isclose(scores[i, k], v) for i, s in want.items() for k, v in enumerate(s))
    assert np.allclose([scores[-1, k] for k in range(3)], -(z.mean(0) / dense.width) @ dense.weights)  # a row of zeros


def test_pca_and_canonical_correlations(spark):
    z, y, _, df = frame(spark)
    m = reg.moments(df, F.col("z"), F.col("y"))
    p = reg.pca(m, 2, whiten=True)
    s = (z - z.mean(0)) @ p.weights
    assert np.allclose(np.cov(s.T, bias=True), np.eye(2))
    a, b = (np.linalg.qr(x - x.mean(0))[0] for x in (z[:, :2], z[:, 2:]))
    assert np.allclose(reg.canonical_correlations(m, 2), np.linalg.svd(a.T @ b, compute_uv=False))


CH = [(0, 3, 0.7, 2.0), (3, 6, 0.3, 1.5)]


@pytest.mark.parametrize("product", [False, True])
def test_posterior_equals_one_dense_masked_process(spark, product):
    z, y, cat, df = frame(spark)
    same = cat[:, None] == cat[None, :]
    k = gp.gram(z, z, CH, product) * same
    train = np.arange(len(y)) % 5 != 0
    inv = np.linalg.inv(k[np.ix_(train, train)] + 0.2 * np.eye(train.sum()))
    cross = k[np.ix_(~train, train)]
    mu, var = cross @ inv @ y[train], np.diag(k)[~train] - np.einsum("ij,jk,ik->i", cross, inv, cross)
    got = {r.id: r for r in gp.posterior(df, CH, 0.2, product).collect()}
    ids = np.flatnonzero(~train)
    assert np.allclose([got[i].mu for i in ids], mu) and np.allclose([got[i].var_latent for i in ids], var)
    assert (k * ~np.eye(len(y), dtype=bool) > 0).sum() > 100  # not the identity
    out = {r.id: r for r in gp.loo(df, CH, 0.2, product).collect()}
    full = np.linalg.inv(k + 0.2 * np.eye(len(y)))
    assert np.allclose([out[i].mu for i in range(len(y))], y - full @ y / np.diag(full))
    total = gp.likelihood_profile(df, CH, 0.2, [1.0], product).agg(F.sum("loglik")).first()[0]
    sign, logdet = np.linalg.slogdet(k + 0.2 * np.eye(len(y)))
    assert math.isclose(total, -0.5 * (y @ full @ y + logdet + len(y) * math.log(2 * math.pi)), rel_tol=1e-9)
    assert all(r.relative_least > -1e-8 and r.diagonal_error < 1e-12 for r in gp.extremes(df, CH, product).collect())


def test_larger_categories_agree_and_empty_tables_pass(spark):
    _, _, _, df = frame(spark)
    one, tiles = ({r.id: (r.mu, r.var_obs) for r in gp.posterior(df, CH, 0.2, most=most, tile=20).collect()} for most in (4000, 20))
    assert one.keys() == tiles.keys() and all(np.allclose(one[i], tiles[i]) for i in one)
    assert gp.posterior(df.limit(0), CH, 0.2).count() == 0


def test_conjugate_gradients_solve_what_cholesky_solves(spark):
    z, y, cat, df = frame(spark, n=30)
    p = df.select(F.col("id").alias("vec_id"), F.col("cat").alias("label"), F.col("z").alias("embedding"), "y")
    near = pairs.category_pairs(p, {"z": (1, 6)}).where("d_z < 3")
    from skerry.functions import kernels

    half = near.select("i", "j", kernels.wendland_c2(F.col("d_z") / 3).alias("k"))
    whole = pairs.symmetric(half).unionByName(p.select(F.col("vec_id").alias("i"), F.col("vec_id").alias("j"), F.lit(1.0).alias("k")))
    x, steps, residual, done = gp.conjugate_gradients(whole, p.select(F.col("vec_id").alias("i"), F.col("y").alias("b")), 0.5, 1e-7)
    k = gp.gram(z, z, [(0, 6, 1.0, 3.0)]) * (cat[:, None] == cat[None, :])
    want = np.linalg.solve(k + 0.5 * np.eye(len(y)), y)
    got = {r.i: r.x for r in x.collect()}
    assert done and steps > 3 and np.allclose([got[i] for i in range(len(y))], want, atol=1e-4)
    assert gp.conjugate_gradients(whole, p.select(F.col("vec_id").alias("i"), F.col("y").alias("b")), 0.1, 1e-12, most=2)[3] is False


def test_metropolis_stays_in_bounds_and_repeats(spark):
    _, _, _, df = frame(spark, n=45)
    run = lambda: gp.metropolis(df, [2.0, 1.5], [(0.5, 4.0), (0.5, 4.0)], [(0, 3), (3, 6)], 0.2, 4, seed=1)
    a = run()
    assert a == run() and all(0.5 <= r <= 4.0 for s in a for r in s["radii"])


def test_r2_by_components_where_pls_stops_early(spark):
    rows = spark.createDataFrame([([float(i), float(i % 7)], 3.0 * i) for i in range(40)], "z array<double>, y double")
    m = reg.moments(rows, F.col("z"), F.col("y"))
    model = reg.pls(m, 10)
    assert model.weights.shape[1] < 10
    found = [reg.r2_on_scores(m, model, k) for k in (1, 2, 5, 10)]
    assert all(type(v) is float for v in found) and found[0] < found[1] and np.allclose(found[1:], 1)


def test_r2_on_scores_equals_least_squares_on_the_scores(spark):
    z, y, _, df = frame(spark)
    m = reg.moments(df, F.col("z"), F.col("y"))
    model = reg.pls(m, 4)
    s = ((z - model.mean) / model.width) @ model.weights
    for k in (1, 2, 4):
        x = np.column_stack([np.ones(len(s)), s[:, :k]])
        e = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
        assert np.isclose(reg.r2_on_scores(m, model, k), 1 - e @ e / ((y - y.mean()) ** 2).sum())


def test_cross_validation_gives_plain_floats(spark):
    _, _, _, df = frame(spark)
    found = reg.cross_validated(reg.fold_moments(df, F.col("z"), F.col("y"), F.col("cat")), lambda m: reg.ridge(m, 0.5))
    assert all(type(n) is float and type(value) is float for _, n, value in found)
    rows = [(k, int(n), round(value, 6)) for k, n, value in found]
    assert spark.createDataFrame(rows, "fold int, n long, r2 double").count() == 4


def test_cross_validation_from_moments_equals_numpy(spark):
    z, y, cat, df = frame(spark, cats=4)
    by_fold = reg.fold_moments(df.unionByName(df.limit(2).withColumn("z", F.lit(None))), F.col("z"), F.col("y"), F.col("cat"))
    own = lambda at: reg.Moments(float(at.sum()), np.column_stack([z, y])[at].sum(0), np.column_stack([z, y])[at].T @ np.column_stack([z, y])[at])
    for fit in (lambda m: reg.ridge(m, 0.5), lambda m: reg.on_scores(m, reg.pls(m, 2)), lambda m: reg.on_scores(m, reg.pca(m, 3), 0.1)):
        got = reg.cross_validated(by_fold, fit)
        assert [k for k, *_ in got] == [0, 1, 2, 3, None]
        errors = {}
        for k, n, value in got[:-1]:
            model = fit(own(cat != k))
            e = y[cat == k] - model.intercept - z[cat == k] @ model.weights
            errors[k] = (e @ e, ((y[cat == k] - y[cat == k].mean()) ** 2).sum())
            assert n == (cat == k).sum() and np.isclose(value, 1 - errors[k][0] / errors[k][1])
        assert np.isclose(got[-1][2], 1 - sum(a for a, _ in errors.values()) / sum(b for _, b in errors.values()))
    m = own(cat >= 0)
    p = reg.pls(m, 2)
    s = ((z - p.mean) / p.width) @ p.weights
    want, *_ = np.linalg.lstsq(np.column_stack([np.ones(len(s)), s]), y, rcond=None)
    fit = reg.on_scores(m, p)
    assert np.allclose(fit.intercept + z @ fit.weights, np.column_stack([np.ones(len(s)), s]) @ want)
