import numpy as np
from pyspark.sql import functions as F

from skerry.operators import means, pairs, regression
from skerry.plans.assemblies import sized

SF = "/root/testdata/sf0.001"


def design(z, n, centre, width):
    terms = (np.stack([n, np.log(n), np.sqrt(n), n**3], 1) - centre) / width
    return np.hstack([np.ones((len(z), 1)), z, terms, z * np.log(n)[:, None]])


def test_size_mean_and_deviation_against_numpy(spark):
    rng = np.random.default_rng(3)
    z, n = rng.normal(size=(300, 3)), rng.integers(1, 40, 300).astype(float)
    y = 2 + z @ [1, -1, 0.5] + np.log(n) * z[:, 0] * 2 + rng.normal(size=300) * np.sqrt(n)
    cat = rng.integers(0, 3, 300)
    rows = spark.createDataFrame([(i, z[i].tolist(), float(n[i]), float(y[i]), int(cat[i])) for i in range(300)], "id int, z array<double>, n double, y double, cat int")
    model = means.size_mean(rows, "z", "n", "y")
    raw = np.stack([n, np.log(n), np.sqrt(n), n**3], 1)
    h = design(z, n, raw.mean(0), raw.std(0))
    beta, *_ = np.linalg.lstsq(h, y, rcond=None)
    got = rows.select("id", model.predict("z", "n").alias("p"), model.variance("z", "n").alias("v")).orderBy("id").collect()
    assert np.allclose([r.p for r in got], h @ beta, atol=1e-6)
    sigma2 = ((y - h @ beta) ** 2).sum() / (300 - h.shape[1])
    assert np.allclose([r.v for r in got], sigma2 * np.einsum("ij,jk,ik->i", h, np.linalg.pinv(h.T @ h), h), rtol=1e-5)
    r = rows.select("id", "n", "cat", (F.col("y") - model.predict("z", "n")).alias("r"))
    v = np.hstack([np.ones((300, 1)), np.log(n)[:, None], np.eye(3)[cat]])
    b, *_ = np.linalg.lstsq(v, np.log((y - h @ beta) ** 2 + 1e-8), rcond=None)
    got = [x.sigma for x in means.deviation(r, "r", "n", "cat").orderBy("id").collect()]
    assert np.allclose(got, np.exp(v @ b / 2), rtol=1e-5)


def test_size_terms_lower_the_residual(spark):
    rows = sized(spark, SF)
    m = means.size_mean(rows, "z", "size", "y")
    plain = regression.ridge(regression.moments(rows, F.col("z"), F.col("y")), 0.0)
    left = rows.agg(F.variance(F.col("y") - m.predict("z", "size")).alias("a"), F.variance(F.col("y") - plain.predict(F.col("z"))).alias("b")).first()
    assert left.a < left.b


def test_extensive_design_ignores_unknown_elements(spark):
    atoms = [{"z": 1, "px": 0.0, "py": 0.0, "pz": 0.0, "q": 0.1}, {"z": 9, "px": 0.0, "py": 0.0, "pz": 0.0, "q": 0.1}, {"z": 1, "px": 0.0, "py": 0.0, "pz": 0.0, "q": 0.1}]
    row = spark.createDataFrame([(atoms, -2, 3)], "atoms array<struct<z:int,px:double,py:double,pz:double,q:double>>, c int, s int")
    assert row.select(means.extensive_design(F.col("atoms"), [1, 6], F.col("c"), F.col("s")).alias("x")).first().x == [2.0, 0.0, -2.0, 2.0, 4.0, 3.0, 9.0]


def test_pairs_and_counts_are_the_same_in_small_tiles(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(0, 2)), rng.normal(size=4).tolist()) for i in range(120)] + [(900, None, [0.0] * 4), (901, 1, None)]
    df = spark.createDataFrame(rows, "vec_id int, label int, embedding array<double>")
    d = {(a[0], b[0]): (a[1], np.linalg.norm(np.subtract(a[2][:2], b[2][:2])), np.linalg.norm(np.subtract(a[2][2:], b[2][2:]))) for a in rows[:120] for b in rows[:120] if a[0] < b[0] and a[1] == b[1]}
    channels = {"a": (1, 2), "b": (3, 2)}
    for within, every, keep in ((None, True, lambda x, y: True), ({"a": 1.0, "b": 1.0}, True, lambda x, y: x < 1 and y < 1), ({"a": 1.0, "b": 1.0}, False, lambda x, y: x < 1 or y < 1)):
        got = {(r.i, r.j): (r.cat, r.d_a, r.d_b) for r in pairs.category_pairs(df, channels, within=within, every=every, tile=16).collect()}
        want = {k: v for k, v in d.items() if keep(*v[1:])}
        assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)
    whole = {k: np.hypot(v[1], v[2]) for k, v in d.items()}
    for r in pairs.neighbour_counts(df, [0.8, 1.6], tile=16).collect():
        assert [r.c0, r.c1] == [sum(v < t for k, v in whole.items() if r.id in k) for t in (0.8, 1.6)]
