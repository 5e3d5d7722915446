import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry.operators import arms, sampling


def table(spark, n=200):
    rng = np.random.default_rng(0)
    rows = [(i, i % 5, "ab"[i % 2], i % 3, float(rng.normal()), float(rng.normal() / 2), float(abs(rng.normal())), float(rng.random())) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, fold long, label string, size long, y double, mu double, latent double, distance double")


def test_sums_less_a_fold_equal_the_other_folds(spark):
    rows, df = table(spark)
    got = {(r.label, r.fold): r.m for r in arms.other_folds(df, ["label"], F.col("y"), "m").collect()}
    assert all(np.isclose(v, np.mean([r[4] for r in rows if r[2] == c and r[1] != k])) for (c, k), v in got.items()) and len(got) == 10
    one = df.where("fold = 1")
    assert [r.m for r in arms.other_folds(one, [], F.col("y"), "m").collect()] == [None]


def test_scales_come_from_the_other_half(spark):
    rows, df = table(spark)
    long = arms.candidates(df, "label", "size", 10)
    assert long.count() == 5 * len(rows) and {r.arm for r in long.select("arm").distinct().collect()} == set(arms.ARMS)
    scaled = arms.cross_scaled(long, F.col("id") % 2).where("arm = 'distance'").collect()
    for half in (0, 1):
        z = [((r[4] - r[5]) / r[7]) ** 2 for r in rows if r[0] % 2 != half]
        assert all(np.isclose(r.scaled, r.sigma * np.sqrt(np.mean(z))) for r in scaled if r.half == half)


def test_rank_skill_with_ties_and_a_constant(spark):
    rows = [("c", k, float(k % 7), 0.0, 1.0) for k in range(60)] + [("s", k, float(k), 0.0, float(k // 6)) for k in range(60)]
    got = {r.arm: r for r in arms.rank_skill(spark.createDataFrame(rows, "arm string, id long, y double, mu double, sigma double"), ["arm"]).collect()}
    assert got["c"].rho is None and got["s"].rho > 0.98
    assert got["s"].recall == pytest.approx(3 / 6)  # the three largest errors are in the last tie of six


def test_control_sees_as_many_rows_as_the_held_out_split(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.normal(size=3)], "aab"[i % 3], float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, y double")
    got = arms.held_out(df, 100, 1, F.col("vec_id") % 2 == 0, 3)  # k beyond all rows: mu is the mean of what is seen
    held = {r.mu for r in got.where("split = 'held_out'").collect()}
    assert np.allclose(list(held), np.mean([y for *_, c, y in rows if c == "b"])) and got.where("split = 'held_out'").count() == 20
    seen = {r.id: r.mu for r in got.where("split = 'control'").collect()}
    free = sorted((r for r in rows if not (r[2] == "a" and r[0] % 2 == 0)), key=lambda r: __import__("hashlib").md5(f"3:{r[0]}".encode()).hexdigest())
    assert np.allclose(list(seen.values()), np.mean([r[3] for r in free[:20]])) and len(seen) == 20


def test_places_within_groups(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), (None, 5), (None, 4), ("b", 9)], "g string, v int")
    got = {(r.g, r.v): r.p for r in sampling.places_within(df, ["g"], ["v"], "p").collect()}
    assert got == {("a", 1): 1, ("a", 3): 2, (None, 4): 1, (None, 5): 2, ("b", 9): 1}
