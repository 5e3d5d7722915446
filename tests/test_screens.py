"""Screens, clusters, pooled kernels and strain against plain computations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry.operators import graphs, pairs, screens, strain


def test_drawn_pairs_never_meet_themselves_and_grow_with_the_rows(spark):
    rows = spark.range(0, 300, 3).select(F.col("id").alias("vec_id"), F.col("id").alias("v"))
    got = screens.drawn_pairs(rows, "vec_id", 4, 7, ["v"]).collect()
    assert len(got) == 400 and all(r["i"] != r["j"] and r["a_v"] == r["i"] and r["b_v"] == r["j"] for r in got)
    assert screens.drawn_pairs(rows.limit(1), "vec_id", 4, 7, ["v"]).count() == 0
    assert screens.drawn_pairs(rows.limit(0), "vec_id", 4, 7, ["v"]).count() == 0


def test_clusters_are_the_reachable_sets(spark):
    rng = np.random.default_rng(1)
    points = rng.normal(size=(60, 2))
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(points)], "vec_id long, embedding array<double>")
    near = pairs.tiled_range_join(df, 0.4, tile=16).select(F.col("i").alias("a"), F.col("j").alias("b"))
    got = {r["node"]: r["root"] for r in graphs.components(near).collect()}
    low = list(range(60))
    for _ in range(60):
        for i in range(60):
            low[i] = min(low[j] for j in range(60) if np.linalg.norm(points[i] - points[j]) < 0.4)
    alone = {i for i in range(60) if sum(np.linalg.norm(points - points[i], axis=1) < 0.4) == 1}
    assert got == {i: low[i] for i in range(60) if i not in alone}


def test_pooled_gram_is_the_sandwich_product(spark):
    rng = np.random.default_rng(2)
    k = rng.random((12, 12))
    k = k + k.T
    near = spark.createDataFrame([(i, j, float(k[i, j])) for i in range(12) for j in range(12)], "i long, j long, k double")
    members = spark.createDataFrame([(i, i % 3) for i in range(12)], "id long, pool long")
    a = np.eye(3)[np.arange(12) % 3].T
    want = a @ k @ a.T
    for r in screens.pooled_gram(near, members).collect():
        assert r["k"] == pytest.approx(want[r["i"], r["j"]])


def test_growth_verdicts(spark):
    curve = lambda power: spark.createDataFrame([(m, float(m**power)) for m in (100, 200, 400)], "m long, per_row double")
    assert [screens.growth_verdict(curve(p)).first()["verdict"] for p in (0.0, 0.3, 1.0)] == ["go", "marginal", "no go"]
    r = screens.curve_verdict(spark.createDataFrame([(1, 0.1), (2, 0.2), (8, 0.22)], "m long, r2 double")).orderBy("m").collect()
    assert [x["climbing"] for x in r] == [False, True, False] and r[2]["gain"] == pytest.approx(0.01)


def test_strain_of_single_structures(spark):
    """Too few of any kind for a reference: covalent radii and ideal angles decide."""
    radii, contact = {1: 0.31, 8: 0.66}, {1: 1.2, 8: 1.52}
    half = math.radians(104.5 / 2)
    water = [(8, 0.0, 0.0, 0.0), (1, 0.96 * math.sin(half), 0.96 * math.cos(half), 0.0), (1, -0.96 * math.sin(half), 0.96 * math.cos(half), 0.0)]
    loose = [(1, 0.0, 0.0, 0.0), (1, 2.0, 0.0, 0.0)]
    rows = [(g, i, *a) for g, atoms in enumerate((water, loose)) for i, a in enumerate(atoms)]
    atoms = spark.createDataFrame(rows, "gidx long, i int, z int, px double, py double, pz double")
    got = {r["gidx"]: r for r in strain.strain(atoms, graphs.bonds(atoms, radii), radii, contact).collect()}
    d = 0.96 - 0.97
    assert got[0]["n_bonds"] == 2 and got[0]["bond_sq"] == pytest.approx(2 * d * d) and got[0]["bond_compress"] == pytest.approx(2 * d * d)
    assert got[0]["bond_extend"] == 0 and got[0]["bond_p95"] == pytest.approx(abs(d)) and got[0]["clash"] == 0
    assert got[0]["angle_max"] == pytest.approx(math.radians(180 - 104.5)) and got[0]["angle_sq_per_atom"] == pytest.approx(math.radians(75.5) ** 2 / 3)
    assert got[1]["n_bonds"] == 0 and got[1]["bond_max"] == 0 and got[1]["clash"] == pytest.approx(0.4**2)


def test_strain_reference_is_the_mode(spark):
    rows = [(0, 1, 8, 1, 2, r) for r in [0.9612] * 20 + [0.99] * 12 + [4.0]] + [(1, 1, 1, 1, 1, 0.74)]
    records = spark.createDataFrame(rows, "gidx long, za int, zb int, da int, db int, r double")
    got = strain.reference(records, ["za", "zb", "da", "db"], "r", 0.4, 3.5, 0.005).collect()
    assert [(r["za"], r["zb"], r["n"]) for r in got] == [(1, 8, 33)] and got[0]["mode"] == pytest.approx(0.9625)


def test_repeats_with_nulls_and_no_rows(spark):
    from skerry.operators import grouping

    df = spark.createDataFrame([("a",), ("a",), (None,), (None,), (None,), ("b",)], "k string")
    assert grouping.repeats(df, "k").first().asDict() == {"values": 3, "repeated_share": 5 / 6, "largest": 3}
    assert [tuple(r) for r in grouping.largest_counts(df, "k", 2).orderBy("rank").collect()] == [(1, 3), (2, 2)]
    assert grouping.repeats(df.limit(0), "k").first().asDict() == {"values": 0, "repeated_share": None, "largest": None}


def test_screening_table_keeps_a_small_plan(spark, tmp_path):
    """The curves are written, so that no metric's plan holds the drawing of its pairs again for each figure."""
    from skerry.plans import screens as plans

    rows = [(i, [float(((i + 1) * k * 7919) % 97) / 97 for k in range(1, 9)], i % 3) for i in range(60)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    plan = plans.screening_table(spark, str(tmp_path))._jdf.queryExecution().analyzed().toString()
    assert plan.count("Relation [") == 0
