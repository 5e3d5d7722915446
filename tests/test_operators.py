import math
import random

from pyspark.sql import functions as F

from skerry.functions import kernels, stats
from skerry.functions import paths
from skerry.operators import graphs, pairs, sampling


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_erf_and_scores(spark):
    for x in (-2.5, -0.3, 0.0, 0.7, 3.0):
        assert abs(value(spark, stats.erf(F.lit(x))) - math.erf(x)) < 2e-7
    y, mu, s = 1.3, 0.2, 0.8
    z = (y - mu) / s
    want = s * (z * math.erf(z / math.sqrt(2)) + 2 * math.exp(-z * z / 2) / math.sqrt(2 * math.pi) - 1 / math.sqrt(math.pi))
    assert abs(value(spark, stats.crps(F.lit(y), F.lit(mu), F.lit(s))) - want) < 1e-6


def test_kernels_are_one_at_zero_and_nothing_outside(spark):
    for dim in (1, 3, 10):
        for k in range(4):
            assert abs(value(spark, kernels.wendland(F.lit(0.0), dim, k)) - 1) < 1e-12
            assert value(spark, kernels.wendland(F.lit(1.0), dim, k)) == 0
    t = 0.37
    assert abs(value(spark, kernels.wendland(F.lit(t), 3, 3)) - value(spark, kernels.octic_32(F.lit(t)))) < 1e-12
    assert abs(value(spark, kernels.wendland(F.lit(t), 3, 1)) - value(spark, kernels.wendland_c2(F.lit(t)))) < 1e-12
    one = value(spark, kernels.gibbs(F.lit(0.5), F.lit(1.0), F.lit(1.0), 7))
    assert abs(one - value(spark, kernels.wendland_c2(F.lit(0.5 / math.sqrt(2))))) < 1e-12


def test_nearest_over_many_tiles_and_range_join(spark):
    rng = random.Random(0)
    rows = [(i, i % 2, [float(rng.randint(0, 4)) for _ in range(3)]) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3)
    dist = lambda a, b: math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b)))
    for cat in ("label", None):
        got = sorted((r.query_id, r["rank"], r.neighbour_id) for r in pairs.nearest(df, 4, cat_col=cat, tile=11).collect())
        want = []
        for i, c, z in rows:
            near = sorted((dist(z, w), j) for j, e, w in rows if j != i and (cat is None or e == c))[:4]
            want += [(i, k + 1, j) for k, (_, j) in enumerate(near)]
        assert got == sorted(want)
    got = {(r.i, r.j) for r in pairs.range_join(df, 1.5).collect()}
    assert got == {(i, j) for i, _, a in rows for j, _, b in rows if i < j and dist(a, b) < 1.5}
    for cat in ("label", None):
        got = sorted((r.i, r.j) for r in pairs.tiled_range_join(df, 1.5, cat_col=cat, tile=11).collect())
        assert got == sorted((i, j) for i, c, a in rows for j, e, b in rows if i < j and dist(a, b) < 1.5 and (cat is None or c == e))
    assert pairs.nearest(df.limit(0), 3).count() == 0 and pairs.tiled_range_join(df.limit(0), 3.0).count() == 0


def test_places_need_no_single_task(spark):
    rows = list(range(500))
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(x, x % 7) for x in rows], "a long, b long").repartition(5)
    got = {r.a: r.place for r in sampling.global_places(df, ["b", "a"]).collect()}
    want = {x: k + 1 for k, x in enumerate(sorted(rows, key=lambda x: (x % 7, x)))}
    assert got == want


def test_graph_walks_match_known_molecules(spark):
    ring = [(0, 1), (1, 2), (2, 3), (3, 0), (3, 4), (4, 5)]
    assert graphs.bridges_of(7, [[1, 3], [0, 2], [1, 3], [2, 0, 4], [3, 5], [4], []]) == ([0, 0, 0, 0, 0, 0, 6], [(4, 5), (3, 4)])
    nodes = spark.createDataFrame([(1, i) for i in range(7)] + [(2, 0)], "gidx long, i int")
    edges = spark.createDataFrame([(1, a, b) for a, b in ring] + [(1, b, a) for a, b in ring], "gidx long, i int, j int")
    got = {r.gidx: tuple(r)[1:] for r in graphs.topology(nodes, edges).collect()}
    assert got == {1: (7, 6, 2, 6, 1, 2, 1), 2: (1, 0, 1, 1, 0, 0, 0)}
    water = [(1, 0, 8, 0.0, 0.0, 0.0), (1, 1, 1, 0.96, 0.0, 0.0), (1, 2, 1, -0.24, 0.93, 0.0)]
    bonds = graphs.bonds(spark.createDataFrame(water, "gidx long, i int, z int, px double, py double, pz double"), {1: 0.31, 8: 0.66})
    assert {(r.i, r.j) for r in bonds.collect()} == {(0, 1), (1, 0), (0, 2), (2, 0)}
    labels = graphs.refine(spark.createDataFrame([(1, 0, "O"), (1, 1, "H"), (1, 2, "H")], "gidx long, i int, label string"), bonds, 2).collect()
    by = {(r.i, r.depth): r.label for r in labels}
    assert by[1, 2] == by[2, 2] != by[0, 2] and len(by) == 9


def test_source_paths(spark):
    cases = {
        ("", 0, 1): ("", "", "", "", -1),
        (None, 0, 1): ("", "", "", "", -1),
        ("x/orca.tar.zst", 0, 1): ("x", "", "x", "x/x", -1),
        ("top/sub/deep/mol_0_1/orca.tar.zst", 0, 1): ("top", "top/sub/deep", "mol_0_1", "top/mol", -1),
        ("top/sub/mol_-1_2/step12", -1, 2): ("top", "top/sub", "mol_-1_2", "top/mol", 12),
        ("top/mol_0_1_44", 0, 1): ("top", "top", "mol_0_1_44", "top/mol", -1),
        ("top/mol_0_1", 1, 2): ("top", "top", "mol_0_1", "top/mol_0_1", -1),
        ("top/mol_17", 0, 1): ("top", "top", "mol_17", "top/mol_17", -1),
        ("top/_0_1", 0, 1): ("top", "top", "_0_1", "top/_0_1", -1),
        ("orbnet_denali/a/orbnet_C12_conformers_ab12_3_0_1", 0, 1): ("orbnet_denali", "orbnet_denali/a", "orbnet_C12_conformers_ab12_3_0_1", "orbnet_denali/orbnet_C12", -1),
        ("trans1x/t1x_rxn0444_1154_551", 0, 1): ("trans1x", "trans1x", "t1x_rxn0444_1154_551", "trans1x/t1x_rxn0444", -1),
        ("ml_mo/mo_md_mace_mp_43279_0_1_1_406", 0, 1): ("ml_mo", "ml_mo", "mo_md_mace_mp_43279_0_1_1_406", "ml_mo/mo_md_mace_mp_43279", -1),
        ("trans1x/other_0_1", 0, 1): ("trans1x", "trans1x", "other_0_1", "trans1x/other", -1),
        ("step3", 0, 1): ("", "", "", "", 3),
    }
    rows = spark.createDataFrame(list(cases), "p string, q int, s int").select("p", "q", "s", paths.parsed(F.col("p"), F.col("q"), F.col("s")).alias("v")).collect()
    assert {(r.p, r.q, r.s): tuple(r.v) for r in rows} == cases
