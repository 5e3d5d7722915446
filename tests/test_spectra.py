import itertools

import numpy as np

from skerry.functions.structures import ATOMS
from skerry.operators import spectra


def atoms(rng, n):
    return [(int(rng.choice([1, 6, 8])), *map(float, rng.normal(size=3)), 0.0) for _ in range(n)]


def test_spectra_do_not_follow_order_or_place(spark):
    rng = np.random.default_rng(0)
    a = atoms(rng, 5)
    moved = [(z, x + 3, y - 1, w, q) for z, x, y, w, q in a[::-1]]
    df = spark.createDataFrame([(0, a), (1, moved), (2, []), (3, None), (4, a[:1])], f"gidx long, atoms {ATOMS}")
    got = {r.gidx: r.spectrum for r in spectra.spectra(df, 7).collect()}
    assert np.allclose(got[0], got[1]) and got[2] == got[3] == [0.0] * 7 and got[0][5:] == [0.0, 0.0]
    assert np.isclose(got[4][0], 0.5 * a[0][0] ** 2.4)


def test_transport_is_near_the_best_matching(spark):
    rng = np.random.default_rng(1)
    for n in (2, 4, 5):
        cost = rng.random((n, n))
        best = min(sum(cost[i, p[i]] for i in range(n)) / n for p in itertools.permutations(range(n)))
        assert best - 1e-6 <= spectra.sinkhorn(cost) <= best + 0.03
    a, b = atoms(rng, 4), atoms(rng, 6)
    df = spark.createDataFrame([(0, 1, a, b), (0, 0, a, a[::-1]), (0, 2, a, None)], f"i long, j long, left {ATOMS}, right {ATOMS}")
    got = {(r.i, r.j): r.d for r in spectra.transport(df).collect()}
    assert got[0, 0] < 0.02 < got[0, 1] and got[0, 2] is None
