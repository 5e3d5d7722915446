import math
import random

import numpy as np
from pyspark.sql import functions as F

from skerry.llm import nearest as n

SCHEMA = "vec_id long, embedding array<float>, score string, rank int, c int"


def brute(rows, k):
    ok = {}
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            ok[(i, tuple(np.float32(x).item() for x in v))] = None
    out = []
    for i, v in ok:
        if i % 100 == 0:
            found = []
            for j, w in ok:
                if j != i and len(w) == len(v):
                    s = 0.0
                    for a, b in zip(v, w):
                        s += (a - b) ** 2
                    found.append((math.sqrt(s), j))
            out += [(i, r + 1, j, s) for r, (s, j) in enumerate(sorted(found)[:k])]
    return sorted(out)


def run(spark, rows, k=10):
    df = spark.createDataFrame([(i, v, "s", 0, 1) for i, v in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in n.nearest(df, F.col("vec_id") % 100 == 0, k).collect())


def test_odd_rows_ties_and_copies(spark, monkeypatch):
    monkeypatch.setattr(n, "LEAST_ROWS", 64)
    monkeypatch.setattr(n, "TILE_C", 32)
    rng = random.Random(3)
    vec = lambda d=8: [rng.gauss(0, 1) for _ in range(d)]
    hot = vec()
    rows = [(i, hot if i % 3 == 0 else vec()) for i in range(700)]
    rows += [(1000, None), (1100, []), (1200, [0.0] * 8), (1300, [None] + vec(7)), (1400, [math.nan] + vec(7)), (1500, [math.inf] + vec(7)), (None, vec())]
    rows += [(1600, vec(3)), (1601, vec(3)), (1700, vec(2)), (300, hot), (300, hot), (400, vec()), (7, rows[7][1])]
    rows += [(1800, [1e-38] * 8), (1801, [1e-30] * 8), (1802, [1e30] * 8)]
    rows = [(i, v if v is None else [x if x is None or not math.isfinite(x) or abs(x) < 3e38 else 0.0 for x in v]) for i, v in rows]
    assert run(spark, rows) == brute(rows, 10)


def test_empty_table_and_few_candidates(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0]), (1, [2.0])]) == [(0, 1, 1, 1.0)]


def test_bounds_hold():
    rng = np.random.default_rng(0)
    for scale in (1e-3, 1.0, 1e6):
        a, b = rng.normal(size=(40, 33)) * scale, rng.normal(size=(50, 33)) * rng.lognormal(size=(50, 1))
        low, high = n.bounds(n.quantised(a), n.quantised(b))
        true = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
        assert (low <= true).all() and (true <= high).all()
        assert (high - low < 0.3 * true).mean() > 0.5


def test_components_near_overflow_and_underflow(spark, monkeypatch):
    rng, kind = random.Random(1), "vec_id long, embedding array<double>, score string, rank int, c int"
    vec = lambda width: [rng.gauss(0, 1) * width for _ in range(6)]
    rows = [(i, vec(rng.choice([1.0, 1e160, 1e155, 1e-170, 1e-160]))) for i in range(220)]

    def search(k):
        df = spark.createDataFrame([(i, v, "s", 0, 1) for i, v in rows], kind).repartition(3)
        return sorted(tuple(r) for r in n.nearest(df, F.col("vec_id") % 100 == 0, k).collect())

    want = {}
    for k in (10, 150):
        want[k] = []
        for q, v in rows[::100]:
            found = []
            for j, w in rows:
                if j != q:
                    total = 0.0
                    for a, b in zip(v, w):
                        total += (a - b) * (a - b)
                    found.append((math.sqrt(total), j))
            want[k] += [(q, r + 1, j, s) for r, (s, j) in enumerate(sorted(found)[:k])]
        assert search(k) == sorted(want[k])
    monkeypatch.setattr(n, "MOST_BYTES", 6 * 8 * 20)  # groups of twenty rows
    monkeypatch.setattr(n, "LEAST_ROWS", 1)
    assert search(10) == sorted(want[10])
