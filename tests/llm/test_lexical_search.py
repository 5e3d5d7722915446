import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from skerry.llm import lexical_search as s

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string, score string, item int", "item_id long, text string, doc string"


def terms(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t in docs]
    n, total = sum(1 for _, c in held if c), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, ts in asked.items():
        found = []
        for i, c in held:
            m = 50 + (50 * sum(c.values()) * n) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in ts if t in c)
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, r + 1, i, -score) for r, (score, _, i) in enumerate(sorted(found, key=lambda x: (*x[:2], x[2] or 0))[:k])]
    return sorted(out, key=str)


def run(spark, docs, items, k):
    d = spark.createDataFrame([(*x, "a", 1) for x in docs], DOCS).repartition(4)
    q = spark.createDataFrame([(*x, "b") for x in items], ITEMS)
    return sorted((tuple(r) for r in s.ranked(d, q, k).collect()), key=str)


def tables(rng):
    words = ["Ka", "lo", "ñu", "42", "x", "Tau", "mé-lo", "ÅB"]
    weights = [40, 20, 10, 5, 5, 2, 2, 1]
    text = lambda n: " ".join(rng.choices(words, weights, k=n)) + rng.choice(["", ".", "\x00_z", f" r{rng.randint(0, 60)}"])
    docs = [(i, text(rng.choice([1, 2, 5, 30]))) for i in range(300)]
    docs += [(300, None), (301, ""), (302, " .,;"), (303, "lo " * 5000), (None, "ñu tau"), (None, "ñu tau"), (7, docs[7][1]), (7, docs[7][1]), (8, "tau")]
    docs += [(400 + i, "tau copy") for i in range(40)]
    items = [(0, "Ka lo"), (1, "TAU ÅB mé"), (1, "copy"), (2, None), (3, ""), (4, "nowhere"), (5, "42 42 x r7"), (None, "ñu"), (6, "ka lo ñu 42 x tau mé åb ÅB copy z")]
    return docs, items


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("k", [3, 50])
def test_ranks_equal_brute_force(spark, monkeypatch, k, small):
    if small:  # many groups of queries, runs and blocks
        monkeypatch.setattr(s, "GROUP_BYTES", 100)
        monkeypatch.setattr(s, "BLOCK_DOCS", 3)
        monkeypatch.setattr(s, "RUN_TERMS", 20)
    docs, items = tables(random.Random(k))
    assert run(spark, docs, items, k) == brute(docs, items, k)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a")], 5) == run(spark, [(1, "a")], [], 5) == run(spark, [(1, None)], [(1, "a")], 5) == []


def test_blocks_below_the_bound_are_not_scored():
    blocks = []
    for b in range(50):
        ids, sizes = list(range(8 * b, 8 * b + 8)), np.full(8, 20)
        counts = np.full(16, 1 + (b == 7))
        blocks.append((ids, sizes, np.arange(2, 17, 2), np.tile([0, 1], 8), counts))
    queries, best = s.Queries([(1, [0, 1])], np.array([5, 900], np.int64)), s.Best(1, 8)
    assert s.search_run(s.Run(blocks, 2, 400, 8000), queries, best) == 1
    assert sorted(-low for _, _, low in best.heaps[0]) == list(range(56, 64))
