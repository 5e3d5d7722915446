import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from skerry.llm import prefix_trie as p
from skerry.operators import hot_keys, order_stats

SCHEMA = "conv_id long, turn long, role string, text string, c string, depth int, place string"


def brute(rows):
    """Nodes of the trie by plain dictionaries."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or "", hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()))
    own = {c: [t[2:4] for t in sorted(ts, key=lambda t: (*t[:3], t[3][:64], t[4]))] for c, ts in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        whole[c] = tuple(own.get(base, [])[:h] + turns[h:])
    nodes = {}
    for c, q in whole.items():
        for d in range(len(q) + 1):
            nodes.setdefault(q[:d], []).append(c)
    children = {}
    for key in nodes:
        if key:
            children.setdefault(key[:-1], []).append(key)
    out = []

    def walk(key):
        below = [walk(k) for k in children.get(key, [])]
        leaves = sum(b[0] for b in below) or 1
        saved = sum(b[1] for b in below) + (len(nodes[key]) - 1) * (len(key[-1][1]) if key else 0)
        ends = ",".join(map(str, sorted(c for c in nodes[key] if whole[c] == key)))
        out.append((min(nodes[key]), len(key), min(nodes[key[:-1]]) if key else None, len(nodes[key]), len(below), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if nodes:
        walk(())
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(3)
    head = F.crc32(F.col("c").cast("string").cast("binary")) % 6
    got = p.trie(df, F.col("c") - F.col("c") % 100, head, 5).collect()
    assert sorted(r.position for r in got) == list(range(len(got)))
    by_key = {r.position: r for r in got}
    for r in got:  # a subtree is an interval, and its children lie in it
        assert r.position < r.subtree_end and all(by_key[x].depth > r.depth for x in range(r.position + 1, r.subtree_end))
    return sorted((tuple(r)[:8] for r in got), key=str)


def conversations(rng):
    rows = []
    for c in [*range(40), *range(100, 130), 250, 251, -3, -100]:
        shared = rng.random() < 0.5
        for turn in range(rng.choice([1, 2, 3, 5, 8])):
            rows.append((c, turn, rng.choice(["user", "assistant", None]), "same" if shared and turn < 3 else f"t{rng.randint(0, 4)}é"))
    rows += [(60, None, None, None), (60, None, "a", "x" * 70 + "b"), (60, None, "a", "x" * 70 + "a"), (61, 1, "a", "x"), (61, 1, "a", "x"), (None, 1, "a", "x"), (62, 3, "", "")]
    return rows + [(70, t, "user", f"long {t % 7}") for t in range(150)] + [(71, t, "user", f"long {t % 7}") for t in range(140)]


@pytest.mark.parametrize("small", [False, True])
def test_nodes_equal_brute_force(spark, monkeypatch, small):
    if small:  # blocks of blocks, ranks in three levels, and hot keys
        monkeypatch.setattr(p, "BLOCK", 4)
        monkeypatch.setattr(order_stats, "BLOCK", 4)
        monkeypatch.setattr(p, "WIDTH", 5)
        for f in (hot_keys.is_hot, hot_keys.hot_join):
            monkeypatch.setattr(f, "__defaults__", tuple(3 if d == hot_keys.HOT_ROWS else d for d in f.__defaults__))
    rows = conversations(random.Random(7))
    assert run(spark, rows) == brute(rows)


def test_no_rows_and_one_conversation_without_turns(spark):
    assert run(spark, []) == []
    c = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(c, 0, "user", "a")]
    assert run(spark, rows) == brute(rows) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_many_equal_conversations(spark, monkeypatch):
    monkeypatch.setattr(p, "BLOCK", 16)
    rows = [(100 * k, 0, "user", "hello") for k in range(200)]
    assert run(spark, rows) == brute(rows)


def test_earlier_sums_in_three_levels(spark, monkeypatch):
    monkeypatch.setattr(order_stats, "BLOCK", 3)
    rows = [(k % 2, k // 2, k) for k in range(80)]
    got = order_stats.earlier_sums(spark.createDataFrame(rows, "g long, at long, n long"), ["g"], "at", ["n"], 40).collect()
    assert all(r.before_n == sum(n for g, at, n in rows if g == r.g and at < r.at) for r in got) and len(got) == 80
