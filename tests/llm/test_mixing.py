import itertools
import random
import re

from pyspark.sql import functions as F

from skerry.llm import mixing as m

SCHEMA = "doc_id long, text string, source string, size int, p string"


def test_shares_stop_at_the_cap():
    sizes = {"a": 10, "b": 10, "c": 100, None: 0}
    t = m.capped_shares(sizes, m.cyclic_weights(list(sizes)), 120)
    assert m.cyclic_weights(["b", None, "a", "c", "d"]) == {"a": 1, "b": 2, "c": 3, "d": 1, None: 2}
    assert t[None] == 0 and t["a"] <= 30 and t["b"] == 30 and abs(sum(t.values()) - 120) < 1e-9 and abs(t["c"] / t["a"] - 3) < 1e-9


def brute_flow(patterns, quotas, most):
    """Largest total, then least repetition cost, over all integer splits."""
    best = None
    splits = [[x for x in itertools.product(range(most * size + 1), repeat=len(s)) if sum(x) <= most * size] for s, size in patterns]
    for choice in itertools.product(*splits):
        got = dict.fromkeys(quotas, 0)
        cost = 0
        for (s, size), x in zip(patterns, choice):
            for name, v in zip(s, x):
                got[name] += v
            cost += sum(max(0, sum(x) - size * c) for c in range(1, most))
        if all(got[q] <= quotas[q] for q in quotas):
            key = (-sum(got.values()), cost)
            best = key if best is None else min(best, key)
    return best


def test_flow_is_largest_and_cheapest():
    rng = random.Random(0)
    for _ in range(60):
        names = ["a", "b", "c"][: rng.randint(1, 3)]
        patterns = [(tuple(rng.sample(names, rng.randint(1, min(2, len(names))))), rng.randint(0, 3)) for _ in range(rng.randint(1, 3))]
        quotas = {x: rng.randint(0, 8) for x in names}
        flows = m.min_cost_flow(patterns, quotas, 3)
        got = dict.fromkeys(quotas, 0)
        cost = 0
        for (_, size), flow in zip(patterns, flows):
            assert sum(flow.values()) <= 3 * size
            for s, v in flow.items():
                got[s] += v
            cost += sum(max(0, sum(flow.values()) - size * c) for c in (1, 2))
        assert all(got[q] <= quotas[q] for q in quotas)
        assert (-sum(got.values()), cost) == brute_flow(patterns, quotas, 3)


def rows_of(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        source = "hot" if i % 3 == 0 else rng.choice(["a", "b", "é", "z", None, "tiny" if i < 40 else "a"])
        out.append((i, " ".join(["w"] * rng.randint(0, 30)), source, -1, "p"))
    return out


def test_rows_near_targets(spark, monkeypatch):
    monkeypatch.setattr(m, "SORTED_TOGETHER", 50)
    docs = rows_of(2000) + [(None, "a null id", "a", None, None), (5, None, "a", 0, ""), (6, " ", None, 0, "")] + [(7, "x y", "b", 0, "")] * 5
    df = spark.createDataFrame(docs, SCHEMA)
    got = m.mixed(df.repartition(3)).collect()
    assert len(got) == len(docs)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken, target = {}, {}, {}
    for d in docs:
        sizes[d[2]] = sizes.get(d[2], 0) + size(d[1])
    for r in got:
        assert r.source_size == sizes[r.source] and r.taken % max(r.size, 1) == 0 and 0 <= r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    want = m.capped_shares(sizes, m.cyclic_weights(list(sizes)), sum(sizes.values()))
    assert target == want
    assert all(abs(taken[s] - want[s]) <= 40 for s in sizes), (taken, want)
    again = m.mixed(df.repartition(5)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    out = m.drawn(df)
    assert out.columns == df.columns
    words = {r.source: r.n for r in out.groupBy("source").agg(F.sum(m.n_words(F.col("text"))).alias("n")).collect()}
    assert words == {s: n for s, n in taken.items() if n}


def test_overlapping_sources(spark):
    rng = random.Random(4)
    docs = [(i, "w " * rng.randint(1, 9), rng.choice(["a", "b", "a,b", "b,c"]), 0, "") for i in range(900)]
    df = spark.createDataFrame(docs, SCHEMA)
    got = m.mixed(df, members=F.split("source", ",")).collect()
    total = sum(r.size for r in got)
    by = {"a": 0, "b": 0, "c": 0}
    for r, d in zip(sorted(got, key=lambda r: r.doc_id), docs):
        for s in r.copies:
            assert s in d[2].split(",")
            by[s] += r.size
    target = {"a": total / 6, "b": total / 3, "c": total / 2}
    assert all(abs(by[s] - target[s]) < 30 for s in by), (by, target)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert m.mixed(empty).count() == 0 and m.drawn(empty).count() == 0
    blank = spark.createDataFrame([(1, "", "a", 0, "")], SCHEMA)
    assert [tuple(r)[:6] for r in m.mixed(blank).collect()] == [(1, "a", 0, 0, 0.0, 0)] and m.drawn(blank).count() == 0


def test_thresholds_against_a_sorted_line(spark, monkeypatch):
    rng = random.Random(6)
    rows = [("p", rng.getrandbits(64) - (1 << 63), rng.randint(0, 9)) for _ in range(3000)] + [("q", 77, 4)] * 500 + [("q", rng.getrandbits(63), 3) for _ in range(40)]
    narrow = spark.createDataFrame(rows, "p string, h long, size int").selectExpr("p", "h", "cast(size as long) size").repartition(3)
    line = {}
    for p in "pq":
        hashes, run, line[p] = {}, 0, []
        for _, h, size in (r for r in rows if r[0] == p):
            hashes[h] = hashes.get(h, 0) + size
        for h in sorted(hashes):
            line[p].append((run + hashes[h] / 2, h))
            run += hashes[h]
        line[p].append((run, None))
    wanted = [(p, k, rest) for p in "pq" for k, rest in enumerate(rng.sample(range(1, int(line[p][-1][0])), 12))]
    for together, bits in ((4, 3), (64, 8), (10_000, 8)):
        monkeypatch.setattr(m, "SORTED_TOGETHER", together)
        monkeypatch.setattr(m, "LEVEL_BITS", bits)
        got = m._thresholds(narrow, wanted, len(rows))
        for p, k, rest in wanted:
            # Which documents lie before the threshold is what counts; it may lie between two of their hashes.
            before = {h for middle, h in line[p][:-1] if middle < rest}
            assert {h for _, h in line[p][:-1] if h < got[p, k]} == before


def test_columns_of_any_name_and_type_pass_through(spark):
    names = ["__p", "__h", "__size", "__copy", "__cuts", "p", "h", "size", "copy", "cuts", "row", "doc_id", "text", "source", "a.b", "m"]
    kinds = {"doc_id": "long", "m": "map<string,int>"}
    line = lambda i: tuple({"doc_id": i, "text": "word " * (1 + i % 5), "source": "ab"[i % 2], "m": {"k": i}}.get(c, f"{c}-{i}") for c in names)
    rows = [line(i) for i in range(60)]
    out = m.drawn(spark.createDataFrame(rows, ", ".join(f"`{c}` {kinds.get(c, 'string')}" for c in names)))
    assert out.columns == names
    got = [tuple(r) for r in out.collect()]
    assert got and all(r in rows for r in got) and len({r[11] for r in got}) > 30
