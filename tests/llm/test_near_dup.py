import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from skerry.llm import near_dup as n

SCHEMA = "doc_id long, text string, fp string, root int"


def brute_print(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_classes(prints):
    """prints: {key: fp}; the smallest key reachable over links of three bits."""
    keys, root = sorted(prints), {k: k for k in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {k: find(k) for k in keys}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_masks_cover_every_pair_within_the_radius():
    rng = random.Random(1)
    for radius in (1, 2, 3, 4):
        masks = n.covering_masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        for _ in range(3000):
            z = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(signed(z) & m == 0 for m in masks)
    assert min((m % (1 << 64)).bit_count() for m in n.covering_masks(3)) >= 32


def test_rows_match_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    texts = [None, "", " \n", "One", "one", "one two", "É a B", "e" * 70000]
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(3, 400))]
        texts.append(" ".join(base))
        for _ in range(4):
            for _ in range(rng.randint(0, 2)):
                base[rng.randrange(len(base))] = rng.choice(words).upper()
            texts.append("\n".join(base))
    docs = [(1000 - i, t, "clash", 1) for i, t in enumerate(texts)]
    docs += [docs[9]] * 30 + [(None, texts[9], None, None), (None, "alone without an id in this table", None, None)]
    got = n.linked(spark.createDataFrame(docs, SCHEMA).repartition(3)).collect()
    assert len(got) == len(docs)
    prints = {d[0]: brute_print(d[1]) for d in docs if d[0] is not None}
    want = brute_classes(prints)
    assert len(set(want.values())) < len(want) - 20
    for r in got:
        if r.doc_id is not None:
            assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", want[r.doc_id])
    lone = {r.component_id for r in got if r.doc_id is None}
    assert lone == {want[1000 - 9], None}
    kept = n.deduplicated(spark.createDataFrame(docs, SCHEMA)).collect()
    ids = [r.doc_id for r in kept]
    assert sorted(i for i in ids if i is not None) == sorted(set(want.values())) and ids.count(None) == 1
    assert all(tuple(r)[2:] == ("clash", 1) for r in kept if r.doc_id is not None)


def test_blocks_of_a_large_bucket_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(n, "BLOCK", 8)
    rng = random.Random(8)
    near = {0}
    for _ in range(300):
        near.add(rng.choice(sorted(near)) ^ sum(1 << b for b in rng.sample(range(24), rng.randint(1, 3))))
    far = {rng.getrandbits(64) for _ in range(200)}
    prints = {signed(x): x for x in near | far}
    want = brute_classes(dict(enumerate(prints.values())))
    df = spark.createDataFrame([(i, k) for i, k in enumerate(prints)], "doc_id long, fp long")
    got = {r.fp: r.component_id for r in n.classes(df).collect()}
    assert got == {k: want[i] for i, k in enumerate(prints)}


def test_forests_connect_what_links_connect():
    rng = random.Random(3)
    a = np.array([rng.getrandbits(7) for _ in range(40)], np.int64)
    b = np.array([rng.getrandbits(7) for _ in range(30)], np.int64)
    for radius in (1, 2):
        for left, right in ((np.unique(a), None), (np.unique(a), np.setdiff1d(b, a))):
            other = left if right is None else right
            every = {(int(x), int(y)) for x in left for y in other if x != y and (int(x) ^ int(y)).bit_count() <= radius}
            forest = n._forest(left, right, radius)

            def parts(edges):
                root = {}
                find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
                for x, y in edges:
                    root[max(find(x), find(y))] = min(find(x), find(y))
                return {x: find(x) for x in root}, len({find(x) for x in root})

            (got, k), (want, m) = parts(forest), parts(every)
            assert {x: r for x, r in got.items()} == want and k == m and len(forest) == len(want) - m
            assert all((x, y) in every or (y, x) in every for x, y in forest)


def test_hot_fingerprints_and_classes_lose_no_row(spark, monkeypatch):
    from skerry.operators import hot_keys

    monkeypatch.setattr(hot_keys.hot_join, "__defaults__", ("n", 5))
    rng = random.Random(12)
    base = [rng.choice("abcdefgh") * 3 + str(i) for i in range(120)]
    texts = [" ".join(base)] * 40 + [" ".join([*base[:i], "other", *base[i + 1 :]]) for i in range(0, 120, 3)] + [f"text {i} alone {i * i}" for i in range(40)]
    docs = [(i, t, "", 0) for i, t in enumerate(texts)]
    want = brute_classes({i: brute_print(t) for i, t in enumerate(texts)})
    got = {r.doc_id: r.component_id for r in n.linked(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert got == want


def test_columns_of_any_name_and_type_pass_through(spark):
    names = ["__id", "__mark", "__row", "row", "key", "text", "n", "best", "absent", "hash", "fp", "doc_id", "a.b", "m"]
    schema = ", ".join(f"`{c}` {'map<string,int>' if c == 'm' else 'long' if c == 'doc_id' else 'string'}" for c in names)
    line = lambda i, text, m: tuple(text if c == "text" else i if c == "doc_id" else m if c == "m" else f"{c}{i}" for c in names)
    rows = [line(i, f"word{i} of text {i * i} here and {i}", {"x": i}) for i in range(12)]
    rows += [line(20, rows[3][5], {"x": 1}), rows[4], rows[4], line(5, rows[5][5], {"y": 2}), line(None, "a text without an id", None)]
    got = n.deduplicated(spark.createDataFrame(rows, schema))
    assert got.columns == names
    found = sorted(map(str, map(tuple, got.collect())))
    one = [str(r) for r in rows[:12] if r[11] != 5] + [str(rows[-1])]
    fives = {str(rows[5]), str(rows[15])}
    assert len(found) == 13 and sorted(set(found) - fives) == sorted(one) and len(set(found) & fives) == 1


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 100)] + [(5, 5), (7, 6)]
    got = {r.node: r.root for r in n.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(100)}


def test_majority_is_over_half():
    h = np.array([1, 3, 2, 0], np.uint64)
    assert n.majority(h, np.array([2, 0, 2])).tolist() == [1, 0, 0]


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert n.linked(empty).count() == 0 and n.deduplicated(empty).count() == 0
    assert n.deduplicated(empty).columns == empty.columns and n.linked(empty).where(F.col("fingerprint") == "").count() == 0
