import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from skerry.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, length string, bucket int, rank double"


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=64))
@settings(max_examples=150, deadline=None)
def test_patterns_hold_the_histogram(histogram):
    patterns = packing.shortest_pack_first(histogram, 64)
    held = {}
    for p in patterns:
        assert p.count > 0 and sum(n * t for n, t in p.runs) <= 64
        for n, t in p.runs:
            held[n] = held.get(n, 0) + t * p.count
    assert held == histogram
    taken = {}
    found = packing.slots(patterns)
    for length, first, ranks, times, sequence, offset in found:
        assert taken.get(length, 0) == first and offset + length * times <= 64 and ranks % times == 0
        taken[length] = first + ranks
    assert taken == histogram
    assert len(patterns) <= 3 * 64 and len(found) <= 3 * 64 * 12


def test_one_at_a_time_gives_the_same_pack_lengths():
    rng = random.Random(1)
    for _ in range(200):
        items = [rng.randint(1, 40) for _ in range(rng.randint(0, 80))]
        packs = []
        for x in sorted(items, reverse=True):
            k = min(range(len(packs)), key=packs.__getitem__, default=None)
            if k is not None and packs[k] + x <= 40:
                packs[k] += x
            else:
                packs.append(x)
        got = packing.shortest_pack_first({x: items.count(x) for x in items}, 40)
        assert sorted(packs) == sorted(sum(n * t for n, t in p.runs) for p in got for _ in range(p.count))


def check(rows, docs, most, id_of=lambda r: r[0]):
    t = Tokenizer.from_file(PATH)
    want = {}
    for d in docs:
        ids = [*t.encode(d[1] or "", add_special_tokens=False).ids, 1]
        for s in range(0, len(ids), most):
            part = np.array(ids[s : s + most], "<u4")
            key = (d[0], s, len(part), zlib.crc32(part.tobytes()), len(ids))
            want[key] = want.get(key, 0) + 1
    got = {}
    for r in rows:
        key = (r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)
        got[key] = got.get(key, 0) + 1
    assert got == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(by) == list(range(len(by)))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= most


def test_rows_pack_whole_documents(spark):
    rng = random.Random(2)
    texts = [None, "", "word", "long " * 3000, "é\n" * 40] + [" ".join(rng.choice(["alpha", "beta", "x1"]) for _ in range(rng.randint(1, 90))) for _ in range(60)]
    docs = [(i, t, "c", 1, 0.5) for i, t in enumerate(texts)] + [(None, "word", None, None, None), (2, "word", "c", 1, 0.5)] + [(2, "word", "c", 1, 0.5)] * 300
    got = packing.packed(spark.createDataFrame(docs, SCHEMA).repartition(3), PATH, 1, 64).collect()
    check(got, docs, 64)
    rows = packing.packed(spark.createDataFrame(docs, SCHEMA), PATH, 1, 64, with_ids=True)
    whole = packing.sequences(rows, 64, 0).collect()
    assert len(whole) == len({r.sequence_id for r in got}) and all(len(r.ids) == 64 or len(r.ids).bit_count() == 1 for r in whole)
    assert sum(x != 0 for r in whole for x in r.ids) == sum(r.length for r in got)


def test_sequences_are_padded_but_at_a_power_of_two(spark):
    rows = [(0, 0, [5, 6, 7]), (1, 0, [5, 6]), (1, 2, [8, 9]), (2, 0, [4])]
    got = packing.sequences(spark.createDataFrame(rows, "sequence_id long, offset long, ids array<int>"), 8, 0).collect()
    assert {r.sequence_id: r.ids for r in got} == {0: [5, 6, 7, 0, 0, 0, 0, 0], 1: [5, 6, 8, 9], 2: [4]}


def test_one_hot_length_in_many_buckets(spark, monkeypatch):
    from skerry.operators import hot_keys

    monkeypatch.setattr(packing, "RANKED_TOGETHER", 20)
    monkeypatch.setattr(hot_keys.running_totals, "__defaults__", ("before", 4))
    docs = [(i, "word", "c", 1, 0.5) for i in range(900)] + [(1000 + i, "word " * (i % 60), "c", 1, 0.5) for i in range(200)]
    check(packing.packed(spark.createDataFrame(docs, SCHEMA).repartition(3), PATH, 1, 64).collect(), docs, 64)


def test_empty_table(spark):
    assert packing.packed(spark.createDataFrame([], SCHEMA), PATH, 1).count() == 0


def test_strings_of_added_tokens_are_packed_as_tokens(spark):
    docs = [(0, "one <|endoftext|> two", "c", 1, 0.5), (1, "<|startoftext|>a b", "c", 1, 0.5), (2, "plain", "c", 1, 0.5)]
    check(packing.packed(spark.createDataFrame(docs, SCHEMA), PATH, 1, 64).collect(), docs, 64)
