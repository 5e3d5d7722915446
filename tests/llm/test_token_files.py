import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skerry.llm import token_files as f
from skerry.llm.registry import op4_token_files
from skerry.session import shared_folder

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, file string, start int"


def test_round_trip_of_odd_rows(spark):
    texts = ["b", None, "", "a b  c\n\n", "newline\n" * 50, "é" * 3000, "<|endoftext|>"]
    docs = [(7 - i, t, "x", 0) for i, t in enumerate(texts)] + [(None, "null id", "x", 0), (5, "b", "x", 0), (5, "b", "x", 0)]
    df = spark.createDataFrame(docs, SCHEMA)
    got = sorted((tuple(r) for r in f.encoded(df, shared_folder(spark), PATH, 2, part_bytes=2000).collect()), key=lambda r: r[1])
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    want, start = [], 0
    hashes = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    for i, text, *_ in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, hashes[d[1]])):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want


def test_index_serves_shuffled_reads(spark):
    df = spark.createDataFrame([(i, f"text number {i} " * (i % 7), "", 0) for i in range(200)], SCHEMA)
    base = f"{shared_folder(spark)}/shuffled"
    f.write_records(df, f"{base}/r", PATH, 2, part_bytes=3000)
    f.write_index(spark, f"{base}/r", f"{base}/i")
    index = spark.read.parquet(f"{base}/i")
    assert index.count() == 200 and index.select("file").distinct().count() > 3
    wanted = index.where("id % 3 = 0").withColumn("order", F.xxhash64("id", F.lit(9)))
    got = {r.id: r.ids for r in f.fetch(spark, f"{base}/r", wanted).collect()}
    t = Tokenizer.from_file(PATH)
    assert set(got) == set(range(0, 200, 3))
    assert all(ids == [*t.encode(f"text number {i} " * (i % 7)).ids, 2] for i, ids in got.items())


def test_files_are_bounded_in_bytes_whatever_is_repeated_or_long(spark):
    hot, part = "hot text " * 10, 4000
    docs = [(7, hot, "x", 0)] * 400 + [(8, f"one id {i} " * 9, "x", 0) for i in range(200)] + [(None, f"no id {i} " * 9, "x", 0) for i in range(200)]
    docs += [(10 + i, "long text " * (300 if 40 < i < 60 else 1), "x", 0) for i in range(100)] + [(9, "e" * 50_000, "x", 0)]
    df = spark.createDataFrame(docs, SCHEMA).repartition(5)
    base = f"{shared_folder(spark)}/bounded-{id(docs)}"
    f.write_records(df, base, PATH, 2, part_bytes=part)
    found = f.records(spark, base).collect()
    text = {}
    for r in found:
        of = {7: len(hot), 9: 50_000}.get(r.id, 3000 if r.id and 50 < r.id < 70 else 100)
        text[r.part] = text.get(r.part, 0) + of
    assert len(found) == len(docs) and len(text) > 30
    assert sorted(text.values())[-2] <= 2 * part + 3000  # but for the file of the long text
    order = [(r.id is not None, r.id or 0) for r in sorted(found, key=lambda r: (r.part, r.offset))]
    assert order == sorted(order)


def test_parts_of_rows_by_brute_force():
    rng = np.random.default_rng(4)
    keys = sorted(((int(i), int(h)) for i, h in zip(rng.integers(0, 9, 40), rng.integers(-5, 5, 40))))
    low = [(None, -9), (None, 3), keys[2], keys[5], keys[5], keys[5], keys[20], keys[30]]
    bounds = pa.table({"id": pa.array([a for a, _ in low], pa.int64()), "h": pa.array([b for _, b in low], pa.int64())})
    own = [(None, -9), (None, 0), (None, 3), (None, 4), *keys]
    order = lambda k: (k[0] is not None, k[0] or 0, k[1])
    seen = {}
    for salt in range(12):
        got = f._parts_of(pa.array([a for a, _ in own], pa.int64()), pa.array([b for _, b in own], pa.int64()), np.full(len(own), salt), bounds)
        for k, p in zip(own, got.tolist()):
            seen.setdefault(k, set()).add(p)
    for k, parts in seen.items():
        last = max((p for p, x in enumerate(low) if order(x) <= order(k)), default=0)
        first = min((p for p, x in enumerate(low) if x == k), default=last + 1) - 1
        assert parts == set(range(max(first, 0), last + 1)), k


def test_damage_is_found_and_wide_ids_fit():
    raw = bytearray(f.frame(3, np.array([1, 70000], "<u4")))
    assert f.unframe(bytes(raw), 0)[1].tolist() == [1, 70000]
    for k in (0, 9, 15, len(raw) - 2):
        bad = bytearray(raw)
        bad[k] ^= 1
        with pytest.raises((ValueError, Exception)):
            f.unframe(bytes(bad), 0)


def test_empty_table(spark):
    assert f.encoded(spark.createDataFrame([], SCHEMA), shared_folder(spark), PATH, 2).count() == 0


def test_registered_query_takes_strings_of_added_tokens_as_tokens(spark, tmp_path):
    texts = ["one <|endoftext|> two", "plain", "<|endoftext|><|endoftext|>"]
    spark.createDataFrame([(i, t, "", 0) for i, t in enumerate(texts)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    t, start = Tokenizer.from_file(PATH), 0
    got = {r.doc_id: tuple(r)[1:] for r in op4_token_files(spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert got[i] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
