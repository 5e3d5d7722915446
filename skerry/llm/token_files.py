"""Token files: length-delimited binary records in ascending id order, with masked checksums and an offset index.

A file is a run of records, each
    u64 length | u32 masked crc32 of these 8 bytes | payload | u32 masked crc32 of the payload | newline
and a payload is
    u8 1 if the id is null | u8 bytes per token | i64 id | token ids
all little-endian. A checksum is masked by rotating it right by 15 bits and adding a constant, as stored checksums
of data that itself holds checksums should be. Spark's writer commits the files, so a lost executor leaves no half
file, and any file system that Spark can write will do. The index is a Parquet table (file and
its place in order, offset, length, id, tokens, tokens before it in the file), with which single records are fetched
in any order; the tokens before a file follow from it.

A file is what one task writes: ranges of (id, hash of the text) of about PART_BYTES of text, found by exact sums of
bytes over all rows, so that neither long texts side by side nor one repeated id or row make a file much larger.

Defined results: a null text counts as empty and yields the end id only; null ids come first; rows with equal ids
are ordered by the hash of their text; repeated rows each get a record; other columns are not read. An empty table
gives no records. Memory in a task follows the largest file: twice PART_BYTES of text at most, or one longer text.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skerry.llm import tokens
from skerry.llm.arrow_text import sliced
from skerry.operators.hot_keys import running_totals
from skerry.session import durable

MASK = 0xA282EAD8
_HEAD, _SUM, _META = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<BBq")
PART_BYTES, RECORD_BYTES = 32 << 20, 64
MOST_PARTS, SALTS, ROWS_SENT = 500_000, 1 << 20, 10_000


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    """One record without the newline, which the text writer adds."""
    payload = _META.pack(doc_id is None, ids.dtype.itemsize, doc_id or 0) + ids.tobytes()
    head = _HEAD.pack(len(payload))
    return b"".join((head, _SUM.pack(masked(head)), payload, _SUM.pack(masked(payload))))


def unframe(content: bytes | memoryview, at: int) -> tuple[int | None, np.ndarray, int]:
    """Id, token ids and the end of the record at this offset; raises ValueError on a bad checksum."""
    view = memoryview(content)
    head = view[at : at + 8]
    (length,) = _HEAD.unpack(head)
    if _SUM.unpack_from(view, at + 8)[0] != masked(head):
        raise ValueError(f"bad length checksum at byte {at}")
    payload = view[at + 12 : at + 12 + length]
    if _SUM.unpack_from(view, at + 12 + length)[0] != masked(payload):
        raise ValueError(f"bad payload checksum at byte {at}")
    null, width, doc_id = _META.unpack_from(payload)
    return None if null else doc_id, np.frombuffer(payload[_META.size :], f"<u{width}"), at + length + 17


def _key_of(rows: DataFrame) -> DataFrame:
    """rows (id, text) with the hash that orders rows of one id."""
    return rows.withColumn("h", F.xxhash64("text"))


def part_bounds(rows: DataFrame, part_bytes: int) -> tuple[int, pa.Table]:
    """Number of parts of about `part_bytes` of text, and the least key (id, h) of each, nulls first.

    Bytes are summed exactly over all keys in order: by ranges, then within them. A part's bound is the key that holds
    the part's first byte, so that repeated rows of one key may bound many parts. There are MOST_PARTS bounds at most,
    of 16 bytes, since parts are larger where there would be more.
    """
    keys = _key_of(rows).groupBy("id", "h").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + RECORD_BYTES).alias("n"))
    order = [F.col("id").asc_nulls_first(), F.col("h")]
    ranged = keys.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ranged = durable(ranged.select("id", "h", "n", F.shiftright("at", 33).alias("range"), "at"))
    sums = running_totals(ranged.groupBy("range").agg(F.sum("n").alias("n")), [], "range", "n", "base")
    total = ranged.agg(F.sum("n")).first()[0] or 0
    size = max(part_bytes, -(-total // MOST_PARTS))
    run = F.sum("n").over(Window.partitionBy("range").orderBy("at"))
    placed = ranged.withColumn("upto", run).join(F.broadcast(sums.select("range", "base")), "range")  # a row for each range partition
    first, last = F.ceil((F.col("base") + F.col("upto") - F.col("n")) / size), F.floor((F.col("base") + F.col("upto") - 1) / size)
    held = placed.where(first <= last).select("id", "h", F.explode(F.sequence(first, last)).alias("part"))
    return max(1, -(-total // size)), held.select("part", "id", "h").toArrow().sort_by("part")


def _parts_of(ids: pa.Array, hashes: pa.Array, salts: np.ndarray, bounds: pa.Table) -> np.ndarray:
    """The part of each row; rows of a key that bounds several parts are dealt over them."""
    low_ids, low_h = bounds.column("id").combine_chunks(), bounds.column("h").to_numpy()
    nulls = low_ids.null_count
    known, h = low_ids.drop_null().to_numpy(), hashes.to_numpy(zero_copy_only=False)
    null = ids.is_null().to_numpy(zero_copy_only=False)
    own = ids.fill_null(0).to_numpy(zero_copy_only=False)
    lo = np.where(null, 0, nulls + np.searchsorted(known, own, "left"))
    hi = np.where(null, nulls, nulls + np.searchsorted(known, own, "right"))
    first = last = hi - 1
    tied = np.flatnonzero(hi > lo)  # rows whose id is a bound
    if len(tied):
        first, last = first.copy(), last.copy()
        for a, b in np.unique(np.stack([lo[tied], hi[tied]], 1), axis=0).tolist():
            at = tied[(lo[tied] == a) & (hi[tied] == b)]
            left, right = a + np.searchsorted(low_h[a:b], h[at], "left"), a + np.searchsorted(low_h[a:b], h[at], "right")
            last[at] = right - 1
            first[at] = np.where(right > left, left - 1, right - 1)  # a bound's rows may begin in the part before
    first, last = np.maximum(first, 0), np.maximum(last, 0)
    return (first + salts % (last - first + 1)).astype(np.int32)


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES, added: bool = False) -> None:
    """Encodes every text (with `added`, strings of added tokens as these) and writes the records under path, files and records in ascending id order."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    parts, bounds = part_bounds(rows, part_bytes)
    sent = spark.sparkContext.broadcast(bounds)  # 16 bytes a part, MOST_PARTS at most

    @F.arrow_udf("int")
    def part_of(ids: pa.Array, hashes: pa.Array, salts: pa.Array) -> pa.Array:
        return pa.array(_parts_of(ids, hashes, salts.to_numpy(zero_copy_only=False), sent.value), pa.int32())

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(tokenizer, "bytes", added)
        end = np.array([end_id], encoder.dtype)
        for batch in batches:
            for part in sliced([batch], 1, 2 << 20):
                frames = [frame(i, np.concatenate([ids, end])) for i, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1)))]
                yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], names=["frame"])
            pa.default_memory_pool().release_unused()

    keyed = _key_of(rows).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    dealt = keyed.select("id", "text", "h", part_of("id", "h", "salt").alias("part")).repartitionById(parts, "part")
    ordered = dealt.sortWithinPartitions(F.col("id").asc_nulls_first(), "h").select("id", "text")
    ordered.mapInArrow(framed, "frame binary").select(F.col("frame").cast("string").alias("value")).write.text(path)


def records(spark: SparkSession, path: str) -> DataFrame:
    """file, its part (its place in order), offset, length, id, n_tokens, ids_crc32 and tokens before it in its file; checksums are verified."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                content = content.as_buffer()
                at, before = 0, 0
                while at < content.size:
                    rows = []
                    while at < content.size and len(rows) < ROWS_SENT:
                        doc_id, ids, end = unframe(content, at)
                        rows.append((name, at, end - at, doc_id, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), before))
                        at, before = end, before + len(ids)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    names = ["file", "offset", "length", "id", "n_tokens", "ids_crc32", "before"]
    kinds = [pa.string(), *[pa.int64()] * 6]
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    found = files.mapInArrow(parsed, "file string, offset long, length long, id long, n_tokens long, ids_crc32 long, before long")
    return found.withColumn("part", F.regexp_extract("file", r"part-(\d+)-[^/]*$", 1).cast("long"))


def write_index(spark: SparkSession, path: str, index_path: str) -> None:
    """The offset index of the files under path: one row a record, with its checksum and the tokens before it in its file."""
    records(spark, path).write.parquet(index_path)


def file_starts(index: DataFrame) -> DataFrame:
    """(file, first): tokens in all files before it."""
    files = index.groupBy("file", "part").agg(F.sum("n_tokens").alias("n"))
    return running_totals(files, [], "part", "n", "first").select("file", "first")


def fetch(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """id, order and token ids of the wanted index rows (file, offset, `order`): shuffled reads by offset."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, places in zip(batch.column(0), batch.column(1).to_pylist()):
                got = [(*unframe(content.as_buffer(), p["offset"])[:2], p["order"]) for p in places]
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64()), pa.array([g[1].tolist() for g in got], pa.list_(pa.int64()))], names=["id", "order", "ids"])

    places = wanted.groupBy("file").agg(F.collect_list(F.struct("offset", "order")).alias("places"))
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    return files.join(places, "file").select("content", "places").mapInArrow(cut, "id long, order long, ids array<long>")


def encoded(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES, added: bool = False) -> DataFrame:
    """Writes records and index in a new folder under `folder` and returns what reading them back gave: id, start, n_tokens, ids_crc32.

    Files are read and their checksums verified once, for the index; the rows returned are those of the index.
    """
    spark = docs.sparkSession
    base = f"{folder}/tokens-{uuid.uuid4().hex}"
    write_records(docs, f"{base}/records", tokenizer, end_id, id_col, text_col, part_bytes, added)
    write_index(spark, f"{base}/records", f"{base}/index")
    index = spark.read.parquet(f"{base}/index")
    read = index.join(F.broadcast(file_starts(index)), "file")  # a row a file, MOST_PARTS at most
    return read.select(F.col("id").alias(id_col), (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
