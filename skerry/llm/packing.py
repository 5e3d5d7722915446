"""Packing by shortest-pack-first over the length histogram.

Texts are encoded and cut into pieces of at most the sequence length. Only the histogram of piece lengths, which
has as many rows as a sequence has tokens at most, comes to the driver. Lengths are placed longest first, each into
the shortest pack so far that has room, for all pieces of a length and all equal packs at once; what is kept is a
count for each packing pattern. Patterns turn into slots: a run of ranks of one length goes to one place in a run
of sequences. Pieces are ranked within their length and joined to the slots.

Defined results: a null text counts as empty, so its document is the end id alone; null ids, ties and repeated rows
are pieces like any other; other columns are not read; an empty table gives no pieces. Sequence ids run from 0
without gaps, and so do the offsets in each sequence. A length that holds most pieces is ranked in many buckets.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skerry.llm import tokens
from skerry.llm.arrow_text import sliced
from skerry.operators.hot_keys import running_totals
from skerry.session import durable

RANKED_TOGETHER = 20_000


@dataclass(frozen=True)
class Pattern:
    """`count` sequences that each hold these (length, times) runs."""

    count: int
    runs: tuple[tuple[int, int], ...]


def _with(runs: tuple[tuple[int, int], ...], length: int, times: int = 1) -> tuple[tuple[int, int], ...]:
    if runs and runs[-1][0] == length:
        return (*runs[:-1], (length, runs[-1][1] + times))
    return (*runs, (length, times))


def shortest_pack_first(histogram: dict[int, int], most: int) -> list[Pattern]:
    """Patterns that hold every length of the histogram as often as it counts, none longer than `most`."""
    packs: dict[int, dict[tuple, int]] = {}
    used: list[int] = []  # heap of the pack lengths in use

    def put(total: int, runs: tuple, count: int) -> None:
        if total not in packs:
            packs[total] = {}
            heapq.heappush(used, total)
        packs[total][runs] = packs[total].get(runs, 0) + count

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and used and used[0] + length <= most:
            total = used[0]
            runs, count = next(iter(packs[total].items()))
            n = min(left, count)
            if n == count:
                del packs[total][runs]
                if not packs[total]:
                    del packs[total]
                    heapq.heappop(used)
            else:
                packs[total][runs] = count - n
            put(total + length, _with(runs, length), n)
            left -= n
        fit = most // length
        if left >= fit:  # a new pack takes its own length until none fits
            put(fit * length, ((length, fit),), left // fit)
        if left % fit:
            put(left % fit * length, ((length, left % fit),), 1)
    return [Pattern(count, runs) for total in sorted(packs, reverse=True) for runs, count in packs[total].items()]


def slots(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, times in a sequence, first sequence, offset in it) for each run of each pattern.

    A length adds three patterns at most, and a sequence of `most` tokens holds sqrt(2 most) runs at most, so that
    there are about 3 most sqrt(2 most) slots at most, whatever the table: 393,216 for 2,048 tokens.
    """
    ranks: dict[int, int] = {}
    out, sequence = [], 0
    for p in patterns:
        offset = 0
        for length, times in p.runs:
            first, n = ranks.get(length, 0), p.count * times
            out.append((length, first, n, times, sequence, offset))
            ranks[length] = first + n
            offset += length * times
        sequence += p.count
    return out


def pieces(docs: DataFrame, tokenizer: str, end_id: int, most: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """id, start, length, ids_crc32 and doc_tokens of each piece, and its ids if asked for."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(tokenizer, "words", added=True)
        for batch in sliced(batches, 1, 2 << 20):
            rows, whose = [], []
            for k, ids in enumerate(encoder.encode(batch.column(1))):
                ids = np.append(ids, encoder.dtype.type(end_id)).astype("<u4")
                for start in range(0, len(ids), most):
                    part = ids[start : start + most]
                    whose.append(k)
                    rows.append((start, len(part), zlib.crc32(part.tobytes()), len(ids)) + ((part,) if with_ids else ()))
            kinds = [pa.int64()] * 4 + [pa.list_(pa.int32())] * with_ids
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(whose, pa.int64())), *(pa.array(list(c), k) for c, k in zip(zip(*rows), kinds))], names=names)

    names = [id_col, "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(n, T.LongType()) for n in names[1:5])]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids
    return docs.select(id_col, text_col).mapInArrow(cut, T.StructType(fields))


def placed(cut: DataFrame, most: int, id_col: str = "doc_id") -> DataFrame:
    """Pieces (durable, so that ranks hold still) with sequence_id and offset."""
    spark = cut.sparkSession
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # `most` rows at most
    found = slots(shortest_pack_first(histogram, most))
    place = F.broadcast(spark.createDataFrame(found, "length long, first long, ranks long, times long, sequence long, at long"))
    buckets = max(1, -(-sum(histogram.values()) // RANKED_TOGETHER))
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64(id_col, "start", "ids_crc32"), F.lit(buckets)))
    bases = running_totals(dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")), ["length"], "bucket", "n", "base").drop("n")
    within = Window.partitionBy("length", "bucket").orderBy(F.col(id_col).asc_nulls_first(), "start", "ids_crc32")
    ranked = dealt.withColumn("within", F.row_number().over(within)).join(bases, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("base") + F.col("within") - 1)
    at = (ranked["length"] == place["length"]) & (ranked["rank"] >= place["first"]) & (ranked["rank"] < place["first"] + place["ranks"])
    step = ranked["rank"] - place["first"]
    sequence = (place["sequence"] + F.floor(step / place["times"])).alias("sequence_id")
    offset = (place["at"] + step % place["times"] * ranked["length"]).alias("offset")
    return ranked.join(place, at).select(*(ranked[c] for c in cut.columns), sequence, offset)


def packed(docs: DataFrame, tokenizer: str, end_id: int, most: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row a piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for."""
    return placed(durable(pieces(docs, tokenizer, end_id, most, id_col, text_col, with_ids)), most, id_col)


def sequences(rows: DataFrame, most: int, pad_id: int) -> DataFrame:
    """sequence_id and its ids, from packed rows with ids; a sequence holds `most` ids at most.

    Sequences are padded to `most`, except those whose length is a power of two, which stay as they are.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    ids = F.flatten(F.transform(parts, lambda p: p["ids"]))
    grouped = rows.groupBy("sequence_id").agg(ids.alias("ids"))
    n = F.size("ids")
    return grouped.withColumn("ids", F.when(F.bit_count(n) == 1, F.col("ids")).otherwise(F.concat("ids", F.array_repeat(F.lit(pad_id), F.lit(most) - n))))
