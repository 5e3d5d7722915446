"""Ranked lexical search with block-max pruning.

Documents are cut into blocks of consecutive rows, each a forward index of the terms that queries use. A task takes a
run of blocks, finds each term's largest impact in every block, and sorts the blocks of a query by the sum of these
maxima. Blocks are scored from the forward index until the bound falls below the k-th score found so far; what a task
keeps of each query meets the others' in one window. Bounds hold and scores are whole numbers, so no document that
belongs to the result is left out.

Queries are dealt by hash into groups of about GROUP_BYTES of text, so that the vocabulary that goes to the tasks is
bounded; each group reads the documents once.

Defined results: terms are maximal runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z in
lower case; a null text has none. Rows of equal query id, null included, are one query with the terms of all. Repeated
documents each have a rank of their own; a null document id comes last among equal scores. Empty tables give no rows.
Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skerry.llm.arrow_text import sliced
from skerry.session import durable

GROUP_BYTES = 8 << 20
BLOCK_DOCS, BLOCK_TERMS, RUN_TERMS = 64, 1 << 16, 1 << 19
_OTHER = [b for b in range(128) if not chr(b).isalnum()]
_FOLD = bytes(32 if b in _OTHER else b + 32 if 65 <= b <= 90 else b for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def queries_by_group(items: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(item, terms, part): the distinct terms of each query and its group, and the number of groups."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1, 1 << 20):
            each = [sorted(set(terms_of(t.as_py() or b""))) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(each, pa.list_(pa.binary()))], names=["item", "terms"])

    rows = items.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).cast("binary").alias("text"))
    one = rows.mapInArrow(split, "item long, terms array<binary>").select("item", F.explode("terms").alias("term")).distinct()
    one = durable(one)
    held = one.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    groups = max(1, -(-held // GROUP_BYTES))
    return one.groupBy("item").agg(F.collect_list("term").alias("terms")).withColumn("part", F.pmod(F.xxhash64("item"), F.lit(groups))), groups


def indexed(docs: DataFrame, vocabulary: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """Blocks of documents: ids, numbers of terms, ends of each one's entries, and the entries (place in the vocabulary, count)."""
    place = {t: k for k, t in enumerate(vocabulary)}
    kind = pa.list_(pa.int64())
    names = ("ids", "sizes", "ends", "terms", "counts")
    schema = "ids array<long>, sizes array<long>, ends array<long>, terms array<int>, counts array<int>"
    kinds = [kind, kind, kind, pa.list_(pa.int32()), pa.list_(pa.int32())]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], [], []]

        def full() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(held, kinds)], names=list(names))
            for c in held:
                c.clear()
            return out

        for batch in sliced(batches, 1, 1 << 20):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = terms_of(text.as_py() or b"")
                found = [(place[t], n) for t, n in Counter(words).items() if t in place]
                ids, sizes, ends, terms, counts = held
                ids.append(doc)
                sizes.append(len(words))
                terms += [t for t, _ in found]
                counts += [n for _, n in found]
                ends.append(len(terms))
                if len(ids) >= BLOCK_DOCS or len(terms) >= BLOCK_TERMS:
                    yield full()
        if held[0]:
            yield full()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(cut, schema)


class Queries:
    """Term places and weights of all queries of a group, end to end; they go to the tasks."""

    def __init__(self, items: list[tuple[int | None, list[int]]], weights: np.ndarray):
        self.items = [i for i, _ in items]
        self.ends = np.cumsum([len(t) for _, t in items], dtype=np.int64)
        self.terms = np.array([t for _, ts in items for t in ts], np.int64)
        self.weights = weights
        self.size = len(weights)


class Run:
    """A run of blocks: entries with the impact of each, and each term's largest impact in every block."""

    def __init__(self, blocks: list[tuple[np.ndarray, ...]], vocabulary: int, documents: int, total: int):
        self.ids = [b[0] for b in blocks]
        terms, block_of = np.concatenate([b[3] for b in blocks]), np.repeat(np.arange(len(blocks)), [len(b[3]) for b in blocks])
        impacts = []
        for _, sizes, ends, _, counts in blocks:
            m = 50 + (50 * sizes * documents) // total
            tf = counts.astype(np.int64)
            impacts.append(1_000_000_000 * tf // (1000 * tf + 20 * np.repeat(m, np.diff(ends, prepend=0))))
        self.impacts = impacts
        distinct, local = np.unique(terms, return_inverse=True)
        self.place = np.full(vocabulary, -1, np.int64)
        self.place[distinct] = np.arange(len(distinct))
        self.local = np.split(local, np.cumsum([len(b[3]) for b in blocks])[:-1])
        self.starts = [np.append(0, b[2]) for b in blocks]
        self.most = np.zeros((len(distinct), len(blocks)), np.int64)
        np.maximum.at(self.most, (local, block_of), np.concatenate(impacts))

    def scores(self, block: int, weight: np.ndarray) -> np.ndarray:
        """Scores of the documents of a block for a query with these weights by local term."""
        sums = np.append(0, np.cumsum(weight[self.local[block]] * self.impacts[block]))
        return np.diff(sums[self.starts[block]])


class Best:
    """The k best of each query; null ids come last among equal scores."""

    def __init__(self, queries: int, k: int):
        self.k, self.heaps = k, [[] for _ in range(queries)]

    def least(self, query: int) -> int:
        """What a score must reach to change the result."""
        heap = self.heaps[query]
        return max(heap[0][0], 1) if len(heap) == self.k else 1

    def offer(self, query: int, score: int, doc: int | None) -> None:
        entry, heap = (score, doc is not None, -(doc or 0)), self.heaps[query]
        if len(heap) < self.k:
            heapq.heappush(heap, entry)
        elif entry > heap[0]:
            heapq.heapreplace(heap, entry)


def search_run(run: Run, queries: Queries, best: Best) -> int:
    """Offers every document of the run that may be among the best; returns the number of blocks scored."""
    place, scored = run.place[queries.terms], 0
    weight = np.zeros(len(run.most), np.int64)
    for query, (a, b) in enumerate(zip(np.append(0, queries.ends[:-1]).tolist(), queries.ends.tolist())):
        held = place[a:b] >= 0
        local, w = place[a:b][held], queries.weights[queries.terms[a:b][held]]
        if not len(local):
            continue
        bound = w @ run.most[local]
        weight[local] = w
        for block in np.argsort(-bound, kind="stable").tolist():
            if bound[block] < best.least(query):
                break
            scored += 1
            scores = run.scores(block, weight)
            for at in np.flatnonzero(scores >= best.least(query)).tolist():
                best.offer(query, int(scores[at]), run.ids[block][at])
        weight[local] = 0
    return scored


def searched(index: DataFrame, queries: Queries, documents: int, total: int, k: int) -> DataFrame:
    """(item, doc, score): each task's k best of every query."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, blocks, held = Best(len(queries.items), k), [], 0
        for batch in batches:
            for row in range(len(batch)):
                ids, *rest = (batch.column(c)[row] for c in range(5))
                blocks.append((ids.as_py(), *(x.values.to_numpy(zero_copy_only=False) for x in rest)))
                held += len(blocks[-1][3])
                if held >= RUN_TERMS:
                    search_run(Run(blocks, queries.size, documents, total), queries, best)
                    blocks, held = [], 0
        if blocks:
            search_run(Run(blocks, queries.size, documents, total), queries, best)
        rows = [(item, -low if known else None, score) for item, heap in zip(queries.items, best.heaps) for score, known, low in heap]
        columns = list(zip(*rows)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item", "doc", "score"])

    return index.mapInArrow(search, "item long, doc long, score long")


def weight_of(documents: int, held: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * held + 1)))


def ranked(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item id, rank, document id and score of the k best documents of every query, by saturated counts weighted with rarity."""
    spark = docs.sparkSession
    grouped, groups = queries_by_group(items, item_col, item_text_col)
    grouped, found = durable(grouped), []
    for part in range(groups):
        asked = [(r["item"], [bytes(t) for t in r["terms"]]) for r in grouped.where(F.col("part") == part).orderBy("item").collect()]
        vocabulary = sorted({t for _, ts in asked for t in ts})
        place = {t: n for n, t in enumerate(vocabulary)}
        index = durable(indexed(docs, vocabulary, id_col, text_col))
        all_ = index.agg(F.sum(F.size(F.filter("sizes", lambda n: n > 0))), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, n: a + n))).first()
        documents, total = all_[0] or 0, all_[1] or 0
        if not total:
            continue
        weights = np.zeros(len(vocabulary), np.int64)
        for term, held in index.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect():  # at most the group's vocabulary
            weights[term] = weight_of(documents, held)
        queries = Queries([(i, [place[t] for t in ts]) for i, ts in asked], weights)
        found.append(searched(index, queries, documents, total, k))
    kinds = T.StructType([T.StructField(n, T.LongType()) for n in ("item", "doc", "score")])
    every = reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], kinds)
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc")))
    return every.withColumn("rank", place).where(F.col("rank") <= k).select(F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score")


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents), q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark),
    s AS (SELECT count(*) FILTER (len(ts) > 0) AS n, sum(len(ts))::BIGINT AS l FROM d), p AS (SELECT r, unnest(ts) AS t FROM d),
    f AS (SELECT r, t, count(*) AS tf FROM p GROUP BY r, t), w AS (SELECT t, floor(1000 * ln((2 * any_value(s.n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f, s GROUP BY t),
    m AS (SELECT r, doc_id, 50 + (50 * len(ts) * s.n) // s.l AS m FROM d, s WHERE len(ts) > 0),
    x AS (SELECT q.item_id, m.r, m.doc_id, sum(w.w * ((1000000000 * f.tf) // (1000 * f.tf + 20 * m.m)))::BIGINT AS score FROM q JOIN w USING (t) JOIN f USING (t) JOIN m ON m.r = f.r GROUP BY ALL),
    k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM x WHERE score > 0)
    SELECT * FROM k WHERE rank <= 50"""
