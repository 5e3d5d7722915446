"""Nearest neighbours by a block matrix join with int8 product tiles.

Queries and vectors are dealt into groups of bounded size; each pair of groups is one task's work. There, vectors
become int8 codes with a scale and the exact norm of what the codes leave out. A tile product of codes (exact in
float32 while 127^2 times the dimension stays below 2^24) gives every distance up to the two norms. A candidate whose
lower bound exceeds the k-th smallest upper bound cannot be among the k nearest; all others are recomputed in double
precision from the original vectors and merged by heaps. The result is therefore exact, not only likely. Where bounds
leave the range of doubles, everything is recomputed; a distance beyond it is infinite and ranks last.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part; vectors of
another dimension are no candidates; candidates with the query's own id are its own row; repeated equal rows count
once, and are merged before groups are counted and dealt; fewer candidates than k give fewer rows; ties go to the smaller id. Null ids take no part. An empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_ROWS, MOST_ROWS, MOST_BYTES, GROUPS = 4_096, 65_536, 128 << 20, 48
TILE_Q, TILE_C = 512, 4_096
EXACT_PAIRS = 1 << 17


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale and norm of the rest for each row."""
    scale = np.abs(x).max(axis=1) / 127
    scale[scale == 0] = 1.0  # components too small to divide: all codes are zero
    codes = np.clip(np.rint(x / scale[:, None]), -127, 127).astype(np.int8)
    rest = x - codes * scale[:, None]
    with np.errstate(over="ignore"):
        return codes, scale, np.sqrt((rest * rest).sum(axis=1))


def bounds(q: tuple, c: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the distances of all pairs of two quantised blocks; none where they overflow."""
    (qc, qs, qe), (cc, cs, ce) = q, c
    kind = np.float32 if 127 * 127 * qc.shape[1] < 1 << 24 else np.float64
    product = (qc.astype(kind) @ cc.astype(kind).T).astype(np.float64)
    square = lambda codes, scale: scale * scale * (codes.astype(np.int64) ** 2).sum(axis=1)
    with np.errstate(over="ignore", invalid="ignore"):
        d2 = square(qc, qs)[:, None] + square(cc, cs)[None, :] - 2 * product * qs[:, None] * cs[None, :]
        near = np.sqrt(np.maximum(d2, 0))
        slack = (qe[:, None] + ce[None, :]) * (1 + 1e-9) + 1e-7 * (near + qs[:, None] + cs[None, :])
        low, high = near - slack, near + slack
    known = np.isfinite(near) & np.isfinite(slack)
    low[~known], high[~known] = -np.inf, np.inf
    return low, high


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of paired rows, components added in order."""
    total = np.zeros(len(a))
    with np.errstate(over="ignore"):  # a distance beyond the range of doubles is infinite
        for x, y in zip(a.T, b.T):
            total += (x - y) ** 2
    return np.sqrt(total)


class Best:
    """The k nearest so far of each query, as heaps whose top is the farthest."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(queries)]
        self.limit = np.full(queries, np.inf)

    def offer(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(ids) > self.k:
            keep = np.lexsort((ids, scores))[: self.k]
            scores, ids = scores[keep], ids[keep]
        heap = self.heaps[query]
        for score, i in zip(scores.tolist(), ids.tolist()):
            if len(heap) < self.k:
                heapq.heappush(heap, (-score, -i))
            elif (-score, -i) > heap[0]:
                heapq.heapreplace(heap, (-score, -i))
        if len(heap) == self.k:
            self.limit[query] = min(self.limit[query], -heap[0][0])


def nearest_in_group(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> Best:
    best = Best(len(q), k)
    blocks = [(c_ids[s : s + TILE_C], c[s : s + TILE_C], quantised(c[s : s + TILE_C])) for s in range(0, len(c), TILE_C)]
    for s in range(0, len(q), TILE_Q):
        part, own, coded = q[s : s + TILE_Q], q_ids[s : s + TILE_Q], quantised(q[s : s + TILE_Q])
        for ids, rows, codes in blocks:
            low, high = bounds(coded, codes)
            self_row = own[:, None] == ids[None, :]
            low[self_row] = high[self_row] = np.inf
            limit = best.limit[s : s + TILE_Q]
            if len(ids) > k:
                limit = np.minimum(limit, np.partition(high, k - 1, axis=1)[:, k - 1])
            i, j = np.nonzero((low <= limit[:, None]) & ~self_row)
            for a in range(0, len(i), EXACT_PAIRS):
                x, y = i[a : a + EXACT_PAIRS], j[a : a + EXACT_PAIRS]
                scores = exact(part[x], rows[y])
                for query, scored, found in zip(x[(firsts := np.flatnonzero(np.diff(x, prepend=-1)))], np.split(scores, firsts[1:]), np.split(ids[y], firsts[1:])):
                    best.offer(s + int(query), scored, found)
    return best


def _blocks(rows: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension: ids and vectors of the rows, which are distinct, in order."""
    rows = rows.combine_chunks()
    if not rows.num_rows:
        return {}
    vectors = rows.column("vector").chunk(0)
    ids, sizes = rows.column("id").to_numpy(), vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat, ends = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(sizes)
    out = {}
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        x = flat[(ends[at] - n)[:, None] + np.arange(n)[None, :]]
        order = np.lexsort((*x.T[::-1], ids[at]))
        out[int(n)] = (ids[at][order], x[order])
    return out


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows of every query row."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vector"))).groupBy("id", "vector").agg(F.max("asks").alias("asks"))
    sizes = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q"), F.max(F.size("vector")).alias("width")).first()
    most = max(1, min(MOST_ROWS, MOST_BYTES // (8 * (sizes["width"] or 1))))
    c_groups = max(1, -(-sizes["n"] // min(most, max(LEAST_ROWS, sizes["n"] // GROUPS))))
    q_groups = max(1, -(-sizes["q"] // most))
    dealt = lambda n: F.pmod(F.xxhash64("id", "vector"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.select("id", "vector", dealt(c_groups).alias("c"), every(q_groups).alias("q"))
    queries = rows.where("asks").select("id", "vector", dealt(q_groups).alias("q"), every(c_groups).alias("c"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        asked, held = _blocks(left), _blocks(right)
        found = []
        for n, (q_ids, q) in asked.items():
            if n in held:
                best = nearest_in_group(q_ids, q, *held[n], k)
                keys = [zlib.crc32(x.tobytes()) for x in q]
                found += [(int(q_ids[i]), keys[i], -b, -a) for i, heap in enumerate(best.heaps) for a, b in heap]
        columns = list(zip(*found)) or [()] * 4
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "key": pa.array(columns[1], pa.int64()), "vec_id": pa.array(columns[2], pa.int64()), "score": pa.array(columns[3], pa.float64())})

    found = queries.groupBy("c", "q").cogroup(candidates.groupBy("c", "q")).applyInArrow(search, "query_id long, key long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id", "key").orderBy("score", "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
    WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
               WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    d AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.e, c.e), lambda x: (x[1] - x[2]) * (x[1] - x[2])), lambda s, x: s + x)) AS score
          FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank FROM d)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""
