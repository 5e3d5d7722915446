"""SimHash near-duplicates by covering locality-sensitive hashing.

Each bit position gets a non-zero vector of radius + 1 bits; each non-zero vector v of that length gives a table,
whose mask holds the positions with an odd product with v. Fewer than radius + 1 differing positions always leave
some v orthogonal to all of them, so every pair within the radius has equal masked bits in some table.

Equal fingerprints are merged before that, so copies cost one row. Buckets are dealt by hash into blocks of about
BLOCK rows, and pairs of blocks meet in tiles of their own; a tile returns a spanning forest of its links, not the
links. The forests meet in alternating star contraction, whose rounds are cut by checkpoints. Rows of hot buckets,
of hot fingerprints and of giant classes are joined where they are, without a shuffle by their key.

Defined results: words are runs of other than ASCII blanks, A-Z in lower case; fewer words than a shingle make one
shingle; a text without words, or a null one, has fingerprint zero and is linked like any other. The class of a row
is the smallest id reachable; null ids are no candidates for it (null, if there is no other). Repeated rows each
get a row; other columns are not read by `fingerprinted` and `linked`, and pass through `deduplicated`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skerry.llm.arrow_text import sliced
from skerry.operators.graphs import components
from skerry.operators.hot_keys import hot_join
from skerry.session import durable

BITS = 64
BLOCK, TILE = 2_048, 256


def shingle_hashes(text: bytes, width: int, seed: int) -> list[int]:
    """XXH64 of every shingle of a text."""
    words = text.lower().split()
    if not words:
        return []
    body = b" ".join(words)
    if len(words) < width:
        return [xxhash.xxh64_intdigest(body, seed)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.append(0, ends[:-1]).tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(body[a:b], seed) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One word per run of `counts` hashes: bits set in over half of them; zero for an empty run."""
    out = np.zeros((len(counts), BITS), np.uint8)
    full = np.flatnonzero(counts)
    if len(full):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ends = np.cumsum(counts[full])
        ones = np.add.reduceat(bits, ends - counts[full], axis=0, dtype=np.int64)
        out[full] = 2 * ones > counts[full][:, None]
    return np.packbits(out, axis=1, bitorder="little").view("<u8").reshape(-1)


def fingerprinted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """id and the 64-bit fingerprint (as a long) of each row."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1, 1 << 20):
            hashes = [shingle_hashes((t.as_py() or "").encode(), width, seed) for t in batch.column(1)]
            counts = np.fromiter(map(len, hashes), np.int64, len(hashes))
            flat = np.fromiter((h for hs in hashes for h in hs), np.uint64, int(counts.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(majority(flat, counts).view(np.int64))], names=[id_col, "fp"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])
    return docs.select(id_col, text_col).mapInArrow(prints, schema)


def covering_masks(radius: int) -> list[int]:
    """Masks (as signed longs) of the 2^(radius+1) - 1 tables."""
    vectors = (1 << radius + 1) - 1
    masks = []
    for v in range(1, vectors + 1):
        m = sum(1 << i for i in range(BITS) if ((1 + i % vectors) & v).bit_count() % 2)
        masks.append(m - (1 << BITS) if m >> BITS - 1 else m)
    return masks


def _forest(a: np.ndarray, b: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Spanning forest of the links between two blocks, or within one; each row of the tile is looked at once."""
    other = a if b is None else b
    near = np.empty((len(a), len(other)), bool)
    for s in range(0, len(a), TILE):
        near[s : s + TILE] = np.bitwise_count((a[s : s + TILE, None] ^ other[None, :]).view(np.uint64)) <= radius
    if b is None:
        np.fill_diagonal(near, False)
    across = near if b is None else np.ascontiguousarray(near.T)
    free = [np.ones(len(a), bool)] if b is None else [np.ones(len(a), bool), np.ones(len(b), bool)]
    sides = [(near, a, free[0], other, free[-1]), (across, other, free[-1], a, free[0])]
    out: list[tuple[int, int]] = []
    for first in np.flatnonzero(near.any(axis=1)).tolist():
        if not free[0][first]:
            continue
        free[0][first] = False
        waiting = [(0, first)]
        while waiting:
            side, x = waiting.pop()
            rows, own, _, met, open_ = sides[side]
            found = np.flatnonzero(rows[x] & open_)
            open_[found] = False
            out += zip([int(own[x])] * len(found), met[found].tolist())
            waiting += [(1 - side, y) for y in found.tolist()]
    return out


def links(prints: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b) edges that connect all distinct fingerprints (column fp) within the radius of each other."""
    tables = F.array(*(F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(covering_masks(radius))))
    one = durable(prints.select("fp").distinct())
    keyed = one.select("fp", F.inline(tables))
    sizes = durable(keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"))
    parts = F.ceil(F.col("n") / BLOCK)
    sized = hot_join(keyed, sizes, ["t", "key"], one.count() * len(covering_masks(radius)))
    block = F.when(F.col("n") > BLOCK, F.pmod(F.xxhash64("fp"), parts)).otherwise(0).cast("int")
    blocks = durable(sized.groupBy("t", "key", "n", block.alias("block")).agg(F.collect_list("fp").alias("fps")))
    # The blocks of a large bucket meet two by two, each pair under a key of its own.
    others = F.explode(F.filter(F.sequence(F.lit(0), (parts - 1).cast("int")), lambda o: o != F.col("block"))).alias("o")
    meeting = blocks.where(F.col("n") > BLOCK).select("t", "key", "block", "fps", others)
    pair = ["t", "key", F.least("block", "o").alias("x"), F.greatest("block", "o").alias("y")]
    across = meeting.groupBy(*pair).agg(F.collect_list("fps").alias("both")).where(F.size("both") == 2)
    tiles = across.select(F.col("both")[0].alias("left"), F.col("both")[1].alias("right"))
    tiles = tiles.unionAll(blocks.select(F.col("fps").alias("left"), F.lit(None).cast("array<long>").alias("right")))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for left, right in zip(batch.column(0), batch.column(1)):
                found += _forest(left.values.to_numpy(), None if right.values is None else right.values.to_numpy(), radius)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found) if found else ([], []))], names=["a", "b"])

    return tiles.mapInArrow(compared, "a long, b long").distinct()


def classes(prints: DataFrame, radius: int = 3, id_col: str = "doc_id") -> DataFrame:
    """(fp, n, component_id) for each distinct fingerprint of (id, fp), with its number of rows."""
    lowest = prints.groupBy("fp").agg(F.min(id_col).alias("least_id"), F.count("*").alias("n"))
    roots = components(links(prints, radius)).select(F.col("node").alias("fp"), "root")
    rooted = durable(lowest.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    ids = durable(rooted.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("held")))
    return hot_join(rooted, ids, ["root"], rooted.count(), "held").select("fp", "n", "component_id")


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def linked(docs: DataFrame, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint (hexadecimal) and component_id of each row."""
    prints = durable(fingerprinted(docs, id_col, text_col))
    met = hot_join(prints, durable(classes(prints, radius, id_col)), ["fp"], prints.count())
    return met.select(id_col, hexed(F.col("fp")).alias("fingerprint"), "component_id")


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind)
    return _hashable(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, (T.MapType, T.VariantType))


def row_hash(docs: DataFrame) -> Column:
    """Hash of all columns of a row; maps, which Spark does not hash, by their JSON."""
    whole = lambda f: F.col(f"`{f.name}`")
    return F.xxhash64(*(whole(f) if _hashable(f.dataType) else F.to_json(F.struct(whole(f))) for f in docs.schema))


def deduplicated(docs: DataFrame, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each class: the row of its smallest id (of equal ids: one of the smallest row hash).

    Rows without an id are judged by their fingerprints too, and stay only where no row of the class has an id.
    Columns of any name and type pass through, since a row is kept as one struct beside its key.
    """
    # A struct orders by id, then hash; nulls would come first, so a flag goes before them.
    key = F.struct(F.col(id_col).isNull().alias("absent"), F.col(id_col).alias("id"), row_hash(docs).alias("hash"))
    keyed = docs.select(F.struct("*").alias("row"), key.alias("key"), F.col(text_col).alias("text"))
    prints = durable(fingerprinted(keyed, "key", "text"))
    chosen = classes(prints, radius, "key").select(F.col("component_id").alias("best")).distinct()
    repeated = durable(prints.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("best")))
    # The flag and the hash are never null, and an id that is null equals another such.
    same = lambda other: (keyed["key.hash"] == other["best.hash"]) & keyed["key.id"].eqNullSafe(other["best.id"])
    kept = keyed.join(chosen, same(chosen), "left_semi").select("key", "row")
    if not repeated.isEmpty():  # only rows that are equal in every column go through another shuffle
        same = lambda other: (kept["key.hash"] == other["best.hash"]) & kept["key.id"].eqNullSafe(other["best.id"])
        again = kept.join(repeated, same(repeated), "left_semi").select("key.*", "row").dropDuplicates(["absent", "id", "hash"]).select("row")
        return kept.join(repeated, same(repeated), "left_anti").select("row").unionAll(again).select("row.*")
    return kept.select("row.*")
