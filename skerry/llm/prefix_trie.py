"""Prefix trie of conversations by preorder intervals.

Conversations are ranked by their sequences of turns, so that those with a common prefix stand side by side. A node of
the trie, a distinct prefix, then opens at the place of its first member and closes after its last. Opening and
closing events are ordered together without a single-task sort; sums over all earlier events, taken block by block,
are differences away from the nodes, leaves and savings of every subtree.

A prefix is known by its depth and the sums of 128-bit hashes (MD5) of its turns with their places, so that prefixes
grow by running sums in blocks and no task holds a conversation. Sequences are ranked in blocks of WIDTH turns, level
by level: ranks of distinct blocks take the place of the blocks until one block holds a conversation.

Defined results: null roles and texts are empty; rows without an id take no part; rows of one conversation are ordered
by turn (null first), then role, the first 64 characters of the text and a hash; repeated rows are turns of their own.
Without conversations there are no nodes. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.operators.hot_keys import hot_join
from skerry.operators.order_stats import earlier_sums
from skerry.operators.sampling import global_places
from skerry.session import durable

WIDTH, BLOCK = 64, 1_024
WORDS = ("s0", "s1", "s2", "s3")
KEY = ("depth", *WORDS)
PARENT = tuple(f"parent_{k}" for k in KEY)


def numbered(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(c, at, digest, size): turns in order; places of a conversation follow one another."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    digest = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))
    rows = conversations.select(F.col(id_col).cast("long").alias("c"), F.col(turn_col).alias("turn"), role.alias("role"), F.substring(text, 1, 64).alias("start"), digest.alias("digest"), F.char_length(text).cast("long").alias("size"))
    return global_places(rows.where("c IS NOT NULL"), ["c", F.col("turn").asc_nulls_first(), "role", "start", "digest"], "at").select("c", "at", "digest", "size")


def rebuilt(turns: DataFrame, base: Column, head: Column, most_head: int) -> tuple[DataFrame, DataFrame]:
    """(c, d, digest, size) and (c, m): each conversation takes the first `head` turns of conversation `base`, then its own later ones.

    `base` and `head` are expressions of c; d counts from 0 and m is the number of turns. A base is named by few conversations.
    """
    total = turns.count()
    own = turns.groupBy("c").agg(F.min("at").alias("first"), F.count("*").alias("n")).withColumns({"b": base, "h": head.cast("long")})
    borrowed = own.select(F.col("c").alias("b"), F.col("n").alias("held"))
    own = own.join(borrowed, "b", "left").withColumn("k", F.least("h", F.coalesce("held", F.lit(0))))
    own = durable(own.select("c", "first", "n", "b", "h", "k", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("m")))
    placed = durable(hot_join(turns, own, ["c"], total).select("c", (F.col("at") - F.col("first")).alias("pos"), "digest", "size", "h", "k"))
    heads = placed.where(F.col("pos") < most_head).select(F.col("c").alias("b"), F.col("pos").alias("d"), "digest", "size")
    taken = own.where("k > 0").select("c", "b", "k").join(heads, "b").where("d < k").select("c", "d", "digest", "size")
    rest = placed.where("pos >= h").select("c", (F.col("pos") - F.col("h") + F.col("k")).alias("d"), "digest", "size")
    return taken.unionByName(rest), own.select("c", "m")


def ranked(items: DataFrame, sizes: DataFrame, length: int) -> DataFrame:
    """(c, place, m): places from 0 in the lexicographic order of the sequences of (c, d, item); sizes are (c, m). Equal sequences go by c."""

    def gathered(block: Column) -> DataFrame:
        kept = F.sort_array(F.collect_list(F.struct("d", "item")))
        return items.groupBy("c", block.alias("block")).agg(F.transform(kept, lambda x: x["item"]).alias("seq"))

    while length > WIDTH:
        blocks = durable(gathered(F.floor(F.col("d") / WIDTH)).withColumn("kind", F.md5(F.to_json(F.struct("seq")))))
        kinds = durable(global_places(blocks.groupBy("kind").agg(F.first("seq").alias("seq"), F.count("*").alias("n")), ["seq"], "item"))
        met = hot_join(blocks.select("c", F.col("block").alias("d"), "kind"), kinds.select("kind", "item", "n"), ["kind"], blocks.count())
        items, length = met.select("c", "d", "item"), -(-length // WIDTH)
    whole = gathered(F.lit(0)).drop("block")
    kind = whole.schema["seq"].dataType
    seqs = sizes.join(whole, "c", "left").select("c", "m", F.coalesce("seq", F.array().cast(kind)).alias("seq"))
    return global_places(seqs, ["seq", "c"], "place").select("c", (F.col("place") - 1).alias("place"), "m")


def digests(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) of (key, c, place): SHA-256 of the ids of each key, ascending and comma-joined.

    Ids of a key are joined in blocks of places first; a task hashes the blocks of its keys as they come.
    """
    blocks = ends.groupBy(*KEY, F.floor(F.col("place") / BLOCK).alias("block")).agg(F.array_join(F.sort_array(F.collect_list("c")).cast("array<string>"), ",").alias("ids"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            rows: list[tuple] = []
            for *key, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if key == now:
                    state.update(b"," + ids.encode())
                    continue
                if now is not None:
                    rows.append((*now, state.hexdigest()))
                now, state = key, hashlib.sha256(ids.encode())
            yield table(rows)
        if now is not None:
            yield table([(*now, state.hexdigest())])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * (len(KEY) + 1)
        kinds = [pa.int64()] * len(KEY) + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[*KEY, "ends_sha256"])

    ordered = blocks.repartition(*KEY).sortWithinPartitions(*KEY, "block").select(*KEY, "ids")
    return ordered.mapInArrow(hashed, ", ".join(f"{k} long" for k in KEY) + ", ends_sha256 string")


def members(turns: DataFrame, sizes: DataFrame, length: int) -> DataFrame:
    """One row for each conversation and depth, 0 included: keys of the prefix and of its parent, the last turn's size, place and m."""
    hashed = F.md5(F.concat_ws(":", F.col("d").cast("string"), F.col("digest")))
    part = lambda k: F.conv(F.substring(hashed, 8 * k + 1, 8), 16, 10).cast("long")
    words = turns.select("c", "d", "size", *(part(k).alias(w) for k, w in enumerate(WORDS)))
    sums = earlier_sums(words, ["c"], "d", list(WORDS), length)
    deeper = sums.select("c", (F.col("d") + 1).alias("depth"), *((F.col(f"before_{w}") + F.col(w)).alias(w) for w in WORDS), F.col("d").alias(PARENT[0]), *(F.col(f"before_{w}").alias(p) for w, p in zip(WORDS, PARENT[1:])), "size")
    none = F.lit(None).cast("long")
    roots = sizes.select("c", *(F.lit(0).cast("long").alias(k) for k in KEY), *(none.alias(p) for p in PARENT), F.lit(0).cast("long").alias("size"))
    return deeper.unionByName(roots)


def trie(conversations: DataFrame, base: Column, head: Column, most_head: int, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, position, subtree_end.

    `base` and `head` say, as expressions of c, with how many turns of which conversation each one starts; `head` is
    at most `most_head`. Position and subtree_end bound the subtree in preorder.
    """
    turns, sizes = rebuilt(numbered(conversations, id_col, turn_col, role_col, text_col), base, head, most_head)
    turns, sizes = durable(turns), durable(sizes)
    seen = sizes.agg(F.coalesce(F.max("m"), F.lit(0)).alias("longest"), F.count("*").alias("convs"), F.coalesce(F.sum("m"), F.lit(0)).alias("turns")).first()
    places = durable(ranked(turns.select("c", "d", F.unhex("digest").alias("item")), sizes, seen["longest"]))
    every = hot_join(members(turns, sizes, seen["longest"]), places, ["c"], seen["turns"] + seen["convs"], "m")
    every = durable(every)
    grouped = every.groupBy(*KEY).agg(F.min("place").alias("place"), F.count("*").alias("n_convs"), F.min("c").alias("conv_id"), F.max("size").alias("size"), *(F.max(p).alias(p) for p in PARENT))
    nodes = durable(grouped.withColumn("node", F.monotonically_increasing_id()))
    count = nodes.count()
    children = nodes.where("depth > 0").groupBy(*(F.col(p).alias(k) for p, k in zip(PARENT, KEY))).agg(F.count("*").alias("n_children"))
    nodes = durable(nodes.join(children, list(KEY), "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))

    opens = nodes.select("place", F.col("depth").alias("rank"), "node", F.lit(1).cast("long").alias("nodes"), (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved"))
    zero = F.lit(0).cast("long")
    closes = nodes.select((F.col("place") + F.col("n_convs")).alias("place"), F.lit(-1).cast("long").alias("rank"), "node", zero.alias("nodes"), zero.alias("leaves"), zero.alias("saved"))
    swept = global_places(opens.unionByName(closes), ["place", "rank", "node"], "at").withColumn("at", F.col("at") - 1)
    sums = earlier_sums(swept, [], "at", ["nodes", "leaves", "saved"], 2 * count)
    opened = F.col("rank") >= 0
    between = lambda v: F.sum(F.when(opened, -F.col(v)).otherwise(F.col(v)))
    subtrees = sums.groupBy("node").agg(between("before_leaves").alias("n_leaves"), between("before_saved").alias("saved_tokens"), F.max(F.when(opened, F.col("before_nodes"))).alias("position"), F.max(F.when(~opened, F.col("before_nodes"))).alias("subtree_end"))

    parents = nodes.where("n_children > 0").select(*(F.col(k).alias(p) for k, p in zip(KEY, PARENT)), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("held"))
    named = hot_join(nodes.where("depth > 0").select("node", *PARENT), parents, list(PARENT), count, "held").select("node", "parent_conv_id")
    empty = hashlib.sha256(b"").hexdigest()
    ends = digests(every.where("depth = m").select(*KEY, "c", "place"))
    out = nodes.join(subtrees, "node").join(named, "node", "left").join(ends, list(KEY), "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"), "position", "subtree_end")


_CRC = "xor(list_reduce(flatten(list_transform(string_split(c::VARCHAR, ''), lambda s: [ord(s)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, 4294967295::BIGINT), 4294967295)"
ORACLE_SQL = f"""
    WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL),
    g AS (SELECT *, len(t) AS n, md5(len(r) || ':' || r || t) AS m FROM t),
    o AS (SELECT c, list(struct_pack(m := m, n := n) ORDER BY turn NULLS FIRST, r, t[:64], m) AS q FROM g GROUP BY c),
    k AS (SELECT c, q, c - c % 100 AS b, {_CRC} % 6 AS h FROM o),
    s AS (SELECT k.c, list_concat(coalesce(o.q[:k.h], []), k.q[k.h + 1:]) AS q FROM k LEFT JOIN o ON o.c = k.b),
    p AS (SELECT c, d, q[:d] AS key, CASE WHEN d > 0 THEN q[d].n ELSE 0 END AS size, d = len(q) AS ends FROM (SELECT c, q, unnest(range(0, len(q) + 1)) AS d FROM s)),
    n AS (SELECT key, any_value(d) AS d, min(c) AS c, count(*) AS n, any_value(size) AS size, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends FROM p GROUP BY key),
    k2 AS (SELECT key[:d - 1] AS key, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
    f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k2 USING (key)),
    u AS (SELECT key[:a] AS key, count(*) FILTER (n_children = 0) AS n_leaves, sum((n - 1) * size)::BIGINT AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM f) GROUP BY 1)
    SELECT f.c AS conv_id, f.d AS depth, p2.c AS parent_conv_id, f.n AS n_convs, f.n_children, u.n_leaves, u.saved AS saved_tokens, f.ends AS ends_sha256
    FROM f JOIN u USING (key) LEFT JOIN n p2 ON f.d > 0 AND p2.key = f.key[:f.d - 1]"""
