"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern, the set of sources they belong to. A flow network leads from the
patterns (capacity: their size for each copy) to the sources (capacity: their quota); a pattern's n-th copy costs
n - 1 a word, a convex cost, so that the flow repeats as little as the quotas allow. The flow's share of a pattern is
a run of words on the line of its documents in seeded order, copy after copy; a document's copy is taken if its
middle lies in the run, and belongs to the source whose part of the run that is. All that documents need for this is
a hash threshold for each pattern and source, so the last pass reads each document alone, without a shuffle.

Only pattern totals and thresholds come to the driver; more patterns than MOST_PATTERNS raise an error. Thresholds
are found by sums over ever smaller ranges of hashes, the last of which is sorted.

Defined results: a null text has size zero; a null source is a source of its own and sorts last; documents of size
zero are never taken; rows that are equal in id and text share their hash and so their fate; null ids are hashed as
such; an empty table gives an empty mix; other columns are not read by `mixed` and pass through `drawn`.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.session import durable

MOST_PATTERNS = 100_000
SORTED_TOGETHER, LEVEL_BITS = 64, 8
MOST_COPIES = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def capped_shares(sizes: dict, weights: dict, total: float, most: float = MOST_COPIES) -> dict:
    """Targets that share the total by weight, none above `most` times its size; the excess is shared again by weight."""
    target, left, open_ = {}, float(total), sorted(sizes, key=lambda s: (s is None, s or ""))
    while open_:
        unit = left / sum(weights[s] for s in open_)
        full = [s for s in open_ if unit * weights[s] > most * sizes[s]]
        if not full:
            target |= {s: unit * weights[s] for s in open_}
            break
        for s in full:
            target[s] = float(most * sizes[s])
            left -= target[s]
        open_ = [s for s in open_ if s not in target]
    return target


def cyclic_weights(sources: list) -> dict:
    """Sources by code point, null last, weigh 1, 2, 3, repeating."""
    return {s: 1 + i % 3 for i, s in enumerate(sorted(sources, key=lambda s: (s is None, s or "")))}


def min_cost_flow(patterns: list[tuple[tuple, int]], quotas: dict, most: int = MOST_COPIES) -> list[dict]:
    """Words that each pattern (sources, size) gives to each of its sources: the largest flow of least repetition."""
    names = {s: i for i, s in enumerate(quotas)}
    start, end = 0, 1
    node_of = lambda s: 2 + len(patterns) + names[s]
    heads: list[list[int]] = [[] for _ in range(2 + len(patterns) + len(names))]
    to, room, cost = [], [], []

    def arc(a: int, b: int, capacity: int, price: int) -> int:
        for x, y, c, p in ((a, b, capacity, price), (b, a, 0, -price)):
            heads[x].append(len(to))
            to.append(y)
            room.append(c)
            cost.append(p)
        return len(to) - 2

    gives = []
    for i, (sources, size) in enumerate(patterns):
        for copy in range(most):
            arc(start, 2 + i, size, copy)
        gives.append({s: arc(2 + i, node_of(s), most * size, 0) for s in sources})
    for s, quota in quotas.items():
        arc(node_of(s), end, quota, 0)

    while True:
        price = [None] * len(heads)
        price[start], waiting, queued = 0, deque([start]), {start}
        while waiting:
            x = waiting.popleft()
            queued.discard(x)
            for e in heads[x]:
                if room[e] and (price[to[e]] is None or price[x] + cost[e] < price[to[e]]):
                    price[to[e]] = price[x] + cost[e]
                    if to[e] not in queued:
                        queued.add(to[e])
                        waiting.append(to[e])
        if price[end] is None:
            break
        while True:  # blocking flows over the arcs of least-cost paths
            level, waiting = {start: 0}, deque([start])
            while waiting:
                x = waiting.popleft()
                for e in heads[x]:
                    y = to[e]
                    if room[e] and y not in level and price[y] is not None and price[x] + cost[e] == price[y]:
                        level[y] = level[x] + 1
                        waiting.append(y)
            if end not in level:
                break
            at = [0] * len(heads)
            path: list[int] = []
            x = start
            while True:
                if x == end:
                    least = min(room[e] for e in path)
                    for e in path:
                        room[e] -= least
                        room[e ^ 1] += least
                    cut = next(i for i, e in enumerate(path) if not room[e])
                    del path[cut + 1 :]
                    x = to[path.pop() ^ 1]
                    continue
                while at[x] < len(heads[x]):
                    e = heads[x][at[x]]
                    if room[e] and level.get(to[e]) == level[x] + 1 and price[x] + cost[e] == price[to[e]]:
                        break
                    at[x] += 1
                if at[x] < len(heads[x]):
                    path.append(heads[x][at[x]])
                    x = to[path[-1]]
                elif path:
                    at[x := to[path.pop() ^ 1]] += 1
                else:
                    break
    return [{s: room[e ^ 1] for s, e in given.items()} for given in gives]


def _keyed(docs: DataFrame, id_col: str, text_col: str, members: Column, seed: int, *more: Column) -> DataFrame:
    """Pattern key p, hash h and size of each document, and more columns."""
    pattern = F.to_json(F.array_sort(F.array_distinct(F.coalesce(members, F.array()))))
    return docs.select(pattern.alias("p"), F.xxhash64(F.lit(seed), id_col, text_col).alias("h"), n_words(F.col(text_col)).alias("size"), *more)


def _thresholds(narrow: DataFrame, wanted: list[tuple[str, int, int]], n: int) -> dict[tuple[str, int], int]:
    """For each cut (p, k, rest): the first hash of a document of p whose middle lies at or beyond `rest` on p's line.

    The range of hashes that holds a cut is halved LEVEL_BITS times at once, by sums over its parts, until it holds
    about SORTED_TOGETHER documents. So no task sums or sorts more than 2^LEVEL_BITS parts or those few documents of a
    cut, however large a pattern is. Equal hashes are equal documents and count together.
    """
    spark = narrow.sparkSession
    names = "p string, k int, rest long, range long, base long"
    at, bits = [(p, k, rest, 0, 0) for p, k, rest in wanted], 0
    top = lambda bits: F.shiftright("h", 64 - bits) if bits else F.lit(0).cast("long")

    def inside() -> DataFrame:
        """Documents in the ranges that hold cuts."""
        ranges = spark.createDataFrame(sorted({(r[0], r[3]) for r in at}), "p string, range long")
        return narrow.withColumn("range", top(bits)).join(F.broadcast(ranges), ["p", "range"])  # a row a cut at most

    while at and n >> bits > SORTED_TOGETHER and bits < 60:
        within, bits = inside(), bits + LEVEL_BITS
        sums = within.groupBy("p", "range", top(bits).alias("part")).agg(F.sum("size").alias("size"))
        upto = F.sum("size").over(Window.partitionBy("p", "range").orderBy("part"))
        met = sums.withColumn("upto", upto).join(F.broadcast(spark.createDataFrame(at, names)), ["p", "range"])
        upto = F.col("base") + F.col("upto")
        hit = met.where((upto - F.col("size") <= F.col("rest")) & (F.col("rest") < upto))
        at = [tuple(r) for r in hit.select("p", "k", "rest", "part", upto - F.col("size")).collect()]
    if not at:
        return {}
    each = inside().groupBy("p", "range", "h").agg(F.sum("size").alias("size"))
    run = F.sum("size").over(Window.partitionBy("p", "range").orderBy("h"))
    met = each.withColumn("middle", run - F.col("size") / 2).join(F.broadcast(spark.createDataFrame(at, names)), ["p", "range"])
    # Without a middle beyond the cut in the range, all of it lies before.
    beyond = F.col("base") + F.col("middle") >= F.col("rest")
    first = met.groupBy("p", "k").agg(F.min(F.when(beyond, F.col("h"))).alias("h"), F.max("h").alias("last"))
    return {(r["p"], r["k"]): r["h"] if r["h"] is not None else r["last"] + 1 for r in first.collect()}


def _plan(narrow: DataFrame, weights_of: Callable[[list], dict], share: float) -> tuple[DataFrame, DataFrame]:
    """From durable keyed rows. Per pattern: key and cuts (level, threshold, source) in order. Per source: source, source_size, target."""
    spark = narrow.sparkSession
    totals = narrow.groupBy("p").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MOST_PATTERNS + 1).collect()
    if len(totals) > MOST_PATTERNS:
        raise ValueError(f"over {MOST_PATTERNS} membership patterns")
    totals = sorted(totals, key=lambda r: r["p"])
    patterns = [(tuple(json.loads(r["p"])), r["size"]) for r in totals]
    sizes: dict = {}
    for sources, n in patterns:
        for s in sources:
            sizes[s] = sizes.get(s, 0) + n
    target = capped_shares(sizes, weights_of(list(sizes)), share * sum(n for _, n in patterns))
    flows = min_cost_flow(patterns, {s: int(t) for s, t in target.items()})
    ends = [list(accumulate(flow.values())) for flow in flows]
    wanted = [(totals[i]["p"], k, end % size) for i, (_, size) in enumerate(patterns) if size for k, end in enumerate(ends[i]) if end % size]
    found = _thresholds(narrow, wanted, sum(r["n"] for r in totals))

    low = -(1 << 63)
    rows = []
    for i, (_, size) in enumerate(patterns):
        p = totals[i]["p"]
        if size:
            rows.append((p, [(end // size, found[p, k] if end % size else low, s) for k, (end, s) in enumerate(zip(ends[i], flows[i]))]))
    plan = spark.createDataFrame(rows, "p string, cuts array<struct<level:long,h:long,source:string>>")
    stated = spark.createDataFrame([(s, sizes[s], target[s]) for s in sizes], "source string, source_size long, target double")
    return plan, stated


def _drawn_sources(h: Column, cuts: Column) -> Column:
    """The source of each copy taken of a document, at most MOST_COPIES."""
    copy = lambda level: F.filter(cuts, lambda c: (c["level"] > level) | ((c["level"] == level) & (h < c["h"])))
    taken = F.transform(F.sequence(F.lit(0), F.lit(MOST_COPIES - 1)), lambda level: F.slice(copy(level), 1, 1))
    return F.transform(F.flatten(taken), lambda c: c["source"])


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", members: Column | None = None, seed: int = 11, weights_of: Callable[[list], dict] = cyclic_weights, share: float = 1.0) -> DataFrame:
    """id, source (of a single-source pattern), size, source_size, target, taken and the source of each copy taken."""
    members = F.array(F.col("source")) if members is None else members
    narrow = durable(_keyed(docs, id_col, text_col, members, seed, F.get(members, 0).alias("source"), F.col(id_col).alias("id")))
    plan, stated = _plan(narrow, weights_of, share)
    rows = narrow.join(F.broadcast(plan), "p", "left").withColumn("copies", F.when(F.col("size") > 0, _drawn_sources(F.col("h"), F.col("cuts"))).otherwise(F.array().cast("array<string>")))
    stated = F.broadcast(stated.withColumnRenamed("source", "named"))  # both tables have MOST_PATTERNS rows and their members at most
    rows = rows.join(stated, F.col("source").eqNullSafe(F.col("named")), "left")
    taken = (F.col("size") * F.size("copies")).cast("long").alias("taken")
    return rows.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", taken, "copies")


def drawn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", members: Column | None = None, seed: int = 11, weights_of: Callable[[list], dict] = cyclic_weights, share: float = 1.0) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken. A row is one struct meanwhile, so columns of any name pass through."""
    members = F.array(F.col("source")) if members is None else members
    plan, _ = _plan(durable(_keyed(docs, id_col, text_col, members, seed)), weights_of, share)
    rows = _keyed(docs, id_col, text_col, members, seed, F.struct("*").alias("row")).where("size > 0").join(F.broadcast(plan), "p")
    return rows.withColumn("copy", F.explode(_drawn_sources(F.col("h"), F.col("cuts")))).select("row.*")
