"""Graph refinement, vocabularies and sparse products over long tables; small graphs per record inside tasks."""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skerry.operators.hot_keys import hot_join
from skerry.session import durable


def bonds(atoms: DataFrame, radii: dict[int, float], scale: float = 1.2, default: float = 1.5) -> DataFrame:
    """(gidx, i, j, r), both directions: atoms (gidx, i, z, px, py, pz) bonded iff 1e-8 < r < scale (R_i + R_j)."""
    known = F.create_map(*(F.lit(x) for pair in radii.items() for x in pair))
    one = atoms.withColumn("radius", F.coalesce(F.try_element_at(known, "z"), F.lit(default)))
    a, b = (one.select("gidx", *(F.col(c).alias(f"{s}_{c}") for c in ("i", "px", "py", "pz", "radius"))) for s in ("a", "b"))
    d = lambda c: F.pow(F.col(f"a_{c}") - F.col(f"b_{c}"), 2)
    near = a.join(b, "gidx").where("a_i <> b_i").withColumn("r", F.sqrt(d("px") + d("py") + d("pz")))
    near = near.where((F.col("r") > 1e-8) & (F.col("r") < scale * (F.col("a_radius") + F.col("b_radius"))))
    return near.select("gidx", F.col("a_i").alias("i"), F.col("b_i").alias("j"), "r")


def bonds_by_scale(atoms: DataFrame, radii: dict[int, float], scales: list[float], default: float = 1.5) -> DataFrame:
    """(gidx, i, j, r, scale): the bonds of every scale from one pass over the distances, those of the largest."""
    known = F.create_map(*(F.lit(x) for pair in radii.items() for x in pair))
    radius = atoms.select("gidx", "i", F.coalesce(F.try_element_at(known, "z"), F.lit(default)).alias("radius"))
    near = bonds(atoms, radii, max(scales), default).join(radius, ["gidx", "i"]).join(radius.select("gidx", F.col("i").alias("j"), F.col("radius").alias("other")), ["gidx", "j"])
    held = F.filter(F.array(*map(F.lit, scales)), lambda s: F.col("r") < s * (F.col("radius") + F.col("other")))
    return near.select("gidx", "i", "j", "r", F.explode(held).alias("scale"))


def fragments(atoms: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, atoms, bonds, fragments, largest, contact: the pieces of each record and the least distance between two of them (null for one piece).

    A record is a small graph; its atoms (i, px, py, pz) and edges, both directions of (i, j), come together in one row.
    """
    n = atoms.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i", "px", "py", "pz"))).alias("nodes"))
    e = edges.groupBy(*keys).agg(F.collect_list(F.struct("i", "j")).alias("edges"))
    whole = n.join(e, keys, "left").select(*keys, "nodes", "edges")

    def pieces(batches):
        for batch in batches:
            rows = []
            for nodes, pairs in zip(batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1).to_pylist()):
                place = {a["i"]: k for k, a in enumerate(nodes)}
                near: list[list[int]] = [[] for _ in nodes]
                for p in pairs or []:
                    near[place[p["i"]]].append(place[p["j"]])
                piece = np.array(bridges_of(len(nodes), near)[0])
                at = np.array([[a["px"], a["py"], a["pz"]] for a in nodes], float)
                apart = piece[:, None] != piece[None, :]
                d = np.sqrt(((at[:, None] - at[None]) ** 2).sum(-1))
                sizes = np.unique(piece, return_counts=True)[1]
                rows.append((len(nodes), sum(map(len, near)) // 2, len(sizes), int(sizes.max()), float(d[apart].min()) if apart.any() else None))
            columns = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64()] * 4 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[*keys, *names])

    names = ["atoms", "bonds", "fragments", "largest", "contact"]
    fields = [whole.schema[k] for k in keys] + [T.StructField(x, T.LongType()) for x in names[:4]] + [T.StructField("contact", T.DoubleType())]
    return whole.mapInArrow(pieces, T.StructType(fields))


def gathered(nodes: DataFrame, edges: DataFrame, edge_label: str | None = None) -> DataFrame:
    """(gidx, nodes, edges): the nodes (i, label) of a record in order and its edges (i, j, kind), a row a record."""
    own = nodes.groupBy("gidx").agg(F.sort_array(F.collect_list(F.struct("i", "label"))).alias("nodes"))
    kind = F.lit(None).cast("string") if edge_label is None else F.col(edge_label).cast("string")
    links = edges.groupBy("gidx").agg(F.collect_list(F.struct("i", "j", kind.alias("kind"))).alias("edges"))
    return own.join(links, "gidx", "left").select("gidx", "nodes", "edges")


def rounds(records: DataFrame, depth: int, kinds: bool = False) -> DataFrame:
    """(gidx, ids, l0, l1, ...): each round hashes a label with its sorted neighbours' labels, and with the kinds of their edges if asked.

    A record is a small graph: all rounds are taken inside its row.
    """
    places = F.transform("edges", lambda e: F.struct(e["i"].alias("i"), F.array_position(F.col("nodes.i"), e["j"]).alias("at"), e["kind"].alias("kind")))
    near = F.transform("nodes", lambda n: F.filter("places", lambda e: (e["i"] == n["i"]) & (e["at"] > 0)))
    rows = records.withColumn("places", F.coalesce(places, F.array())).select("gidx", F.col("nodes.i").alias("ids"), near.alias("near"), F.col("nodes.label").alias("l0"))

    def heard(last: str) -> Column:
        told = lambda e: F.concat_ws("~", e["kind"], F.element_at(last, e["at"].cast("int"))) if kinds else F.element_at(last, e["at"].cast("int"))
        return F.transform("near", lambda x, k: F.md5(F.concat(F.get(last, k), F.lit("|"), F.array_join(F.array_sort(F.transform(x, told)), ","))))

    for k in range(1, depth + 1):
        rows = rows.withColumn(f"l{k}", heard(f"l{k - 1}"))
    return rows.drop("near")


def _by_depth(rows: DataFrame) -> Column:
    return F.array(*(c for c in rows.columns if c not in ("gidx", "ids")))


def long_labels(rows: DataFrame) -> DataFrame:
    """(gidx, i, depth, label) of rows of `rounds`."""
    each = rows.select("gidx", F.col("ids").alias("i"), F.posexplode(_by_depth(rows)).alias("depth", "label"))
    return each.select("gidx", "depth", F.inline(F.arrays_zip("i", "label"))).select("gidx", "i", "depth", "label")


def counted(values: Column, name: str) -> Column:
    """(name, cnt) of the distinct values of an array, counted in its row."""
    return F.transform(F.array_distinct(values), lambda x: F.struct(x.alias(name), F.size(F.filter(values, lambda y: y.eqNullSafe(x))).cast("double").alias("cnt")))


def row_counts(rows: DataFrame, normalise: bool = False) -> DataFrame:
    """What `label_counts` gives, of rows of `rounds`: a record's labels are counted in its row, without a shuffle."""
    each = rows.select("gidx", F.size("ids").alias("n"), F.posexplode(_by_depth(rows)).alias("depth", "held"))
    each = each.select("gidx", "n", "depth", F.inline(counted(F.col("held"), "label")))
    return each.select("gidx", "depth", "label", F.col("cnt") / F.col("n") if normalise else F.col("cnt")).toDF("gidx", "depth", "label", "cnt")


def row_slots(rows: DataFrame, slot: Callable[[Column], Column], name: str) -> DataFrame:
    """(gidx, name, value): the share of labels of all depths by slot, to the number of nodes."""
    each = rows.select("gidx", F.size("ids").alias("n"), F.transform(F.flatten(_by_depth(rows)), slot).alias("held"))
    each = each.select("gidx", "n", F.inline(counted(F.col("held"), name)))
    return each.select("gidx", name, (F.col("cnt") / F.col("n")).alias("value"))


def refine(nodes: DataFrame, edges: DataFrame, depth: int, edge_label: str | None = None) -> DataFrame:
    """(gidx, i, depth, label) for depths 0 to `depth`, by `rounds`."""
    return long_labels(rounds(gathered(nodes, edges, edge_label), depth, edge_label is not None))


def multiset_hash(labels: DataFrame) -> DataFrame:
    """(gidx, depth, hash) of the sorted labels of a record at each depth."""
    return labels.groupBy("gidx", "depth").agg(F.md5(F.array_join(F.array_sort(F.collect_list("label")), ",")).alias("hash"))


def label_counts(labels: DataFrame, normalise: bool = False) -> DataFrame:
    """(gidx, depth, label, cnt), by number of nodes if normalised."""
    c = labels.groupBy("gidx", "depth", "label").agg(F.count("*").cast("double").alias("cnt"))
    if not normalise:
        return c
    n = labels.where("depth = 0").groupBy("gidx").agg(F.count("*").alias("n"))
    return c.join(n, "gidx").select("gidx", "depth", "label", (F.col("cnt") / F.col("n")).alias("cnt"))


def vocabulary(counts: DataFrame, least: int) -> DataFrame:
    """(depth, label, doc_freq) of labels in at least `least` records."""
    return counts.groupBy("depth", "label").agg(F.count_distinct("gidx").alias("doc_freq")).where(F.col("doc_freq") >= least)


def oov(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """Share of (record, label) entries outside the vocabulary, and of their counts."""
    marked = counts.join(vocab.select("depth", "label", F.lit(1).alias("known")), ["depth", "label"], "left")
    missing = F.col("known").isNull()
    return marked.agg(F.avg(missing.cast("int")).alias("entries"), (F.sum(F.when(missing, F.col("cnt")).otherwise(0.0)) / F.sum("cnt")).alias("mass"))


def bond_types(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(gidx, bond, n) with labels of either end sorted, each bond once."""
    e = edges.where("i < j").join(nodes.select("gidx", "i", F.col("label").alias("a")), ["gidx", "i"]).join(nodes.select("gidx", F.col("i").alias("j"), F.col("label").alias("b")), ["gidx", "j"])
    return e.groupBy("gidx", F.concat_ws("-", F.least("a", "b"), F.greatest("a", "b")).alias("bond")).agg(F.count("*").alias("n"))


def angles(edges: DataFrame) -> DataFrame:
    """(gidx, i, centre, k) with i < k: pairs of neighbours of each centre."""
    a, b = edges.select("gidx", F.col("i").alias("centre"), F.col("j").alias("a")), edges.select("gidx", F.col("i").alias("centre"), F.col("j").alias("b"))
    return a.join(b, ["gidx", "centre"]).where("a < b").select("gidx", F.col("a").alias("i"), "centre", F.col("b").alias("k"))


def dihedrals(edges: DataFrame) -> DataFrame:
    """(gidx, i, j, k, l) over each middle bond j < k, with i not k, l not j, and i not l."""
    mid = edges.where("i < j").select("gidx", F.col("i").alias("b"), F.col("j").alias("c"))
    left = edges.select("gidx", F.col("i").alias("b"), F.col("j").alias("a"))
    right = edges.select("gidx", F.col("i").alias("c"), F.col("j").alias("d"))
    path = mid.join(left, ["gidx", "b"]).where("a <> c").join(right, ["gidx", "c"]).where("d <> b AND d <> a")
    return path.select("gidx", F.col("a").alias("i"), F.col("b").alias("j"), F.col("c").alias("k"), F.col("d").alias("l"))


def nonbonded(atoms: DataFrame, edges: DataFrame) -> DataFrame:
    """(gidx, i, j), i < j, that are neither bonded nor share a neighbour."""
    a, b = atoms.select("gidx", "i"), atoms.select("gidx", F.col("i").alias("j"))
    every = a.join(b, "gidx").where("i < j")
    two = angles(edges).select("gidx", "i", F.col("k").alias("j"))
    return every.join(edges.select("gidx", "i", "j").unionByName(two), ["gidx", "i", "j"], "left_anti")


def bridges_of(n: int, adjacent: list[list[int]]) -> tuple[list[int], list[tuple[int, int]]]:
    """Component of each node and the bridges of a small graph."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 4 * n + 100))
    seen, low, component, found = [-1] * n, [0] * n, [-1] * n, []
    clock = 0

    def visit(x: int, parent: int, mark: int) -> None:
        nonlocal clock
        seen[x] = low[x] = clock
        clock += 1
        component[x] = mark
        skipped = False
        for y in adjacent[x]:
            if y == parent and not skipped:
                skipped = True
            elif seen[y] >= 0:
                low[x] = min(low[x], seen[y])
            else:
                visit(y, x, mark)
                low[x] = min(low[x], low[y])
                if low[y] > seen[x]:
                    found.append((min(x, y), max(x, y)))

    for x in range(n):
        if seen[x] < 0:
            visit(x, -1, x)
    return component, found


def topology(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per record: atoms, bonds, components, largest component, rings (E - V + C), bridges, rotatable bonds.

    A record's graph is small (a molecule); it is gathered as one row and walked in its task.
    """
    n = nodes.groupBy("gidx").agg(F.sort_array(F.collect_list("i")).alias("ids"))
    e = edges.where("i < j").groupBy("gidx").agg(F.collect_list(F.struct("i", "j")).alias("bonds"))

    def walk(batches):
        for batch in batches:
            rows = []
            for ids, bonds_ in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                place = {x: k for k, x in enumerate(ids)}
                near: list[list[int]] = [[] for _ in ids]
                for b in bonds_ or []:
                    near[place[b["i"]]].append(place[b["j"]])
                    near[place[b["j"]]].append(place[b["i"]])
                component, cut = bridges_of(len(ids), near)
                sizes = {c: component.count(c) for c in set(component)}
                m = sum(map(len, near)) // 2
                turn = sum(len(near[x]) >= 2 and len(near[y]) >= 2 for x, y in cut)
                rows.append((len(ids), m, len(sizes), max(sizes.values(), default=0), m - len(ids) + len(sizes), len(cut), turn))
            columns = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=names)

    names = ["gidx", "atoms", "bonds", "components", "largest", "rings", "bridges", "rotatable"]
    return n.join(e, "gidx", "left").select("gidx", "ids", "bonds").mapInArrow(walk, ", ".join(f"{x} long" for x in names))


def split_families(hashes: DataFrame, family: Column) -> DataFrame:
    """Share of families of two or more records whose hashes differ, per depth."""
    f = hashes.withColumn("family", family).groupBy("depth", "family").agg(F.count("*").alias("m"), F.count_distinct("hash").alias("k")).where("m >= 2")
    return f.groupBy("depth").agg(F.count("*").alias("families"), F.avg((F.col("k") > 1).cast("int")).alias("split"))


def cooccurrence(presence: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(a, b, n), a <= b: records that hold both labels."""
    p = presence.select(id_col, label_col).distinct()
    a, b = p.withColumnRenamed(label_col, "a"), p.withColumnRenamed(label_col, "b")
    return a.join(b, id_col).where("a <= b").groupBy("a", "b").agg(F.count("*").alias("n"))


def in_order(labels: DataFrame) -> DataFrame:
    """Vocabulary columns: a dense place by depth and label; the vocabulary is bounded by its least frequency."""
    return labels.withColumn("col", F.row_number().over(Window.orderBy("depth", "label")) - 1)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for each node of the edges (a, b); alternating large and small stars.

    The edges of a giant star's centre stay where they are: its minimum is broadcast (see hot_keys).
    """
    smaller, larger = F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")
    now = durable(edges.where("a <> b").select(larger, smaller).distinct())  # u > v
    state, size = None, now.count()
    while True:
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = hot_join(both.where("v > u"), lowest, ["u"], 2 * size).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = hot_join(large, lowest, ["u"], 2 * size)
        now = durable(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(lowest.select("u", F.col("m").alias("v"))).distinct())
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state, size = seen, seen[0]
