"""Deterministic samples: rows are ordered by a seeded hash of their id, so reruns agree and prefixes nest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.operators.hot_keys import hot_join
from skerry.session import durable


def order_key(id_col: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))


def place_in_order(id_col: str, seed: int) -> Column:
    """Place of a row in the seeded order, in [0, 1); rows of equal ids share it."""
    return F.conv(F.substring(order_key(id_col, seed), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def uniform(rows: DataFrame, id_col: str, size: int, seed: int) -> DataFrame:
    """Exactly `size` rows without replacement (all, if fewer): a distributed top-k, no global sort."""
    return rows.orderBy(order_key(id_col, seed), id_col).limit(size)


def stratified_equal(rows: DataFrame, id_col: str, class_col: str, size: int, per: int, seed: int) -> DataFrame:
    """`per` rows of each class first, then rows of any class until `size`."""
    early = places_within(rows, [class_col], [order_key(id_col, seed), id_col], "__early").withColumn("__early", F.col("__early") <= per)
    return early.orderBy(F.desc("__early"), order_key(id_col, seed), id_col).limit(size).drop("__early")


def stratified_share(rows: DataFrame, id_col: str, class_col: str, share: float, floor: int, seed: int) -> DataFrame:
    """A share of each class, at least `floor` rows of it."""
    quota = rows.groupBy(class_col).agg(F.greatest(F.lit(floor), F.ceil(share * F.count("*"))).alias("__quota"))
    return places_within(rows, [class_col], [order_key(id_col, seed), id_col], "__r").join(quota, class_col).where("__r <= __quota").drop("__r", "__quota")


def cluster(rows: DataFrame, id_col: str, group_col: str, size: int, cap: int, least: int, seed: int) -> DataFrame:
    """Whole groups in seeded order until `size` rows are reached, at most `cap` rows of each, small groups left out."""
    groups = rows.groupBy(group_col).agg(F.count("*").alias("__n")).where(F.col("__n") >= least)
    # No more than `size` groups are ever needed, so that the running sum is over few rows.
    first = groups.orderBy(order_key(group_col, seed), group_col).limit(size)
    order = Window.orderBy(order_key(group_col, seed), group_col).rowsBetween(Window.unboundedPreceding, -1)
    chosen = first.withColumn("__before", F.coalesce(F.sum(F.least("__n", F.lit(cap))).over(order), F.lit(0))).where(F.col("__before") < size)
    within = F.row_number().over(Window.partitionBy(group_col).orderBy(order_key(id_col, seed), id_col))
    return rows.join(F.broadcast(chosen.select(group_col)), group_col).withColumn("__r", within).where(F.col("__r") <= cap).drop("__r")


def global_places(rows: DataFrame, order: list, name: str = "place") -> DataFrame:
    """Places 1, 2, ... in this order without a single-task window: ranges, counts of the ranges, places within.

    The ranged rows are written once, since two readings of a shuffle may be cut into partitions in two ways.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    ranged = durable(ranged.withColumn("__part", F.shiftright("__at", 33)))
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__part", "__first", before.alias("__before"))
    placed = ranged.join(F.broadcast(starts), "__part")  # one row a partition
    return placed.withColumn(name, (F.col("__at") - F.col("__first") + F.col("__before") + 1)).drop("__at", "__part", "__first", "__before")


def places_within(rows: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    """rows with their place 1, 2, ... among the rows of equal keys (nulls are equal), without a task for each group."""
    group = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    placed = global_places(rows.withColumn("__g", group), ["__g", *order], "__p")
    first = placed.groupBy("__g").agg(F.min("__p").alias("__first"), F.count("*").alias("__held"))
    met = hot_join(placed, first, ["__g"], rows.count(), "__held")
    return met.withColumn(name, F.col("__p") - F.col("__first") + 1).select(*rows.columns, name)


def strided(rows: DataFrame, id_col: str, step: int) -> DataFrame:
    return global_places(rows, [id_col], "__place").where(F.col("__place") % step == 1).drop("__place")


def equal_count(rows: DataFrame, order: list[str], bins: int) -> DataFrame:
    """Bins of equal count in this order, the first ones one larger where the count does not divide."""
    n = rows.agg(F.count("*")).scalar()
    placed = global_places(rows, order, "__place").withColumn("__total", n)
    small = F.floor(F.col("__total") / bins)
    edge = (F.col("__total") % bins) * (small + 1)
    zero = F.col("__place") - 1
    bin_ = F.when(zero < edge, F.floor(zero / (small + 1))).otherwise(F.col("__total") % bins + F.floor((zero - edge) / F.greatest(small, F.lit(1))))
    return placed.withColumn("bin", (bin_ + 1).cast("int")).drop("__place", "__total")


def folds(rows: DataFrame, group_col: str, k: int, seed: int) -> DataFrame:
    """Group-disjoint folds by hash."""
    return rows.withColumn("fold", F.conv(F.substring(order_key(group_col, seed), 1, 8), 16, 10).cast("long") % k)


def growth(ids: DataFrame, labels: DataFrame, id_col: str, label_col: str, seed: int, least: int = 10) -> DataFrame:
    """(n, labels seen, labels seen in two records) among the first n records in seeded order, for n = all, half, ... of all records.

    Records are numbered without a single task; a label keeps its number of records for each step of n at most.
    """
    placed = global_places(ids.select(F.col(id_col).alias("id"), order_key(id_col, seed).alias("h")), ["h", "id"], "p")
    total = placed.count()
    sizes = sorted({total >> k for k in range(max(total.bit_length(), 1)) if k == 0 or total >> k >= least})
    step = F.size(F.filter(F.array(*map(F.lit, sizes)), lambda n: n < F.col("p")))
    seen = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).distinct().join(placed.select("id", step.alias("step")), "id")
    steps = seen.groupBy("label", "step").agg(F.count("*").alias("c")).groupBy("label").agg(F.sort_array(F.collect_list(F.struct("step", "c"))).alias("s"))
    one = F.col("s")[0]["step"]
    two = F.when(F.col("s")[0]["c"] > 1, one).otherwise(F.get("s", F.lit(1))["step"])
    each = steps.select(one.alias("one"), two.alias("two")).groupBy("one", "two").agg(F.count("*").alias("c"))
    rows = each.select("c", "one", "two", F.posexplode(F.array(*(F.lit(n).cast("long") for n in sizes))).alias("k", "n"))
    within = lambda c: F.sum(F.when(F.col(c) <= F.col("k"), F.col("c")).otherwise(0))
    return rows.groupBy("n").agg(within("one").alias("labels"), within("two").alias("twice"))
