"""Joins and running sums that no hot key sends to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS, MOST_HOT = 10_000, 100_000
BLOCK = 1_024


def is_hot(n: Column, total: int, least: int = HOT_ROWS, most: int = MOST_HOT) -> Column:
    """Whether a key of n rows is hot; the rows of all keys sum to `total`, so that fewer than `most` keys are."""
    return n > max(least, total // most)


def hot_join(rows: DataFrame, side: DataFrame, on: list[str], total: int, n: str = "n", least: int = HOT_ROWS) -> DataFrame:
    """Inner join of rows with `side`, which has one row a key and the number of the key's rows as `n`.

    Hot keys, MOST_HOT at most whatever the table, are broadcast, so that their rows stay where they are; all other
    rows meet their key in a shuffle, in which no key has more rows than the threshold. Keys are not null.
    """
    hot = F.broadcast(side.where(is_hot(F.col(n), total, least)))
    cold = side.where(~is_hot(F.col(n), total, least))
    met = rows.join(hot, on)
    return met.unionByName(rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on).select(*met.columns))


def running_totals(rows: DataFrame, keys: list[str], order: str, n: str, name: str = "before", block: int = BLOCK) -> DataFrame:
    """rows with the sum of `n` over the earlier ones of their key; `order` holds whole numbers from 0, keys are not null.

    Runs of `block` numbers are summed first: a window then holds the runs of a key, or the rows of one run.
    """
    runs = rows.withColumn("run", F.floor(F.col(order) / block))
    earlier = lambda x, w: F.coalesce(F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = runs.groupBy(*keys, "run").agg(F.sum(n).alias("held"))
    sums = sums.select(*keys, "run", earlier("held", Window.partitionBy(*keys).orderBy("run")).alias("base"))
    within = earlier(n, Window.partitionBy(*keys, "run").orderBy(order))
    return runs.withColumn("within", within).join(sums, [*keys, "run"]).select(*rows.columns, (F.col("base") + F.col("within")).alias(name))
