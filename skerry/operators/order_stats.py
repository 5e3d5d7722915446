"""Exact quantiles and ranks without a task for each group.

Equal values of a group are counted first, with partial sums before the shuffle. The distinct values then get places
in one distributed order, and sums of the counts before them in blocks, so that no task holds a group however large
it is. Quantiles and ranks are read from these sums.

Defined results: null values and NaN take no part; a group of null keys is a group like any other; without rows there
is no group. Columns of the rows keep their names.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.operators.hot_keys import hot_join
from skerry.operators.sampling import global_places
from skerry.session import durable

BLOCK = 1_024


def earlier_sums(rows: DataFrame, keys: list[str], at: str, values: list[str], length: int) -> DataFrame:
    """rows with `before_<value>`, sums over the earlier rows of their keys; `at` counts from 0, below `length`.

    Blocks are summed first, and blocks of blocks where there are many, so that no window holds over BLOCK rows. Keys
    are not null.
    """
    run, within = rows.withColumn("run", F.floor(F.col(at) / BLOCK)), Window.partitionBy(*keys, "run").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    out = run.withColumns({f"before_{v}": F.coalesce(F.sum(v).over(within), F.lit(0)) for v in values})
    if length <= BLOCK:
        return out.drop("run")
    sums = run.groupBy(*keys, "run").agg(*(F.sum(v).alias(f"held_{v}") for v in values)).withColumnRenamed("run", "block")
    sums = earlier_sums(sums, keys, "block", [f"held_{v}" for v in values], -(-length // BLOCK))
    sums = sums.select(*keys, F.col("block").alias("run"), *(f"before_held_{v}" for v in values))
    return out.join(sums, [*keys, "run"]).select(*rows.columns, *((F.col(f"before_{v}") + F.col(f"before_held_{v}")).alias(f"before_{v}") for v in values))


def value_places(rows: DataFrame, keys: list[str], x: str, times: str | None = None) -> DataFrame:
    """(key, value, c, before, n) for each distinct value of a group: its count, the smaller ones' and the group's.

    A row stands for `times` rows, if that is given. key is a struct of the group's keys, without fields where there are none.
    """
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}) if keys else F.lit("")
    many = F.lit(1) if times is None else F.col(times)
    held = rows.select(*keys, F.col(x).cast("double").alias("value"), many.alias("times")).where(F.col("value").isNotNull() & ~F.isnan("value"))
    # Adding zero turns -0.0 into 0.0, which compares equal but may not order so.
    counts = durable(held.select(F.struct(*keys, key.alias("g")).alias("key"), (F.col("value") + 0.0).alias("value"), "times").groupBy("key", "value").agg(F.sum("times").alias("c")))
    distinct = counts.count()
    placed = global_places(counts.select("*", F.col("key.g").alias("g")), ["g", "value"], "at").withColumn("at", F.col("at") - 1)
    sums = durable(earlier_sums(placed, [], "at", ["c"], distinct))
    groups = sums.groupBy("g").agg(F.sum("c").alias("n"), F.min("before_c").alias("first"), F.count("*").alias("held"))
    return hot_join(sums, groups, ["g"], distinct, "held").select("key", "value", "c", (F.col("before_c") - F.col("first")).alias("before"), "n")


def _at(rank: Column) -> Column:
    """The value of a 0-based rank of the group."""
    return F.max(F.when((F.col("before") <= rank) & (rank < F.col("before") + F.col("c")), F.col("value")))


def quantiles(rows: DataFrame, keys: list[str], x: str, points: list[float], name: str = "q") -> DataFrame:
    """keys, and `name` as the array of these quantiles by linear interpolation, and n, the number of values.

    Without keys there is one row, of nulls and 0 where there are no values.
    """
    places = value_places(rows, keys, x)
    ends = [(p, F.floor(F.lit(p) * (F.col("n") - 1)), F.ceil(F.lit(p) * (F.col("n") - 1))) for p in points]
    grouped = places.groupBy("key") if keys else places.groupBy()
    found = grouped.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), *(e for k, (_, low, high) in enumerate(ends) for e in (_at(low).alias(f"low{k}"), _at(high).alias(f"high{k}"))))
    share = lambda p: F.lit(p) * (F.col("n") - 1) - F.floor(F.lit(p) * (F.col("n") - 1))
    values = [F.when(F.col(f"low{k}") == F.col(f"high{k}"), F.col(f"low{k}")).otherwise(F.col(f"low{k}") * (1 - share(p)) + F.col(f"high{k}") * share(p)) for k, p in enumerate(points)]
    return found.select(*(F.col(f"key.`{k}`").alias(k) for k in keys), F.array(*values).alias(name), "n")


def average_ranks(rows: DataFrame, keys: list[str], x: str, name: str, times: str | None = None) -> DataFrame:
    """rows with the rank of x in its group, from 1, ties averaged, a row standing for `times` rows if that is given; rows whose x is null or NaN go."""
    places = value_places(rows, keys, x, times).select("key", "value", "c", (F.col("before") + (F.col("c") + 1) / 2).alias("r"))
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}) if keys else F.lit("")
    whole = rows.select(F.struct(*rows.columns).alias("row"), key.alias("g"), (F.col(x).cast("double") + 0.0).alias("value")).where(F.col("value").isNotNull() & ~F.isnan("value"))
    places = places.select(F.col("key.g").alias("g"), "value", "c", "r")
    return hot_join(whole, places, ["g", "value"], whole.count(), "c").select("row.*", F.col("r").alias(name))


def quantile_at(rows: DataFrame, x: str, point: float) -> DataFrame:
    """One row and column: the quantile of all values at one point."""
    return quantiles(rows, [], x, [point]).select(F.get("q", F.lit(0)).alias("value"))


def medians(rows: DataFrame, keys: list[str], x: str, name: str) -> DataFrame:
    return quantiles(rows, keys, x, [0.5]).select(*keys, F.get("q", F.lit(0)).alias(name))


def with_quantiles(rows: DataFrame, keys: list[str], x: str, points: list[float], name: str) -> DataFrame:
    """rows with the array of quantiles of their group; groups are few beside the rows, but their table isn't broadcast unless small."""
    found = quantiles(rows, keys, x, points, name).drop("n")
    if not keys:
        return rows.withColumn(name, found.scalar())
    same = functools.reduce(lambda a, b: a & b, (rows[k].eqNullSafe(found[k]) for k in keys))
    return rows.join(found, same, "left").select(*(rows[c] for c in rows.columns), found[name])
