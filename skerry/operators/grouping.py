"""Grouped statistics: variance decomposition, spreads, summaries, ranks and moments, each a plain aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.operators import order_stats
from skerry.session import durable


def decompose(rows: DataFrame, keys: list[str], y: str, over: list[str] | None = None) -> DataFrame:
    """One-way variance decomposition of y by the groups of `keys`, for each value of `over`.

    n, groups, ss_between, ss_within, unbiased within variance ss_within / (n - groups), in-sample and unbiased
    ceilings of R2, inverse-Simpson effective group count, and the share of rows in groups of two or more.
    """
    over = over or []
    g = rows.groupBy(*over, *keys).agg(F.count(y).alias("m"), F.avg(y).alias("mean"), F.var_pop(y).alias("v"))
    n, m = F.sum("m"), F.col("m")
    mean = F.sum(m * F.col("mean")) / n
    between = F.sum(m * F.col("mean") * F.col("mean")) - n * mean * mean
    within = F.sum(m * F.col("v"))
    out = g.groupBy(*over).agg(
        n.alias("n"), F.count("*").alias("groups"), between.alias("ss_between"), within.alias("ss_within"),
        (F.pow(n.cast("double"), 2) / F.sum(m * m)).alias("effective_groups"), (F.sum(F.when(m >= 2, m).otherwise(0)) / n).alias("multi_share"),
    )
    total = F.col("ss_between") + F.col("ss_within")
    dof = F.nullif(F.col("n") - F.col("groups"), F.lit(0))
    out = out.withColumn("within_var", F.col("ss_within") / dof).withColumn("ceiling", F.col("ss_between") / F.nullif(total, F.lit(0.0)))
    return out.withColumn("ceiling_unbiased", 1 - F.col("within_var") / F.nullif(total / F.nullif(F.col("n") - 1, F.lit(0)), F.lit(0.0)))


def size_ccdf(rows: DataFrame, keys: list[str], most: int = 64) -> DataFrame:
    """(k, groups, share of groups, share of rows) for groups of at least k rows, k up to `most`."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("groups"))
    held = sizes.select("*", F.explode(F.sequence(F.lit(1), F.least("size", F.lit(most)).cast("int"))).alias("k"))
    c = held.groupBy("k").agg(F.sum("groups").alias("groups"), F.sum(F.col("groups") * F.col("size")).alias("rows"))
    all_ = sizes.agg(F.sum("groups").alias("g"), F.sum(F.col("groups") * F.col("size")).alias("r"))
    c = c.withColumns({"g": all_.select("g").scalar(), "r": all_.select("r").scalar()})
    return c.select("k", "groups", (F.col("groups") / F.col("g")).alias("group_share"), (F.col("rows") / F.col("r")).alias("row_share"))


def spread(rows: DataFrame, keys: list[str], y: str) -> DataFrame:
    """Groups, share with several rows, root mean square within, median deviation and largest range, and size classes."""
    g = rows.groupBy(*keys).agg(F.count(y).alias("m"), F.var_pop(y).alias("v"), (F.max(y) - F.min(y)).alias("r"))
    many = F.col("m") >= 2
    size = [F.count_if(F.col("m") == k).alias(f"size_{k}") for k in (1, 2, 3, 4)]
    middle = order_stats.medians(g.where(many).select(F.sqrt("v").alias("std")), [], "std", "median_std")
    return g.agg(
        F.count("*").alias("groups"), F.avg(many.cast("int")).alias("multi"),
        F.sqrt(F.sum(F.when(many, F.col("m") * F.col("v"))) / F.sum(F.when(many, F.col("m")))).alias("rms_within"),
        F.max(F.when(many, F.col("r"))).alias("max_range"), *size, F.count_if(F.col("m") >= 5).alias("size_5"),
    ).withColumn("median_std", middle.scalar())


def split_rate(rows: DataFrame, keys: list[str], inner: str, least: int = 1) -> DataFrame:
    """Share of groups of at least `least` rows that hold more than one inner value."""
    g = rows.groupBy(*keys).agg(F.count("*").alias("m"), F.count_distinct(inner).alias("k")).where(F.col("m") >= least)
    return g.agg(F.count("*").alias("groups"), F.avg((F.col("k") > 1).cast("int")).alias("split"))


def quantile_summary(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: quantiles 0 to 100, mean, population deviation and the number of finite values."""
    points = (0.0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0)
    names = ("p0", "p1", "p5", "p25", "p50", "p75", "p95", "p99", "p100")
    long = rows.select(F.explode(F.create_map(*(x for c in columns for x in (F.lit(c), finite(F.col(c).cast("double")))))).alias("column", "x"))
    s = long.groupBy("column").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.count("x").alias("n_finite"))
    s = s.join(order_stats.quantiles(long, ["column"], "x", list(points), "p").drop("n"), "column", "left")  # one row a column
    return s.select("column", *(F.col("p")[k].alias(n) for k, n in enumerate(names)), "mean", "std", "n_finite")


def finite(x: Column) -> Column:
    """Null for NaN and infinities, so that no comparison takes them for large values."""
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def rate_above(x: Column, threshold: float) -> Column:
    """Share of non-null rows above a threshold, with NaN counted as not above."""
    return F.avg(F.when(x.isNotNull(), (~F.isnan(x) & (x > threshold)).cast("int")))


def moments(rows: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Coefficient of variation, skewness, excess kurtosis and Sarle's bimodality of population moments."""
    s = rows.groupBy(*keys).agg(F.count(x).alias("n"), (F.stddev_pop(x) / F.avg(x)).alias("cv"), F.skewness(x).alias("skew"), F.kurtosis(x).alias("kurt"))
    return s.withColumn("bimodality", (F.col("skew") * F.col("skew") + 1) / (F.col("kurt") + 3))


def histogram_mode(rows: DataFrame, keys: list[str], x: str, low: float, width: float, bins: int, least: int = 1) -> DataFrame:
    """Centre of the fullest of fixed bins (the first of ties); the median for groups of fewer than `least` rows."""
    bin_ = F.least(F.greatest(F.floor((F.col(x) - low) / width), F.lit(0)), F.lit(bins - 1))
    c = rows.withColumn("bin", bin_).groupBy(*keys, "bin").agg(F.count("*").alias("c"))
    top = c.groupBy(*keys).agg(F.max_by("bin", F.struct("c", -F.col("bin"))).alias("bin"), F.sum("c").alias("n"))
    medians = order_stats.medians(rows, keys, x, "median")
    mode = low + width * (F.col("bin") + 0.5)
    return top.join(medians, keys).select(*keys, "n", F.when(F.col("n") >= least, mode).otherwise(F.col("median")).alias("mode"))


def average_ranks(rows: DataFrame, keys: list[str], x: str, name: str) -> DataFrame:
    """Ranks with ties averaged, per group of `keys`; rows without a value go."""
    return order_stats.average_ranks(rows, keys, x, name)


def spearman(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys, n and rho of average ranks. Rows that agree in keys, x and y are counted first, so that ranks follow the distinct ones."""
    counted = durable(rows.groupBy(*keys, x, y).agg(F.count("*").alias("times")))
    ranked = order_stats.average_ranks(order_stats.average_ranks(counted, keys, x, "rx", "times"), keys, y, "ry", "times")
    c, a, b = F.col("times").cast("double"), F.col("rx"), F.col("ry")
    s = ranked.groupBy(*keys).agg(F.sum("times").alias("n"), *(F.sum(c * v).alias(k) for k, v in {"a": a, "b": b, "aa": a * a, "bb": b * b, "ab": a * b}.items()))
    lost = lambda p, q, pq: F.col(pq) - F.col(p) * F.col(q) / F.col("n")
    spread = F.sqrt(lost("a", "a", "aa")) * F.sqrt(lost("b", "b", "bb"))
    return s.select(*keys, "n", F.when(spread > 0, lost("a", "b", "ab") / spread).alias("rho"))


def category_codes(rows: DataFrame, name: str, code: str) -> DataFrame:
    """Rows with a dense code by sorted name; the distinct names are few beside the rows."""
    names = rows.select(name).distinct()
    return rows.join(names.withColumn(code, F.dense_rank().over(Window.orderBy(name)) - 1), name)


def scaled(rows: DataFrame, columns: list[str], how: str, fit: Column | None = None) -> DataFrame:
    """Columns centred and divided by the deviation (standard), its root (pareto) or one (center); fitted where `fit`."""
    root = {"standard": lambda s: s, "pareto": F.sqrt, "center": lambda s: F.lit(1.0)}[how]
    train = rows if fit is None else rows.where(fit)
    s = train.agg(*(F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in columns))
    for c in columns:
        one = s.select(c).scalar()
        rows = rows.withColumn("fitted", one)
        width = F.when(F.col("fitted.s") == 0, F.lit(1.0)).otherwise(root(F.col("fitted.s")))
        rows = rows.withColumn(c, (F.col(c) - F.col("fitted.m")) / width).drop("fitted")
    return rows


def repeats(df: DataFrame, key: str) -> DataFrame:
    """One row: the distinct values of a column, the share of rows whose value occurs twice or more, the largest count.

    A null is a value like any other; without rows there are 0 values and the rest is null.
    """
    c = df.groupBy(key).agg(F.count("*").alias("n"))
    return c.agg(F.count("*").alias("values"), (F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("repeated_share"), F.max("n").alias("largest"))


def largest_counts(df: DataFrame, key: str, top: int) -> DataFrame:
    """(rank, n) of the `top` most frequent values; only these are ranked in one task."""
    c = df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(top)
    return c.select(F.row_number().over(Window.orderBy(F.desc("n"))).alias("rank"), "n")
