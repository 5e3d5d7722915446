"""Semivariograms of a pair table (d, dy): bins, estimators, sills and range rules as options of one operator."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.operators import order_stats
from skerry.operators.pair_order import Found, Pairs, with_target
from skerry.session import durable


def equal_count_bins(pairs: DataFrame, bins: int, over: list[str] | None = None) -> DataFrame:
    """pairs with `bin` from percentile edges; each bin is half-open but the last."""
    over = over or []
    shares = [k / bins for k in range(1, bins)]
    bin_ = F.size(F.filter("edges", lambda e: e <= F.col("d")))
    return order_stats.with_quantiles(pairs, over, "d", shares, "edges").withColumn("bin", bin_).drop("edges")


def equal_width_bins(pairs: DataFrame, bins: int, upto: float) -> DataFrame:
    """pairs up to a percentile of d with `bin` of equal width from zero."""
    top = order_stats.quantile_at(pairs, "d", upto).scalar()
    near = pairs.withColumn("top", top).where("d <= top")
    return near.withColumn("bin", F.least(F.floor(F.col("d") / (F.col("top") / bins)), F.lit(bins - 1)).cast("int")).drop("top")


def semivariance(binned: DataFrame, estimator: str = "matheron", lag: str = "median", over: list[str] | None = None) -> DataFrame:
    """(bin, lag, gamma, n) of pairs with `bin`: half the mean squared difference, or Cressie and Hawkins' robust form."""
    dy2 = F.pow(F.col("dy"), 2)
    if estimator == "matheron":
        gamma = 0.5 * F.avg(dy2)
    else:
        gamma = 0.5 * F.pow(F.avg(F.pow(dy2, 0.25)), 4) / (0.457 + 0.494 / F.count("*"))
    keys = [*(over or []), "bin"]
    if lag == "mean":
        return binned.groupBy(*keys).agg(F.avg("d").alias("lag"), gamma.alias("gamma"), F.count("*").alias("n"))
    curve = binned.groupBy(*keys).agg(gamma.alias("gamma"), F.count("*").alias("n"))
    return curve.join(order_stats.medians(binned, keys, "d", "lag"), keys).select(*keys, "lag", "gamma", "n")  # one row a bin


def smoothed(curve: DataFrame) -> Column:
    """Three-point mean with zeros beyond the ends."""
    w = Window.orderBy("bin")  # one row a bin
    g = F.col("gamma")
    return (F.coalesce(F.lag(g).over(w), F.lit(0.0)) + g + F.coalesce(F.lead(g).over(w), F.lit(0.0))) / 3


def guarded_range(curve: DataFrame, sill: DataFrame, share: float = 0.95, overshoot: float = 1.5) -> DataFrame:
    """sill and the smallest lag that reaches its share; no range where a bin overshoots the sill."""
    c = curve.withColumn("sill", sill.scalar())
    reach = F.min(F.when(F.col("gamma") >= share * F.col("sill"), F.col("lag")))
    return c.groupBy("sill").agg(F.when(F.max("gamma") <= overshoot * F.col("sill"), reach).alias("range"), F.max("gamma").alias("top"))


def nugget_sill_range(curve: DataFrame) -> DataFrame:
    """First bin, median of the upper third, and the first lag of the smoothed curve at nugget + 0.95 (sill - nugget)."""
    w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n = F.count("*").over(w)
    c = curve.withColumn("s", smoothed(curve)).withColumn("nugget", F.first("gamma").over(w))
    upper = F.percentile(F.when(F.col("place") > F.col("n") - F.floor(F.col("n") / 3), F.col("gamma")), 0.5).over(w)
    c = c.withColumn("n", n).withColumn("place", F.row_number().over(Window.orderBy("bin"))).withColumn("sill", upper)
    level = F.col("nugget") + 0.95 * (F.col("sill") - F.col("nugget"))
    return c.groupBy("nugget", "sill").agg(F.min(F.when(F.col("s") >= level, F.col("lag"))).alias("range"))


def interpolated(targets: DataFrame, t: str, curve: DataFrame, x: str, y: str, name: str) -> DataFrame:
    """targets with `name`, the curve's value at t between its two neighbouring points; beyond the ends, the end's value.

    A curve has a row a bin or size, so that it goes to the rows as one array. Points with a null are left out; of points
    of equal x the largest y counts; without points, and for a null t, the value is null.
    """
    points = curve.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).cast("double").alias("x")).agg(F.max(F.col(y).cast("double")).alias("y"))
    rows = targets.withColumn(name, points.agg(F.sort_array(F.collect_list(F.struct("x", "y")))).scalar())
    c, at = F.col(name), F.col(t).cast("double")
    k = F.size(F.filter(c, lambda p: p["x"] <= at))
    low, high = F.get(c, k - 1), F.get(c, k)
    between = low["y"] + (high["y"] - low["y"]) * (at - low["x"]) / (high["x"] - low["x"])
    value = F.when(k == 0, F.get(c, F.lit(0))["y"]).when(k == F.size(c), F.get(c, k - 1)["y"]).otherwise(between)
    return rows.withColumn(name, F.when(at.isNotNull(), value))


def by_nearest(errors: DataFrame, bins: int) -> DataFrame:
    """(bin, nn, rmse, running rmse, rolling and suffix median) of (d, dy) by distance to the nearest training row."""
    binned = equal_count_bins(errors, bins)
    c = binned.groupBy("bin").agg(F.avg("d").alias("nn"), F.sqrt(F.avg(F.pow("dy", F.lit(2)))).alias("rmse"), F.sum(F.pow("dy", F.lit(2))).alias("se"), F.count("*").alias("n"))
    w = Window.orderBy("bin")
    running = F.sqrt(F.sum("se").over(w) / F.sum("n").over(w))
    return c.select(
        "bin", "nn", "rmse", running.alias("cumulative"), F.percentile("rmse", 0.5).over(w.rowsBetween(-1, 1)).alias("rolling"),
        F.percentile("rmse", 0.5).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("suffix"),
    )


def pair_curve(points: DataFrame, bins: int, lag: str = "median", estimator: str = "matheron", upto: float | None = None, whole: bool = True, y: str = "y", cat_col: str = "label") -> DataFrame:
    """(g, bin, lag, gamma, n) of all pairs of a category, g being the category or, if `whole`, 0 for all; tiles count and sum, no pair is written.

    Bins hold equal counts, or with `upto` are of equal width up to that percentile of d. The bins' medians are values at
    ranks, since a bin follows the one before it.
    """

    every = Pairs(with_target(points, y), [(0, -1)], whole=whole, target=True, cat_col=cat_col)
    histogram, found = every.quantiles([k / bins for k in range(1, bins)] if upto is None else [upto])
    edges = {g: np.array(q) for (g, _), q in found.items()}

    def terms(g, pair: Found) -> tuple[np.ndarray, list[np.ndarray]]:
        if upto is None:
            at = pair.placed(0, lambda d: np.searchsorted(edges[g], d, "right"))
        else:
            top = edges[g][0]
            at = pair.placed(0, lambda d: np.where(d <= top, np.minimum(np.floor(d / (top / bins)), bins - 1), bins).astype(int))
            at[at == bins] = -1
        return at, [pair.at[0], pair.dy**2 if estimator == "matheron" else np.sqrt(pair.dy)]

    sums = durable(every.summed(terms, ["sd", "se"]))
    mean = F.col("se") / F.col("n")
    gamma = 0.5 * mean if estimator == "matheron" else 0.5 * F.pow(mean, 4) / (0.457 + 0.494 / F.col("n"))
    if lag == "mean":
        return sums.select("g", "bin", (F.col("sd") / F.col("n")).alias("lag"), gamma.alias("gamma"), "n")
    first, ranks = {}, {}
    for r in sums.select("g", "bin", "n").orderBy("g", "bin").collect():  # a row a bin
        start = first.get(r["g"], 0)
        first[r["g"]] = start + r["n"]
        ranks[r["g"], r["bin"]] = (start + (r["n"] - 1) // 2, start + r["n"] // 2)
    asked: dict[tuple[object, int], list[int]] = {}
    for (g, _), ends in ranks.items():
        asked.setdefault((g, 0), []).extend(ends)
    at = every.at_ranks(histogram, asked) if ranks else {}
    medians = [(g, b, 0.5 * (at[g, 0][low][0] + at[g, 0][high][0])) for (g, b), (low, high) in ranks.items()]
    lags = points.sparkSession.createDataFrame(medians, f"g {every.kind}, bin int, lag double")
    return sums.select("g", "bin", gamma.alias("gamma"), "n").join(F.broadcast(lags), ["g", "bin"]).select("g", "bin", "lag", "gamma", "n")
