"""Screens of a metric: pairs drawn at random, support sweeps, structure notes and growth verdicts.

Drawn pairs keep a screen linear in the rows: each row meets a fixed number of partners, whatever the table's size.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.operators import order_stats, pairs, sampling, variogram
from skerry.session import durable

BYTES_PER_ENTRY = 12


def drawn_pairs(rows: DataFrame, id_col: str, per_row: int, seed: int, keep: list[str]) -> DataFrame:
    """(i, j, a_<column>, b_<column>...): each row with `per_row` others, by congruences of its place; never itself."""
    placed = sampling.global_places(rows.select(id_col, *keep), [F.col(id_col)])
    n = rows.agg(F.count("*")).scalar()
    a = placed.select(F.col(id_col).alias("i"), (F.col("place") - 1).alias("at"), *(F.col(c).alias(f"a_{c}") for c in keep))
    a = a.withColumn("n", n).where("n > 1").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(per_row - 1))))
    step = (F.col("at") * 7919 + F.col("k") * 104729 + seed) % (F.col("n") - 1) + 1
    a = a.withColumn("to", (F.col("at") + step) % F.col("n")).drop("at", "n", "k")
    b = placed.select(F.col(id_col).alias("j"), (F.col("place") - 1).alias("to"), *(F.col(c).alias(f"b_{c}") for c in keep))
    return a.join(b, "to").drop("to")


def support_sweep(pairs: DataFrame, same: Column, shares: list[float], target: int, budget: float) -> DataFrame:
    """By radius (percentiles of d): share of pairs inside, with and without the category mask, bytes at the target size, and the largest size within the budget."""
    radii = order_stats.quantiles(pairs, [], "d", shares).select("q").scalar()
    each = pairs.select("d", same.alias("same"), F.posexplode(radii).alias("bin", "radius"))
    c = each.groupBy("bin", "radius").agg(F.avg((F.col("d") <= F.col("radius")).cast("int")).alias("density"), F.avg(((F.col("d") <= F.col("radius")) & F.col("same")).cast("int")).alias("masked"))
    size = lambda s: F.col(s) * BYTES_PER_ENTRY * float(target) ** 2
    most = lambda s: F.floor(F.sqrt(F.lit(budget) / (BYTES_PER_ENTRY * F.greatest(F.col(s), F.lit(1e-12)))))
    cross = F.when(F.col("density") > 0, 1 - F.col("masked") / F.col("density")).otherwise(0.0)
    return c.select("bin", "radius", "density", "masked", cross.alias("cross_share"), (size("density") / 1e12).alias("tb"), (size("masked") / 1e12).alias("tb_masked"), most("density").alias("n_break"), most("masked").alias("n_break_masked"))


def captured(curve: DataFrame) -> DataFrame:
    """curve with `captured`: the running maximum of the smoothed semivariance over its largest value."""
    w = Window.orderBy("bin")
    c = curve.withColumn("s", variogram.smoothed(curve))
    top = F.max("s").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return c.withColumn("captured", F.max("s").over(w.rowsBetween(Window.unboundedPreceding, 0)) / top).drop("s")


def structure(pairs: DataFrame, bins: int) -> DataFrame:
    """One row: nugget, sill, range and the structured share (1 - nugget / sill) of the variogram of (d, dy).

    The curve, a row a bin, is written, so that what is built on it holds no plan over the pairs.
    """
    curve = durable(variogram.semivariance(variogram.equal_count_bins(pairs, bins), lag="mean"))
    fit = variogram.nugget_sill_range(curve)
    return fit.withColumn("structured", F.when(F.col("sill") > 0, 1 - F.col("nugget") / F.col("sill")).otherwise(0.0))


def screened(pairs: DataFrame, band: Column, bins: int) -> DataFrame:
    """One row for a metric: structured share over all pairs and over pairs of like size, range, sparsity there, and a note."""
    whole = structure(pairs, bins).select("structured", "range")
    like = structure(pairs.where(band), bins).select(F.struct(F.col("structured").alias("controlled")))
    row = whole.withColumn("controlled", like.scalar()["controlled"])
    beyond = pairs.withColumn("range", whole.select("range").scalar()).agg(F.avg((F.col("d") > F.col("range")).cast("int")))
    row = row.withColumn("sparsity", beyond.scalar())
    s, c = F.col("structured"), F.col("controlled")
    note = F.when((s > 0.15) & (c.isNull() | (c < 0.05)), "size artifact").when(s < 0.05, "flat").when(F.col("sparsity") < 0.5, "dense").otherwise("")
    return row.withColumn("note", note)


def growth_verdict(curve: DataFrame) -> DataFrame:
    """Slope of log neighbours a row on log size of (m, per_row), and what it means for storage."""
    slope = F.regr_slope(F.log(F.greatest("per_row", F.lit(1e-9))), F.log("m"))
    return curve.agg(slope.alias("alpha")).withColumn("verdict", F.when(F.col("alpha") < 0.15, "go").when(F.col("alpha") < 0.6, "marginal").otherwise("no go"))


def nested_r2(rows: DataFrame, place: str, shares: list[float], x: str, y: str) -> DataFrame:
    """(m, r2) of the line of y on x over the rows whose place in [0, 1) is below each share.

    A row is summed in the first share that holds it; shares then add up the sums of those before.
    """
    first = F.array_min(F.filter(F.array(*map(F.lit, shares)), lambda s: F.col(place) < s))
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    parts = {"m": F.lit(1), "sx": a, "sy": b, "sxx": a * a, "sxy": a * b, "syy": b * b}
    sums = rows.where(a.isNotNull() & b.isNotNull()).groupBy(first.alias("share")).agg(*(F.sum(v).alias(k) for k, v in parts.items())).where("share IS NOT NULL")
    upto = sums.select(*(F.sum(k).over(Window.orderBy("share")).alias(k) for k in parts))  # one row a share
    m = F.col("m")
    between = lambda p, u, v: m * F.col(p) - F.col(u) * F.col(v)
    return upto.select("m", (F.pow(between("sxy", "sx", "sy"), 2) / (between("sxx", "sx", "sx") * between("syy", "sy", "sy"))).alias("r2"))


def curve_verdict(curve: DataFrame) -> DataFrame:
    """(m, r2) with the gain for each doubling since the size before; climbing above 0.02."""
    w = Window.orderBy("m")  # one row a size
    gain = (F.col("r2") - F.lag("r2").over(w)) / F.log2(F.col("m") / F.lag("m").over(w))
    return curve.select("m", "r2", gain.alias("gain")).withColumn("climbing", F.coalesce(F.col("gain") > 0.02, F.lit(False)))


def pooled_kernel(points: DataFrame, pool: Column, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray], id_col: str = "vec_id", cat_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(i, j, k) between pools: sums of a kernel that is zero across categories over the members of either; tiles sum, no pair leaves a task."""
    rows = points.withColumn(vector_col, F.concat(F.col(vector_col).cast("array<double>"), F.array(pool.cast("double"))))
    left, right = pairs._tiles(rows, id_col, cat_col, vector_col, pairs.TILE_ROWS)

    def total(key, a: pa.Table, b: pa.Table) -> pa.Table:
        i, j, k = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if a.num_rows and b.num_rows:
            same = key[1].as_py() == key[2].as_py()
            x = pairs._matrix(a.column("z"))
            y = x if same else pairs._matrix(b.column("z"))
            (one, at), (other, to) = (np.unique(z[:, -1], return_inverse=True) for z in (x, y))
            member = np.eye(len(other))[to]
            sums = np.zeros((len(one), len(other)))
            for s in range(0, len(x), 256):
                sums += np.eye(len(one))[at[s : s + 256]].T @ (kernel(x[s : s + 256, :-1], y[:, :-1]) @ member)
            r, c = np.nonzero(sums)
            i, j, k = [one[r].astype(np.int64)], [other[c].astype(np.int64)], [sums[r, c]]
            if not same:
                i, j, k = [*i, j[0]], [*j, i[0]], [*k, k[0]]
        return pa.table({n: pa.array(np.concatenate(v)) for n, v in (("i", i), ("j", j), ("k", k))})

    met = left.groupBy("cat", "q", "c").cogroup(right.groupBy("cat", "q", "c")).applyInArrow(total, "i long, j long, k double")
    return met.groupBy("i", "j").agg(F.sum("k").alias("k"))


def pooled_gram(near: DataFrame, members: DataFrame) -> DataFrame:
    """(i, j, k) between pools: sums of the kernel over the members of either, from (i, j, k) in both directions with its diagonal and (id, pool)."""
    a = members.select(F.col("id").alias("i"), F.col("pool").alias("a"))
    b = members.select(F.col("id").alias("j"), F.col("pool").alias("b"))
    return near.join(a, "i").join(b, "j").groupBy(F.col("a").alias("i"), F.col("b").alias("j")).agg(F.sum("k").alias("k"))
