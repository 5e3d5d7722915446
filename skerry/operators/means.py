"""Means with size terms, baselines of variance, symmetric tables and held-out categories."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.operators import pairs
from skerry.operators.regression import Linear, moments, ridge


def symmetrised(d: DataFrame) -> DataFrame:
    """(i, j, d) for i <= j: the mean of both directions, zero on the diagonal."""
    low, high = F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")
    mean = d.select(low, high, "d").groupBy("i", "j").agg(F.avg("d").alias("d"))
    return mean.select("i", "j", F.when(F.col("i") == F.col("j"), 0.0).otherwise(F.col("d")).alias("d"))


def _size_terms(size: Column) -> list[Column]:
    n = size.cast("double")
    return [n, F.log(n), F.sqrt(n), n * n * n]


@dataclass(frozen=True)
class SizeMean:
    """1, the vector z, standardised terms of the size n (n, ln n, root n, n^3), and z ln n."""

    linear: Linear
    centre: list[float]
    width: list[float]

    def design(self, z: str, size: str) -> Column:
        n = F.col(size).cast("double")
        terms = F.array(*((t - m) / w for t, m, w in zip(_size_terms(n), self.centre, self.width)))
        x = F.col(z).cast("array<double>")
        return F.concat(x, terms, F.transform(x, lambda v: v * F.log(n)))

    def predict(self, z: str, size: str) -> Column:
        return self.linear.predict(self.design(z, size))

    def variance(self, z: str, size: str) -> Column:
        """Of the fitted mean: sigma^2 h' (H'H)^+ h."""
        row = lambda values: F.array(*(F.lit(float(v)) for v in values))
        d = F.zip_with(self.design(z, size), row(self.linear.mean), lambda a, b: a - b)
        dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
        whole = F.transform(F.array(d), lambda v: dot(v, F.transform(F.array(*(row(r) for r in self.linear.inverse)), lambda r: dot(v, r))))[0]
        return self.linear.sigma2 * (1 / self.linear.n + whole)


def size_mean(rows: DataFrame, z: str, size: str, y: str) -> SizeMean:
    """Least squares; sizes must be positive. Terms are scaled by their population deviations, or by one where these are zero."""
    stats = rows.agg(*(f(t) for t in _size_terms(F.col(size)) for f in (F.avg, F.stddev_pop)), F.min(size)).first()
    if stats[8] is None or stats[8] <= 0:
        raise ValueError("sizes must be positive")
    empty = SizeMean(Linear(0.0, np.zeros(0), 0.0, np.zeros((0, 0)), np.zeros(0), 0), list(stats[0:8:2]), [w or 1.0 for w in stats[1:8:2]])
    return SizeMean(ridge(moments(rows, empty.design(z, size), F.col(y)), 0.0), empty.centre, empty.width)


def deviation(rows: DataFrame, residual: str, size: str, category: str) -> DataFrame:
    """rows with `sigma`: exp of half a linear fit of ln(r^2 + 1e-8) on ln n and the category."""
    found = [r[0] for r in rows.select(category).distinct().orderBy(category).limit(1001).collect()]
    if len(found) > 1000:
        raise ValueError("over 1000 categories")
    one_hot = [(F.col(category) == c).cast("double") for c in found]
    x = F.array(F.log(F.col(size).cast("double")), *one_hot)
    fit = ridge(moments(rows, x, F.log(F.col(residual) * F.col(residual) + 1e-8)), 0.0)
    return rows.withColumn("sigma", F.exp(0.5 * fit.predict(x)))


def extensive_design(atoms: Column, elements: list[int], charge: Column, spin: Column) -> Column:
    """Element counts (others are ignored), charge, its size and square, spin, and the squared number of atoms."""
    count = lambda e: F.size(F.filter(atoms, lambda a: a["z"] == e)).cast("double")
    q, n = charge.cast("double"), F.size(atoms).cast("double")
    return F.array(*(count(e) for e in elements), q, F.abs(q), q * q, spin.cast("double"), n * n)


def degradation(rows: DataFrame, k: int, id_col: str = "vec_id", cat_col: str = "label", y: str = "y") -> DataFrame:
    """cat, held_out, control, degradation: root mean squared error of the mean of the k nearest rows outside the category, of the k nearest of all, and their ratio."""
    of = rows.select(F.col(id_col).alias("neighbour_id"), F.col(cat_col).alias("cl"), F.col(y).alias("cy"))
    own = rows.select(F.col(id_col).alias("query_id"), F.col(cat_col).alias("cat"), F.col(y).alias("qy"))

    def error(near: DataFrame, name: str) -> DataFrame:
        mu = near.join(of, "neighbour_id").groupBy("query_id").agg(F.avg("cy").alias("mu")).join(own, "query_id")
        return mu.groupBy("cat").agg(F.sqrt(F.avg(F.pow(F.col("qy") - F.col("mu"), 2))).alias(name))

    control = error(pairs.nearest(rows, k, cat_col=None), "control")
    held = error(pairs.nearest_outside(rows, k, cat_col=cat_col), "held_out")
    return held.join(control, "cat").select("cat", "held_out", "control", (F.col("held_out") / F.col("control")).alias("degradation"))
