"""Linear models from normal equations: one distributed pass sums X'X and X'y, the driver solves p x p.

X'X is summed block by block inside tasks; a partial sum has p^2 numbers whatever the number of rows, and the sums are
added by Spark. The intercept is never penalised.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Moments:
    """Count, sums and products of columns (x..., y)."""

    n: float
    total: np.ndarray
    cross: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return self.total / self.n

    @property
    def scatter(self) -> np.ndarray:
        """Products about the mean."""
        return self.cross - np.outer(self.total, self.total) / self.n


def moments(rows: DataFrame, x: Column, y: Column) -> Moments:
    """Of the vector column x with y appended; rows with a null take no part."""

    def part(batches):
        n, total, cross = 0, None, None
        for batch in batches:
            values = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            if len(values):
                n += len(values)
                total = values.sum(0) if total is None else total + values.sum(0)
                cross = values.T @ values if cross is None else cross + values.T @ values
        if n:
            flat = np.concatenate([[float(n)], total, cross.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["k", "v"])

    whole = F.concat(x.cast("array<double>"), F.array(y.cast("double")))
    usable = rows.select(whole.alias("v")).where("v IS NOT NULL AND NOT exists(v, e -> e IS NULL)")
    sums = usable.mapInArrow(part, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").collect()  # p^2 numbers
    flat = np.array([r["v"] for r in sums])
    if not len(flat):
        raise ValueError("no usable rows")
    p = int((-1 + np.sqrt(1 + 4 * (len(flat) - 1))) / 2)
    return Moments(flat[0], flat[1 : p + 1], flat[p + 1 :].reshape(p, p))


def fold_moments(rows: DataFrame, x: Column, y: Column, fold: Column) -> dict[int, Moments]:
    """Moments of each fold (a whole number) in one pass; those of its training set are all others' less its own."""

    def part(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            values, folds = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1), batch.column(1).to_numpy()
            for k in np.unique(folds).tolist():
                own = values[folds == k]
                flat = np.concatenate([[float(len(own))], own.sum(0), (own.T @ own).ravel()])
                sums[k] = sums[k] + flat if k in sums else flat
        for k, flat in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), k)), pa.array(np.arange(len(flat))), pa.array(flat)], names=["fold", "k", "v"])

    whole = F.concat(x.cast("array<double>"), F.array(y.cast("double")))
    usable = rows.select(whole.alias("v"), fold.cast("long").alias("fold")).where("v IS NOT NULL AND fold IS NOT NULL AND NOT exists(v, e -> e IS NULL)")
    sums = usable.mapInArrow(part, "fold long, k long, v double").groupBy("fold", "k").agg(F.sum("v").alias("v")).toArrow()  # p^2 numbers a fold
    folds, places, values = (sums.column(c).to_numpy() for c in ("fold", "k", "v"))
    out = {}
    for k in np.unique(folds).tolist():
        flat = values[folds == k][np.argsort(places[folds == k])]
        p = int((-1 + np.sqrt(1 + 4 * (len(flat) - 1))) / 2)
        out[k] = Moments(flat[0], flat[1 : p + 1], flat[p + 1 :].reshape(p, p))
    return out


def cross_validated(by_fold: dict[int, Moments], fit: Callable[[Moments], Linear]) -> list[tuple[int | None, float, float]]:
    """(fold, n, R2) of models that did not see the fold, and (None, n, R2) of all held-out errors together.

    Errors of a fold are a quadratic form of its own moments, so that no row is read again.
    """
    names = ("n", "total", "cross")
    every = [sum(getattr(m, f) for m in by_fold.values()) for f in names]
    out, lost, spread = [], 0.0, 0.0
    for k, own in sorted(by_fold.items()):
        model = fit(Moments(*(a - getattr(own, f) for a, f in zip(every, names))))
        c, b = np.append(-model.weights, 1.0), model.intercept
        error = float(c @ own.cross @ c - 2 * b * (c @ own.total) + own.n * b * b)
        out.append((k, float(own.n), float(1 - error / own.scatter[-1, -1])))
        lost, spread = lost + error, spread + float(own.scatter[-1, -1])
    return [*out, (None, float(every[0]), 1 - lost / spread)]


@dataclass(frozen=True)
class Linear:
    intercept: float
    weights: np.ndarray
    sigma2: float
    inverse: np.ndarray  # pseudo-inverse of the scatter
    mean: np.ndarray
    n: float

    def predict(self, x: Column) -> Column:
        terms = F.zip_with(x.cast("array<double>"), F.array(*(F.lit(float(w)) for w in self.weights)), lambda a, w: a * w)
        return F.aggregate(terms, F.lit(float(self.intercept)), lambda s, v: s + v)

    def predict_variance(self, x: np.ndarray) -> np.ndarray:
        """Of the fitted mean at the rows of x."""
        d = np.asarray(x) - self.mean
        return self.sigma2 * (1 / self.n + np.einsum("ij,jk,ik->i", d, self.inverse, d))


def ridge(m: Moments, penalty: float = 1e-6) -> Linear:
    s = m.scatter
    a, b = s[:-1, :-1] + penalty * np.eye(len(s) - 1), s[:-1, -1]
    w = np.linalg.pinv(a) @ b
    rest = max(s[-1, -1] - 2 * w @ b + w @ s[:-1, :-1] @ w, 0.0)
    return Linear(float(m.mean[-1] - w @ m.mean[:-1]), w, rest / max(m.n - len(w) - 1, 1), np.linalg.pinv(a), m.mean[:-1], m.n)


def r2(m: Moments, model: Linear) -> float:
    s, w = m.scatter, model.weights
    return float(1 - (s[-1, -1] - 2 * w @ s[:-1, -1] + w @ s[:-1, :-1] @ w) / s[-1, -1])


@dataclass(frozen=True)
class Projection:
    """Scores are ((x - mean) / width) @ weights."""

    mean: np.ndarray
    width: np.ndarray
    weights: np.ndarray

    def scores(self, x: Column) -> Column:
        scaled = F.transform(F.arrays_zip(x.cast("array<double>").alias("x"), _array(self.mean).alias("m"), _array(self.width).alias("w")), lambda e: (e["x"] - e["m"]) / e["w"])
        one = lambda w: F.aggregate(F.zip_with(scaled, _array(w), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        return F.array(*(one(w) for w in self.weights.T))


def _array(values: np.ndarray) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def widths(m: Moments, scaling: str) -> np.ndarray:
    std = np.sqrt(np.maximum(np.diag(m.scatter)[:-1] / m.n, 0))
    w = {"standard": std, "pareto": np.sqrt(std), "center": np.ones_like(std)}[scaling]
    return np.where(w == 0, 1.0, w)


def pls(m: Moments, components: int, scaling: str = "standard") -> Projection:
    """SIMPLS for one response, from the moments alone; unit weight vectors, stops when nothing is left to explain."""
    w = widths(m, scaling)
    s = m.scatter[:-1, :-1] / np.outer(w, w)
    c = m.scatter[:-1, -1] / w
    basis, weights = np.zeros((len(c), 0)), []
    for _ in range(components):
        if np.linalg.norm(c) < 1e-12 * max(1.0, np.linalg.norm(m.scatter[:-1, -1] / w)):
            break
        r = c / np.linalg.norm(c)
        weights.append(r)
        load = s @ r
        v = load - basis @ (basis.T @ load)
        v -= basis @ (basis.T @ v)
        if np.linalg.norm(v) < 1e-12:
            break
        v /= np.linalg.norm(v)
        basis = np.column_stack([basis, v])
        c = c - v * (v @ c)
        c -= basis @ (basis.T @ c)
    return Projection(m.mean[:-1], w, np.column_stack(weights) if weights else np.zeros((len(c), 0)))


def pca(m: Moments, components: int, whiten: bool = False) -> Projection:
    """Leading directions of the centred scatter, signs fixed by the largest weight."""
    value, vector = np.linalg.eigh(m.scatter[:-1, :-1] / m.n)
    vector = vector[:, ::-1][:, :components]
    vector = vector * np.sign(vector[np.abs(vector).argmax(0), np.arange(vector.shape[1])])
    if whiten:
        vector = vector / np.sqrt(np.maximum(value[::-1][:components], 1e-12))
    return Projection(m.mean[:-1], np.ones(len(m.mean) - 1), vector)


def on_scores(m: Moments, projection: Projection, penalty: float = 0.0) -> Linear:
    """Least squares on the scores of a projection, as weights of the columns; from the moments alone."""
    a = projection.weights / projection.width[:, None]
    s = m.scatter
    beta = np.linalg.pinv(a.T @ s[:-1, :-1] @ a + penalty * np.eye(a.shape[1])) @ (a.T @ s[:-1, -1])
    w = a @ beta
    rest = max(s[-1, -1] - 2 * w @ s[:-1, -1] + w @ s[:-1, :-1] @ w, 0.0)
    return Linear(float(m.mean[-1] - w @ m.mean[:-1]), w, rest / max(m.n - len(beta) - 1, 1), a @ np.linalg.pinv(a.T @ s[:-1, :-1] @ a) @ a.T, m.mean[:-1], m.n)


def r2_on_scores(m: Moments, projection: Projection, components: int) -> float:
    """R2 of least squares on the first `components` scores, or on all where the projection stopped earlier."""
    return r2(m, on_scores(m, Projection(projection.mean, projection.width, projection.weights[:, :components])))


def canonical_correlations(m: Moments, split: int) -> np.ndarray:
    """Between the first `split` columns and the others but y."""
    s = m.scatter[:-1, :-1]

    def root(a: np.ndarray) -> np.ndarray:
        value, vector = np.linalg.eigh(a)
        good = value > 1e-10 * value.max()
        return vector[:, good] / np.sqrt(value[good])

    a, b = root(s[:split, :split]), root(s[split:, split:])
    return np.linalg.svd(a.T @ s[:split, split:] @ b, compute_uv=False)


@dataclass
class SparseProjection:
    """Weights of the columns of a long table (row, col, val), whose mean and width stand beside the values, never in them."""

    columns: list
    mean: np.ndarray
    width: np.ndarray
    weights: np.ndarray

    def table(self, spark: SparkSession) -> DataFrame:
        """(col, w): the weights over the widths, as arrays by component."""
        folded = (self.weights / self.width[:, None]).tolist()
        return spark.createDataFrame(pa.table({"col": pa.array(self.columns), "w": pa.array(folded, pa.list_(pa.float64()))}))

    def scores(self, entries: DataFrame, rows: DataFrame) -> DataFrame:
        """(row, component, score) of every row, those without entries too; entries of unknown columns are dropped."""
        offset = ((self.mean / self.width) @ self.weights).tolist()
        parts = entries.join(self.table(entries.sparkSession), "col").select("row", F.posexplode("w").alias("component", "w"), "val")
        sums = parts.groupBy("row", "component").agg(F.sum(F.col("val") * F.col("w")).alias("s"))
        every = rows.select("row", F.posexplode(F.array(*map(F.lit, offset)).cast("array<double>")).alias("component", "offset"))
        return every.join(sums, ["row", "component"], "left").select("row", "component", (F.coalesce("s", F.lit(0.0)) - F.col("offset")).alias("score"))


def sparse_pls(entries: DataFrame, targets: DataFrame, components: int, scaling: str = "pareto") -> SparseProjection:
    """SIMPLS over a long table (row, col, val) and (row, y), centred and divided by widths implicitly: two products a component.

    Widths are as in `scaled`: the population deviation, its root, or one. The matrix stays sparse, since centring and
    widths are rank-one corrections of the products. Vectors with an entry for each column come to the driver; the
    vocabulary bounds them. Rows of targets without entries count as rows of zeros.
    """
    spark = entries.sparkSession
    n, y_mean = targets.agg(F.count("*"), F.avg("y")).first()
    joined = entries.join(targets, "row")
    square = F.sum(F.col("val") * F.col("val"))
    first = joined.groupBy("col").agg(F.sum("val").alias("s"), square.alias("q"), F.sum(F.col("val") * (F.col("y") - F.lit(y_mean))).alias("c")).orderBy("col").toArrow()
    columns = first.column("col").to_pylist()
    mean, raw = first.column("s").to_numpy() / (n or 1), first.column("c").to_numpy()
    std = np.sqrt(np.maximum(first.column("q").to_numpy() / (n or 1) - mean**2, 0))
    width = {"standard": std, "pareto": np.sqrt(std), "center": np.ones_like(std)}[scaling]
    width = np.where(width == 0, 1.0, width)
    c, least = raw / width, 1e-12 * max(1.0, float(np.linalg.norm(raw / width)))
    known, basis, weights = entries.join(targets.select("row"), "row", "left_semi"), np.zeros((len(columns), 0)), []
    for _ in range(min(components, len(columns))):
        if np.linalg.norm(c) < least:
            break
        r = c / np.linalg.norm(c)
        one = SparseProjection(columns, mean, width, r[:, None])
        t = one.scores(known, targets.select("row"))
        back = known.join(t, "row").groupBy("col").agg(F.sum(F.col("val") * F.col("score")).alias("p")).toArrow()
        got = dict(zip(back.column("col").to_pylist(), back.column("p").to_pylist()))
        weights.append(r)
        load = np.array([got.get(k, 0.0) for k in columns]) / width  # scores sum to zero, so the means drop out
        v = load - basis @ (basis.T @ load)
        v -= basis @ (basis.T @ v)
        if np.linalg.norm(v) < 1e-12:
            break
        v /= np.linalg.norm(v)
        basis = np.column_stack([basis, v])
        c = c - v * (v @ c)
        c -= basis @ (basis.T @ c)
    return SparseProjection(columns, mean, width, np.column_stack(weights) if weights else np.zeros((len(columns), 0)))
