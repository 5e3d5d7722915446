"""Quantiles and binned sums over the pairs of a category, counted in tiles: no pair is written.

A pass over the tiles counts values by their leading bits; a second one gives the values whose bits hold a rank that is
asked for, and only these leave a task. Rank correlation sorts all values, in rounds of bounded size. Distances come from a matrix product, whose rounding would part equal ones; where
it could decide about a place or a value, they are computed again from differences, so ties stay ties.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skerry.operators import pairs
from skerry.session import collect_garbage, durable

# The error of a product is below 1e-13 of the squared lengths, which are below 1,000 squared distances (`distances`).
TILE, BITS, CLOSE = 1_024, 8, 1e-9
# Rank correlation: values in a task, values on disk at a time (16 to 20 bytes each), cells of a table, and what it may leave out.
PART, ROUND, CELLS, LOSS = 1 << 21, 3 << 24, 1 << 15, 1e-7


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """By a product of doubles about the mean of y; where the squared lengths nearly cancel, by differences."""
    mean = y.mean(0)
    x, y = x - mean, y - mean
    xx, yy = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
    d2 = (-2 * x) @ y.T
    d2 += xx[:, None]
    d2 += yy
    r = c = np.zeros(0, int)
    if d2.size and not d2.min() > 1e-3 * (xx.max() + yy.max()):
        r, c = np.nonzero(~(d2 > 1e-3 * (xx[:, None] + yy)))
    d = np.sqrt(np.maximum(d2, 0, out=d2), out=d2)
    d[r, c] = pairs._direct(x, y, r, c)
    return d


def with_target(points: DataFrame, y: str = "y", vector_col: str = "embedding") -> DataFrame:
    """points whose vector ends with y."""
    return points.withColumn(vector_col, F.concat(F.col(vector_col).cast("array<double>"), F.array(F.col(y).cast("double"))))


class Found:
    """Values of the pairs (r, c) of two tiles: `at` to within CLOSE, `exact` from differences; dy is |difference| of targets, if there are any."""

    def __init__(self, x: np.ndarray, y: np.ndarray, met: np.ndarray, spans: list[tuple[int, int]], combine: Callable[[list[np.ndarray]], list[np.ndarray]], target: bool):
        self.x, self.y, self.met, self.spans, self.combine, self.target = x, y, met, spans, combine, target
        if not target:
            self.dy = None

    @cached_property
    def places(self) -> tuple[np.ndarray, np.ndarray]:
        return np.nonzero(self.met)

    @property
    def r(self) -> np.ndarray:
        return self.places[0]

    @property
    def c(self) -> np.ndarray:
        return self.places[1]

    @cached_property
    def at(self) -> list[np.ndarray]:
        return self.combine([distances(self.x[:, s:e], self.y[:, s:e])[self.met] for s, e in self.spans])

    @cached_property
    def dy(self) -> np.ndarray:
        return np.abs(self.x[self.r, -1] - self.y[self.c, -1])

    def between(self, low: float, high: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places (r, c) and distances over the first span of the pairs that may be between low and high, and some more."""
        (s, e), x, y = self.spans[0], self.x, self.y
        d2, xx, error = pairs._Near(y[:, s:e])(x[:, s:e])
        some = self.met.copy()
        if error < np.inf:
            some &= (d2 >= (low * low - xx - 2 * error)[:, None]) & (d2 <= (high * high - xx + 2 * error)[:, None])
        r, c = np.nonzero(some)
        return r, c, pairs._direct(x[:, s:e], y[:, s:e], r, c)

    def exact(self, v: int, some: np.ndarray) -> np.ndarray:
        return self.combine([pairs._direct(self.x[:, s:e], self.y[:, s:e], self.r[some], self.c[some]) for s, e in self.spans])[v]

    def placed(self, v: int, place: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """place (which rises with the value) of the exact values."""
        a = self.at[v]
        out = place(a)
        some = np.flatnonzero(place(a * (1 - CLOSE)) != place(a * (1 + CLOSE)))
        if len(some):
            out[some] = place(self.exact(v, some))
        return out


class Pairs:
    """Pairs i < j of the categories of points; values are `combine` of the distances by spans of the vector, which must keep relative errors.

    `whole` takes all categories as one group; with `target` the vector's last place is a target and no part of a span.
    """

    def __init__(self, points: DataFrame, spans: list[tuple[int, int]], combine: Callable[[list[np.ndarray]], list[np.ndarray]] = list, whole: bool = True, target: bool = False, id_col: str = "vec_id", cat_col: str = "label", vector_col: str = "embedding"):
        self.sides, self.spans, self.combine, self.whole, self.target = pairs._tiles(points, id_col, cat_col, vector_col, None), spans, combine, whole, target
        self.kind = "int" if whole else points.schema[cat_col].dataType.simpleString()

    def passed(self, work: Callable[[object, Found], dict[str, np.ndarray]], schema: str) -> DataFrame:
        """(g, schema...): what work gives for the group and the pairs of blocks of two tiles; tiles are larger than blocks, since rows are sent once a tile."""
        spans, combine, whole, target = self.spans, self.combine, self.whole, self.target
        fields = pairs.pa_fields(schema)

        def run(key, a: pa.Table, b: pa.Table) -> pa.Table:
            empty = pa.table({"g": pa.nulls(0, pa.int32() if whole else key[0].type), **{n: pa.array([], t) for n, t in fields.items()}})
            if not (a.num_rows and b.num_rows):
                return empty
            same = key[1].as_py() == key[2].as_py()
            a, b = a.sort_by("id"), b.sort_by("id")
            x, y = pairs._matrix(a.column("z")), pairs._matrix(b.column("z"))
            pairs._same_length(x, y)
            qi, ci = a.column("id").to_numpy(), b.column("id").to_numpy()
            parts = []
            for s in range(0, len(x), TILE):
                for t in range(0, len(y), TILE):
                    one, two = qi[s : s + TILE, None], ci[None, t : t + TILE]
                    met = one < two if same else one != two
                    if met.any():
                        parts.append(work(0 if whole else key[0].as_py(), Found(x[s : s + TILE], y[t : t + TILE], met, spans, combine, target)))
            if not parts:
                return empty
            found = {k: [v for p in parts for v in p[k]] if t == pa.binary() else np.concatenate([p[k] for p in parts]) for k, t in fields.items()}
            n = len(next(iter(found.values())))
            return pa.table({"g": pa.repeat(pa.scalar(0, pa.int32()) if whole else key[0], n), **{k: pa.array(found[k], t) for k, t in fields.items()}}) if n else empty

        left, right = self.sides
        return left.groupBy("cat", "q", "c").cogroup(right.groupBy("cat", "q", "c")).applyInArrow(run, f"g {self.kind}, {schema}")

    def histogram(self) -> DataFrame:
        """(g, v, bucket, n, before): how often the v-th value has these leading bits, and how often smaller ones."""

        def count(g, found: Found) -> dict[str, np.ndarray]:
            parts = []
            for v in range(len(found.at)):
                b = found.placed(v, _bucket)
                if len(b):
                    n = np.bincount(b - b.min())
                    some = np.flatnonzero(n)
                    parts.append((np.full(len(some), v), some + b.min(), n[some]))
            v, b, n = (np.concatenate(p) for p in zip(*parts)) if parts else [np.zeros(0, int)] * 3
            return {"v": v, "bucket": b, "n": n}

        counts = self.passed(count, "v int, bucket long, n long").groupBy("g", "v", "bucket").agg(F.sum("n").alias("n"))
        before = F.sum("n").over(Window.partitionBy("g", "v").orderBy("bucket")) - F.col("n")  # buckets are some ten thousand, whatever the rows
        return durable(counts.withColumn("before", before))

    def at_ranks(self, histogram: DataFrame, ranks: dict[tuple[object, int], list[int]]) -> dict[tuple[object, int], dict[int, tuple[float, int]]]:
        """For each (g, v), and each rank from 0, the value there and the number of smaller ones; results are as many as ranks."""
        asked = [(g, v, int(r)) for (g, v), found in ranks.items() for r in sorted(set(found))]
        want = histogram.sparkSession.createDataFrame(asked, f"g {self.kind}, v int, rank long")
        held = histogram.join(F.broadcast(want), histogram["g"].eqNullSafe(want["g"]) & (histogram["v"] == want["v"]))
        held = held.where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n")))
        places = [(r["g"], r["v"], r["bucket"], r["before"], r["rank"]) for r in held.select(histogram["g"], histogram["v"], "bucket", "before", "rank").collect()]
        chosen: dict[tuple[object, int], np.ndarray] = {}
        for g, v, b, *_ in places:
            chosen[g, v] = np.union1d(chosen.get((g, v), np.zeros(0, np.int64)), [b])

        def inside(g, found: Found) -> dict[str, np.ndarray]:
            parts = []
            for v in range(len(found.at)):
                own = chosen.get((g, v))
                if own is not None:
                    b = found.placed(v, _bucket)
                    low = int(own[0])
                    table = np.zeros(int(own[-1]) - low + 2, bool)
                    table[own - low] = True
                    some = np.flatnonzero(table[np.clip(b - low, -1, len(table) - 1)])  # the last place is never chosen
                    value, n = np.unique(found.exact(v, some), return_counts=True)
                    parts.append((np.full(len(value), v), _bucket(value), value, n))
            v, b, x, n = (np.concatenate(p) for p in zip(*parts)) if parts else (np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0, int))
            return {"v": v, "bucket": b, "value": x, "n": n}

        values = self.passed(inside, "v int, bucket long, value double, n long").groupBy("g", "v", "bucket", "value").agg(F.sum("n").alias("n"))
        w = Window.partitionBy("g", "v", "bucket").orderBy("value")
        values = values.withColumn("less", F.sum("n").over(w) - F.col("n"))
        within = histogram.sparkSession.createDataFrame([(g, v, b, before, r - before, r) for g, v, b, before, r in places], f"g_ {self.kind}, v_ int, bucket_ long, before long, at long, rank long")
        met = values.join(F.broadcast(within), F.col("g").eqNullSafe(F.col("g_")) & (F.col("v") == F.col("v_")) & (F.col("bucket") == F.col("bucket_")))
        met = met.where((F.col("less") <= F.col("at")) & (F.col("at") < F.col("less") + F.col("n")))
        out: dict[tuple[object, int], dict[int, tuple[float, int]]] = {k: {} for k in ranks}
        for r in met.select("g", "v", "rank", "value", (F.col("before") + F.col("less")).alias("before")).collect():
            out[r["g"], r["v"]][r["rank"]] = (r["value"], r["before"])
        return out

    def quantiles(self, points: list[float]) -> tuple[DataFrame, dict[tuple[object, int], list[float]]]:
        """The histogram, and for each (g, v) its quantiles by linear interpolation."""
        histogram = self.histogram()
        sizes = {(r["g"], r["v"]): r["n"] for r in histogram.groupBy("g", "v").agg(F.sum("n").alias("n")).collect()}
        ends = {k: [(int(np.floor(p * (n - 1))), int(np.ceil(p * (n - 1))), p * (n - 1) - np.floor(p * (n - 1))) for p in points] for k, n in sizes.items()}
        found = self.at_ranks(histogram, {k: [r for low, high, _ in e for r in (low, high)] for k, e in ends.items()}) if sizes else {}
        between = lambda a, b, t: a if a == b else a * (1 - t) + b * t
        return histogram, {k: [float(between(found[k][low][0], found[k][high][0], t)) for low, high, t in e] for k, e in ends.items()}

    def summed(self, terms: Callable[[object, Found], tuple[np.ndarray, list[np.ndarray]]], names: list[str]) -> DataFrame:
        """(g, bin, n, names...): counts and sums by the bins that terms gives with its values; rows of bin -1 go."""

        def add(g, found: Found) -> dict[str, np.ndarray]:
            bins, values = terms(g, found)
            n = np.bincount(bins + 1)
            some = np.flatnonzero(n[1:]) + 1 if len(n) else np.zeros(0, int)
            return {"bin": some - 1, "n": n[some], **{k: np.bincount(bins + 1, v, len(n))[some] for k, v in zip(names, values)}}

        sums = self.passed(add, "bin int, n long" + "".join(f", {k} double" for k in names))
        return sums.groupBy("g", "bin").agg(*(F.sum(k).alias(k) for k in ("n", *names)))


def _bucket(x: np.ndarray) -> np.ndarray:
    """Leading bits of values that are not negative; larger values never have smaller ones."""
    return (x.astype(np.float32) + np.float32(0)).view(np.int32).astype(np.int64) >> BITS


class Cells:
    """The ranks of values by their leading bits: buckets put together into cells of about equal counts."""

    def __init__(self, bucket: np.ndarray, n: np.ndarray, cells: int, part: int):
        order = np.argsort(bucket)
        bucket, n = bucket[order], n[order].astype(np.float64)
        self.total, before = float(n.sum()), np.cumsum(n) - n
        first = np.flatnonzero(np.diff(np.floor(before * cells / self.total), prepend=-1))
        self.starts, self.before = bucket[first], before[first]
        self.size = np.diff(self.before, append=self.total)
        self.middle = self.before + self.size / 2 - self.total / 2  # of ranks less their mean
        self.part, self.in_part = np.floor(self.before / part).astype(np.int64), part

        self._places: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_places": None}

    def of(self, bucket: np.ndarray) -> np.ndarray:
        """The cell of each bucket that occurs; other ones are given some cell."""
        if self._places is None:
            self._places = np.searchsorted(self.starts, np.arange(self.starts[0], self.starts[-1] + 1), "right").astype(np.int32) - 1
        return self._places[np.clip(bucket - self.starts[0], 0, len(self._places) - 1)]

    def ends(self, first: int, last: int) -> tuple[float, float]:
        """What the values of these parts lie between, and a little more."""
        value = lambda b: float(np.int32(b << BITS).view(np.float32))
        after = np.searchsorted(self.part, last, "right")
        high = value(self.starts[after]) * (1 + 1e-6) if after < len(self.starts) else np.inf
        return value(self.starts[np.searchsorted(self.part, first)]) * (1 - 1e-6), high

    def hot(self) -> set[int]:
        """Parts of more values than a task should hold, which equal values must make up: tasks count them before they send them."""
        size = np.bincount(self.part, self.size)
        return set(np.flatnonzero(size > 2 * self.in_part).tolist())

    def rounds(self, most: int) -> list[tuple[int, int]]:
        """First and last part of each round of about `most` values."""
        at = self.part // max(1, most // self.in_part)
        return [(int(self.part[at == k].min()), int(self.part[at == k].max())) for k in np.unique(at)]


def rank_correlation(points: DataFrame, y: str = "y", cat_col: str = "label", part: int | None = None, most: int | None = None) -> tuple[int, float | None, float]:
    """n, Spearman's rho of distance and |difference of y| over the pairs i < j of a category, ties averaged, and a bound on what rho leaves out.

    With r the rank by distance, a the other one and R, A the middle ranks of their cells, the sum of r a is that of r A, plus that
    of R a, less that of R A, plus that of (r - R)(a - A). The first three are exact: values are sorted, a part of the ranks in a
    task and `most` of them on disk at a time. The last one is at most the root of the product of the two sums of squares;
    cells are 1/32,768 of the values, so that it is some 1e-9 of rho. Rho is null where either side has no spread.
    """
    part, most = part or PART, most or ROUND
    every = Pairs(with_target(points, y), [(0, -1)], target=True, cat_col=cat_col)

    def count(g, found: Found) -> dict[str, np.ndarray]:
        out = []
        for v, b in enumerate((found.placed(0, _bucket), _bucket(found.dy))):
            value, n = np.unique(b, return_counts=True)
            out.append((np.full(len(value), v), value, n))
        return dict(zip(("v", "bucket", "n"), map(np.concatenate, zip(*out))))

    held = every.passed(count, "v int, bucket long, n long").groupBy("v", "bucket").agg(F.sum("n").alias("n")).toArrow()  # follows the bits
    v, bucket, n = (held.column(c).to_numpy() for c in ("v", "bucket", "n"))
    if not len(v):
        return 0, None, 0.0
    cells = [Cells(bucket[v == k], n[v == k], CELLS, part) for k in (0, 1)]
    total = int(cells[0].total)

    def sent(k: int, first: int, last: int) -> Callable[[object, Found], dict[str, np.ndarray]]:
        low, high = cells[k].ends(first, last)
        hot = cells[k].hot()

        def send(g, found: Found) -> dict[str, np.ndarray]:
            if k == 0:
                r, c, x = found.between(low, high)
                other = np.abs(found.x[r, -1] - found.y[c, -1])
            else:
                x = np.abs(found.x[:, None, -1] - found.y[None, :, -1])
                r, c = np.nonzero(found.met & (x >= low) & (x <= high))
                x, other = x[r, c], pairs._direct(found.x[:, :-1], found.y[:, :-1], r, c)
            parts = cells[k].part[cells[k].of(_bucket(x))]
            some = np.flatnonzero((parts >= first) & (parts <= last))
            x, parts, other = x[some] + 0.0, parts[some] - first, cells[1 - k].middle[cells[1 - k].of(_bucket(other[some]))]
            order = np.argsort(parts.astype(np.uint16) if last - first < 1 << 16 else parts, kind="stable")
            x, parts, other = x[order], parts[order], other[order]
            cuts = np.flatnonzero(np.diff(parts, prepend=-1))
            out: dict[str, list] = {"part": [], "x": [], "other": [], "times": []}
            for s, e in zip(cuts.tolist(), np.append(cuts[1:], len(x)).tolist()):
                p, v, o, n = int(parts[s]) + first, x[s:e], other[s:e], b""
                if p in hot:
                    v, at, times = np.unique(v, return_inverse=True, return_counts=True)
                    o, n = np.bincount(at, o), times.astype(np.int32).tobytes()
                for name, value in zip(out, (p, v.tobytes(), o.tobytes(), n)):
                    out[name].append(value)
            return out | {"part": np.array(out["part"], np.int64)}

        return send

    def ranked(k: int) -> Callable[[tuple[pa.Scalar, ...], pa.Table], pa.Table]:
        def rank(key: tuple[pa.Scalar, ...], a: pa.Table) -> pa.Table:
            xs = [np.frombuffer(b.as_buffer()) for b in a.column("x")]
            other = np.concatenate([np.frombuffer(b.as_buffer()) for b in a.column("other")])
            times = np.concatenate([np.frombuffer(b.as_buffer(), np.int32) if len(b.as_buffer()) else np.ones(len(x), np.int32) for b, x in zip(a.column("times"), xs)])
            x = np.concatenate(xs)
            order = np.argsort(x)
            x = x[order]
            own = np.flatnonzero(np.diff(x, prepend=-1.0))
            x, other, times = x[own], np.add.reduceat(other[order], own), np.add.reduceat(times[order].astype(np.float64), own)
            mine = cells[k]
            r = mine.before[np.searchsorted(mine.part, key[0].as_py())] + np.cumsum(times) - times / 2 - mine.total / 2
            middle = mine.middle[mine.of(_bucket(x))]
            sums = (r @ other, middle @ other, (times * r) @ r, (times * (r - middle)) @ (r - middle))
            return pa.table({c: [float(s)] for c, s in zip(names, sums)})

        return rank

    names, found = ("own", "cell", "square", "rest"), []
    for k in (0, 1):
        sums = np.zeros(4)
        for first, last in cells[k].rounds(most):
            values = every.passed(sent(k, first, last), "part long, x binary, other binary, times binary")
            row = values.groupBy("part").applyInArrow(ranked(k), "own double, cell double, square double, rest double").agg(*map(F.sum, names)).first()
            sums += [s or 0.0 for s in row]
            collect_garbage(points.sparkSession)
        found.append(sums)
    (one, both, square, rest), (two, _, square2, rest2) = found
    spread = float(np.sqrt(square * square2))
    return total, float(one + two - both) / spread if spread else None, float(np.sqrt(rest * rest2)) / spread if spread else 0.0
