"""Pair, kernel and neighbour queries on `embeddings`; channels a and b are its first and last 32 dimensions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.functions import kernels
from skerry.operators import order_stats, pair_order, pairs
from skerry.operators.gaussian import distances, wendland_c2
from skerry.session import table

WHOLE = {"z": (1, 64)}
CHANNELS = {"a": (1, 32), "b": (33, 32)}
SPANS = [(first - 1, first - 1 + size) for first, size in CHANNELS.values()]
Q = {}
O = {}  # noqa: E741


def both(sql: str):
    def put(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return put


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, embedding and a target that is a function of the vector."""
    e = table(spark, sf_dir, "embeddings")
    z = lambda k: F.element_at("embedding", k).cast("double")
    return e.withColumn("y", 10 * z(1) + 5 * z(2) * z(3) + F.col("label"))


P = """p AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, 10 * embedding[1]::DOUBLE + 5 * (embedding[2]::DOUBLE) * (embedding[3]::DOUBLE) + label AS y FROM embeddings)"""
D = f"""{P}, d AS (SELECT a.vec_id AS i, b.vec_id AS j, a.label AS cat, a.y AS yi, b.y AS yj, list_distance(a.e, b.e) AS d,
  list_distance(a.e[1:32], b.e[1:32]) AS da, list_distance(a.e[33:64], b.e[33:64]) AS db FROM p a JOIN p b ON a.label = b.label AND a.vec_id < b.vec_id)"""
N = f"""{P}, n AS (SELECT q.vec_id AS query_id, c.vec_id AS neighbour_id, q.label AS ql, c.label AS cl, q.y AS qy, c.y AS cy, list_distance(q.e, c.e) AS d
  FROM p q JOIN p c ON q.vec_id <> c.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, neighbour_id) AS rank FROM n),
  s AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, neighbour_id) AS rank FROM n WHERE ql = cl)"""
W2 = lambda t: f"(CASE WHEN {t} < 1 THEN power(1 - {t}, 4) * (4 * {t} + 1) ELSE 0 END)"


@both(f"WITH {D} SELECT cat, count(*) AS nnz, round(sum({W2('d / 1.3::DOUBLE')}), 6) AS mass, round(min(d), 6) AS dmin FROM d WHERE d < 1.3 GROUP BY cat")
def gram_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs.category_pairs(points(spark, sf_dir), WHOLE, within={"z": 1.3})
    k = kernels.wendland_c2(kernels.scaled(F.col("d_z"), 1.3))
    return p.groupBy("cat").agg(F.count("*").alias("nnz"), F.round(F.sum(k), 6).alias("mass"), F.round(F.min("d_z"), 6).alias("dmin"))


@both(f"WITH {D} SELECT cat, count(*) AS nnz, round(sum(0.6 * {W2('da / 0.95::DOUBLE')} + 0.4 * {W2('db / 0.9::DOUBLE')}), 6) AS mass FROM d WHERE da < 0.95 OR db < 0.9 GROUP BY cat")
def gram_additive(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs.category_pairs(points(spark, sf_dir), CHANNELS, within={"a": 0.95, "b": 0.9}, every=False)
    k = kernels.additive([(0.6, F.col("d_a"), 0.95), (0.4, F.col("d_b"), 0.9)])
    return p.groupBy("cat").agg(F.count("*").alias("nnz"), F.round(F.sum(k), 6).alias("mass"))


@both(f"WITH {D} SELECT cat, count(*) AS nnz, round(sum(2 * {W2('da / 1.1::DOUBLE')} * {W2('db / 1.1::DOUBLE')}), 6) AS mass FROM d WHERE da < 1.1 AND db < 1.1 GROUP BY cat")
def gram_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs.category_pairs(points(spark, sf_dir), CHANNELS, within={"a": 1.1, "b": 1.1})
    k = kernels.product(2.0, [(F.col("d_a"), 1.1), (F.col("d_b"), 1.1)])
    return p.groupBy("cat").agg(F.count("*").alias("nnz"), F.round(F.sum(k), 6).alias("mass"))


@both(f"""WITH {D}, r AS (SELECT cat, quantile_cont(d, 0.3) AS rho FROM d GROUP BY cat)
  SELECT cat, count(*) AS nnz, round(rho, 6) AS rho, round(sum({W2('d / rho')}), 6) AS mass FROM d JOIN r USING (cat) WHERE d < rho GROUP BY cat, rho""")
def gram_percat_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = pair_order.Pairs(points(spark, sf_dir), [(0, 64)], whole=False)
    radii = {g: q[0] for (g, _), q in every.quantiles([0.3])[1].items()}

    def near(g, d: pair_order.Found) -> tuple[np.ndarray, list[np.ndarray]]:
        return -d.placed(0, lambda a: (a >= radii[g]).astype(int)), [wendland_c2(d.at[0] / radii[g])]

    rho = spark.createDataFrame([(g, round(r, 6)) for g, r in radii.items()], f"cat {every.kind}, rho double")  # a row a category
    sums = every.summed(near, ["mass"]).select(F.col("g").alias("cat"), F.col("n").alias("nnz"), F.round("mass", 6).alias("mass"))
    return sums.join(F.broadcast(rho), "cat")


@both(f"""WITH {N}, k AS (SELECT query_id AS id, 0.9 * d AS l FROM s WHERE rank = 5), g AS (SELECT q.ql AS cat, a.l AS la, b.l AS lb, q.d FROM n q JOIN k a ON a.id = query_id JOIN k b ON b.id = neighbour_id WHERE ql = cl AND query_id < neighbour_id)
  SELECT cat, count(*) AS nnz, round(sum(power(2 * la * lb / (la * la + lb * lb), 32) * {W2('d / sqrt(la * la + lb * lb)')}), 6) AS mass FROM g WHERE d < sqrt(la * la + lb * lb) GROUP BY cat""")
def gram_gibbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    scale = pairs.local_scales(pairs.nearest(p, 5), p.select(F.col("vec_id").alias("id")), 5).select(F.col("id").alias("vec_id"), F.array(0.9 * F.col("sigma")).alias("l"))
    p = p.join(scale, "vec_id").withColumn("embedding", F.concat(F.col("embedding").cast("array<double>"), "l"))

    def gibbs(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        a, b = x[:, -1:], y[:, -1:].T
        t = distances(x[:, :-1], y[:, :-1]) / np.sqrt(a * a + b * b)
        return [(t < 1).astype(float), (2 * a * b / (a * a + b * b)) ** 32 * wendland_c2(t)]

    sums = pairs.pair_sums(p, ["nnz", "mass"], gibbs).where("nnz > 0")
    return sums.select("cat", F.col("nnz").cast("long").alias("nnz"), F.round("mass", 6).alias("mass"))


@both(f"""WITH {D} SELECT cat, round(sum(CASE WHEN d < 1.4 THEN power(1 - d / 1.4::DOUBLE, 5) * (5 * d / 1.4::DOUBLE + 1) ELSE 0 END), 6) AS psi_3_1_l4,
  round(sum(CASE WHEN d < 1.4 THEN power(1 - d / 1.4::DOUBLE, 8) * (35 * power(d / 1.4::DOUBLE, 3) + 25 * power(d / 1.4::DOUBLE, 2) + 8 * d / 1.4::DOUBLE + 1) ELSE 0 END), 6) AS octic_35,
  round(sum(CASE WHEN d < 1.4 THEN power(1 - d / 1.4::DOUBLE, 8) * (32 * power(d / 1.4::DOUBLE, 3) + 25 * power(d / 1.4::DOUBLE, 2) + 8 * d / 1.4::DOUBLE + 1) ELSE 0 END), 6) AS psi_3_3,
  round(sum((1 + sqrt(5::DOUBLE) * d / 0.8::DOUBLE + 5 * d * d / (3 * 0.64::DOUBLE)) * exp(-sqrt(5::DOUBLE) * d / 0.8::DOUBLE)), 6) AS matern52, round(sum(exp(-d / 0.5::DOUBLE)), 6) AS exponential, round(sum(exp(-d * d / (2 * 0.25::DOUBLE))), 6) AS gaussian FROM d GROUP BY cat""")
def kernel_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["psi_3_1_l4", "octic_35", "psi_3_3", "matern52", "exponential", "gaussian"]

    def family(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        d = distances(x, y)
        t, r = np.minimum(d / 1.4, 1.0), math.sqrt(5) * d / 0.8
        octic = lambda a: (1 - t) ** 8 * (a * t**3 + 25 * t**2 + 8 * t + 1)
        return [(1 - t) ** 5 * (5 * t + 1), octic(35), octic(32), (1 + r + r * r / 3) * np.exp(-r), np.exp(-d / 0.5), np.exp(-d * d / (2 * 0.25))]

    sums = pairs.pair_sums(points(spark, sf_dir), names, family)
    return sums.select("cat", *(F.round(n, 6).alias(n) for n in names))


@both(f"""WITH {P}, b AS (SELECT a.label AS cat, a.vec_id AS i, b.vec_id AS j, list_reduce(list_transform(list_zip(a.e, b.e), lambda x: power(1 - least(abs(x[1] - x[2]) / 2::DOUBLE, 1), 3) * (3 * least(abs(x[1] - x[2]) / 2::DOUBLE, 1) + 1)), lambda s, v: s * v) AS k
  FROM p a JOIN p b ON a.label = b.label AND a.vec_id < b.vec_id) SELECT cat, count_if(k > 0) AS nnz, round(sum(k), 9) AS mass FROM b GROUP BY cat""")
def kernel_box_product(spark: SparkSession, sf_dir: str) -> DataFrame:

    def box(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        k = np.ones((len(x), len(y)))
        for n in range(x.shape[1]):
            t = np.minimum(np.abs(x[:, n, None] - y[None, :, n]) / 2.0, 1.0)
            k *= (1 - t) ** 3 * (3 * t + 1)
        return [(k > 0).astype(float), k]

    sums = pairs.pair_sums(points(spark, sf_dir), ["nnz", "mass"], box)
    return sums.select("cat", F.col("nnz").cast("long").alias("nnz"), F.round("mass", 9).alias("mass"))


@both(f"""WITH {D}, k AS (SELECT i, j, {W2('d / 1.3::DOUBLE')} AS k FROM d WHERE d < 1.3) SELECT i, j, round(sqrt(2 - 2 * k), 6) AS kd FROM k""")
def kernel_to_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs.category_pairs(points(spark, sf_dir), WHOLE, within={"z": 1.3})
    one = F.lit(1.0)
    return p.select("i", "j", F.round(kernels.kernel_distance(one, one, kernels.wendland_c2(kernels.scaled(F.col("d_z"), 1.3))), 6).alias("kd"))


@both(f"WITH {N} SELECT query_id AS i, neighbour_id AS j, round(d, 6) AS d FROM n WHERE query_id < neighbour_id AND d < 1.1")
def pair_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.tiled_range_join(points(spark, sf_dir), 1.1).withColumn("d", F.round("d", 6))


@both(f"WITH {N} SELECT query_id, rank::INTEGER AS rank, neighbour_id, round(d, 6) AS d FROM s WHERE rank <= 5")
def knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.nearest(points(spark, sf_dir), 5).withColumn("d", F.round("d", 6))


@both(f"WITH {N} SELECT query_id AS vec_id, round(min(d), 6) AS nn, round(min(d) FILTER (ql = cl), 6) AS nn_same FROM n GROUP BY query_id")
def nn_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    one = lambda cat, name: pairs.nearest(p, 1, cat_col=cat).select(F.col("query_id").alias("vec_id"), F.round("d", 6).alias(name))
    return one(None, "nn").join(one("label", "nn_same"), "vec_id", "left")


@both(f"""WITH {N}, c AS (SELECT query_id, count_if(d < 1.0) AS c0, count_if(d < 1.2) AS c1, count_if(d < 1.4) AS c2 FROM n WHERE ql = cl GROUP BY query_id)
  SELECT round(quantile_cont(c0::DOUBLE, 0.5), 6) AS m0, round(quantile_cont(c1::DOUBLE, 0.5), 6) AS m1, round(quantile_cont(c2::DOUBLE, 0.5), 6) AS m2, max(c2) AS most, count_if(c1 = 0) AS isolated FROM c""")
def radius_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = pairs.neighbour_counts(points(spark, sf_dir), [1.0, 1.2, 1.4])
    sums = c.agg(F.max("c2").alias("most"), F.count_if(F.col("c1") == 0).alias("isolated"))
    return sums.select(*(F.round(order_stats.quantile_at(c, f"c{k}", 0.5).scalar(), 6).alias(f"m{k}") for k in range(3)), "most", "isolated")


@both(f"WITH {N} SELECT query_id AS id, round(d, 6) AS sigma FROM s WHERE rank = 7")
def local_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return pairs.local_scales(pairs.nearest(p, 7), p.select(F.col("vec_id").alias("id")), 7).withColumn("sigma", F.round("sigma", 6))


@both(f"WITH {N} SELECT round(quantile_cont(d, 0.5), 6) AS rho FROM s WHERE rank = 11")
def radius_for_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Global policy: the median distance of the (k+1)-th neighbour, k = 10."""
    return pairs.nearest(points(spark, sf_dir), 11).where("rank = 11").transform(lambda d: order_stats.quantile_at(d, "d", 0.5)).select(F.round("value", 6).alias("rho"))


@both(f"WITH {N}, m AS (SELECT ql AS cat, least(10, count(DISTINCT query_id) - 1) AS k FROM s GROUP BY ql) SELECT ql AS cat, k::BIGINT AS k, round(quantile_cont(d, 0.5), 6) AS rho FROM s JOIN m ON m.cat = ql AND m.k = rank GROUP BY ql, k")
def radius_per_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category policy: the median distance of the k-th neighbour, k = 10 or all others in a smaller category."""
    p = points(spark, sf_dir)
    sizes = p.groupBy(F.col("label").alias("cat")).agg(F.least(F.lit(10).cast("long"), F.count("*") - 1).alias("k"))
    near = pairs.nearest(p, 10).join(p.select(F.col("vec_id").alias("query_id"), F.col("label").alias("cat")), "query_id").join(sizes, "cat").where("rank = k")
    return order_stats.medians(near, ["cat", "k"], "d", "rho").withColumn("rho", F.round("rho", 6))


@both(f"""WITH {D}, n AS (SELECT count(*) AS n FROM embeddings), r AS (SELECT unnest([1.1, 1.2, 1.3, 1.35]::DOUBLE[]) AS radius)
  SELECT radius, count_if(d < radius) AS pairs, round((2 * count_if(d < radius) + max(n)) / (max(n)::DOUBLE * max(n)), 9) AS density, (12 * (2 * count_if(d < radius) + max(n)))::BIGINT AS csr_bytes FROM d CROSS JOIN r CROSS JOIN n GROUP BY radius""")
def sparsity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    n = p.agg(F.count("*").alias("n"))
    radii = F.explode(F.array(*(F.lit(r) for r in (1.1, 1.2, 1.3, 1.35))))
    c = pairs.category_pairs(p, WHOLE, within={"z": 1.35}).select("d_z", radii.alias("radius")).groupBy("radius").agg(F.count_if(F.col("d_z") < F.col("radius")).alias("pairs"))
    nnz = 2 * F.col("pairs") + F.col("n")
    return c.withColumn("n", n.scalar()).select("radius", "pairs", F.round(nnz / (F.col("n").cast("double") * F.col("n")), 9).alias("density"), (12 * nnz).alias("csr_bytes"))


@both(f"WITH {N} SELECT round(avg((ql = cl)::INT), 6) AS purity, round(avg(d) FILTER (ql <> cl) / avg(d) FILTER (ql = cl), 6) AS separation FROM r WHERE rank <= 10")
def knn_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    near = with_labels(pairs.nearest(p, 10, cat_col=None), p)
    same = F.col("ql") == F.col("cl")
    return near.agg(F.round(F.avg(same.cast("int")), 6).alias("purity"), F.round(F.avg(F.when(~same, F.col("d"))) / F.avg(F.when(same, F.col("d"))), 6).alias("separation"))


def with_labels(near: DataFrame, p: DataFrame) -> DataFrame:
    q = p.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql"), F.col("y").alias("qy"))
    c = p.select(F.col("vec_id").alias("neighbour_id"), F.col("label").alias("cl"), F.col("y").alias("cy"))
    return near.join(q, "query_id").join(c, "neighbour_id")


@both(f"WITH {N} SELECT ql, cl, count(*) AS n FROM r WHERE rank <= 10 GROUP BY ql, cl")
def cross_category_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return with_labels(pairs.nearest(p, 10, cat_col=None), p).groupBy("ql", "cl").agg(F.count("*").alias("n"))


@both(f"""WITH {D}, q AS (SELECT quantile_cont(da, 0.1) AS ra, quantile_cont(db, 0.1) AS rb FROM d)
  SELECT round(ra, 6) AS ra, round(rb, 6) AS rb, round(avg((da < ra AND db < rb)::INT) / (avg((da < ra)::INT) * avg((db < rb)::INT)), 6) AS lift FROM d CROSS JOIN q GROUP BY ra, rb""")
def channel_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    both_ = pair_order.Pairs(points(spark, sf_dir), SPANS)
    found = both_.quantiles([0.1])[1]
    if not found:
        return spark.createDataFrame([], "ra double, rb double, lift double")
    (ra,), (rb,) = found[0, 0], found[0, 1]

    def near(g, d: pair_order.Found) -> tuple[np.ndarray, list[np.ndarray]]:
        x, y = d.placed(0, lambda a: (a >= ra).astype(float)) == 0, d.placed(1, lambda b: (b >= rb).astype(float)) == 0
        return np.zeros(len(x), int), [x, y, x * y]

    sums = both_.summed(near, ["a", "b", "both"])
    rate = lambda c: F.col(c) / F.col("n")
    return sums.select(F.round(F.lit(ra), 6).alias("ra"), F.round(F.lit(rb), 6).alias("rb"), F.round(rate("both") / (rate("a") * rate("b")), 6).alias("lift"))


@both(f"WITH {N}, m AS (SELECT query_id, qy, avg(cy) AS mu FROM s WHERE rank <= 5 GROUP BY query_id, qy) SELECT round(1 - avg((qy - mu) * (qy - mu)) / var_pop(qy), 6) AS skill, round(1 - avg(abs(qy - mu)) / avg(abs(qy - (SELECT avg(y) FROM p))), 6) AS mae_skill FROM m")
def knn_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    m = with_labels(pairs.nearest(p, 5), p).groupBy("query_id", "qy").agg(F.avg("cy").alias("mu"))
    e, mean = F.col("qy") - F.col("mu"), p.agg(F.avg("y")).scalar()
    m = m.withColumn("mean", mean)
    return m.agg(F.round(1 - F.avg(e * e) / F.var_pop("qy"), 6).alias("skill"), F.round(1 - F.avg(F.abs(e)) / F.avg(F.abs(F.col("qy") - F.col("mean"))), 6).alias("mae_skill"))


@both(f"WITH {D} SELECT count(*) AS pairs, round(0.5 * avg((yi - yj) * (yi - yj)), 6) AS nugget FROM d WHERE d < 1.2")
def near_dup_nugget(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    near = pairs.tiled_range_join(p, 1.2, cat_col="label")
    y = p.select(F.col("vec_id").alias("i"), F.col("y").alias("yi")), p.select(F.col("vec_id").alias("j"), F.col("y").alias("yj"))
    near = near.join(y[0], "i").join(y[1], "j")
    return near.agg(F.count("*").alias("pairs"), F.round(0.5 * F.avg(F.pow(F.col("yi") - F.col("yj"), 2)), 6).alias("nugget"))


@both(f"WITH {P}, g AS (SELECT list_transform(e[1:2], lambda x: round(x / 0.25)::BIGINT) AS cell, vec_id FROM p) SELECT min(vec_id) AS id, count(*) AS n FROM g GROUP BY cell")
def grid_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).withColumn("z2", F.slice("embedding", 1, 2))
    return pairs.grid_distinct(p, 0.25, vector_col="z2").select("id", "n")


@both(f"""WITH {N} SELECT rank::INTEGER AS k, round(0.5 * avg((qy - cy) * (qy - cy)) / (SELECT var_pop(y) FROM p), 6) AS gamma FROM s WHERE rank IN (1, 10, 20) GROUP BY rank""")
def gamma_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    near = with_labels(pairs.nearest(p, 20).where(F.col("rank").isin(1, 10, 20)), p)
    g = near.groupBy(F.col("rank").alias("k")).agg((0.5 * F.avg(F.pow(F.col("qy") - F.col("cy"), 2))).alias("g"))
    return g.withColumn("v", p.agg(F.var_pop("y")).scalar()).select("k", F.round(F.col("g") / F.col("v"), 6).alias("gamma"))


@both(f"""WITH {N}, l AS (SELECT query_id AS id, 0.9 * d AS l FROM s WHERE rank = 5) SELECT count(*) AS n, round(sqrt(2::DOUBLE) * max(l), 6) AS reach FROM l""")
def gibbs_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest distance at which a Gibbs pair can be non-zero."""
    p = points(spark, sf_dir)
    l = pairs.nearest(p, 5).where("rank = 5").select((0.9 * F.col("d")).alias("l"))  # noqa: E741
    return l.agg(F.count("*").alias("n"), F.round(math.sqrt(2.0) * F.max("l"), 6).alias("reach"))


@both(f"""WITH {D}, x AS (SELECT greatest(da / 0.95::DOUBLE, db / 0.9::DOUBLE) AS t, least(da / 0.95::DOUBLE, db / 0.9::DOUBLE) AS u FROM d) SELECT round(quantile_cont(t, 0.05), 6) AS product_scale, round(quantile_cont(u, 0.05), 6) AS additive_scale FROM x""")
def density_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scales at which product and additive supports hold 5% of the pairs: one quantile each, no bisection."""

    def scaled(d: list[np.ndarray]) -> list[np.ndarray]:
        a, b = d[0] / 0.95, d[1] / 0.9
        return [np.maximum(a, b), np.minimum(a, b)]

    found = pair_order.Pairs(points(spark, sf_dir), SPANS, scaled).quantiles([0.05])[1]
    scale = tuple(round(found[0, v][0], 6) if found else None for v in (0, 1))
    return spark.createDataFrame([scale], "product_scale double, additive_scale double")


QUERIES, ORACLE_SQL = Q, O
