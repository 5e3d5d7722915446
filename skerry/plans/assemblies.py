"""Joined tables, sets, runs, structure tables, means with size terms, scaled kernels and held-out categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.functions import kernels
from skerry.functions import structures as s
from skerry.operators import hot_keys, means, pairs, regression, sampling
from skerry.plans.census import rounded
from skerry.plans.pairs import D, N, P, W2, WHOLE, points
from skerry.plans.records import A, structures
from skerry.session import durable, table

Q, O = {}, {}  # noqa: E741


def both(sql: str):
    def put(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return put


@both("""SELECT o_orderkey, coalesce(c_mktsegment, 'unknown') AS segment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON c_custkey = o_custkey""")
def named_with_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name by key, 'unknown' where the key has none."""
    names = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return table(spark, sf_dir, "orders").join(names, "o_custkey", "left").select("o_orderkey", F.coalesce("c_mktsegment", F.lit("unknown")).alias("segment"))


@both("""SELECT doc_id, source, quality, CASE WHEN quality IS NULL THEN 'none' WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END AS subset FROM documents LEFT JOIN (SELECT doc_id, min(quality) AS quality, min(toxic) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)""")
def joined_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with their label and subset, joined by id and never by position; records without a label stay."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("toxic").alias("toxic"))
    subset = F.when(F.col("quality").isNull(), "none").when(F.col("toxic") == 1, "toxic").otherwise("clean")
    return table(spark, sf_dir, "documents").join(labels, "doc_id", "left").select("doc_id", "source", "quality", subset.alias("subset"))


@both(f"""WITH {A}, n AS (SELECT gidx, count(*) AS n, min(q) AS q FROM a GROUP BY gidx) SELECT count_if(n <= 5 AND q >= -0.07) AS kept, count_if(n > 5) AS oversize, count_if(n <= 5 AND q < -0.07) AS unusable FROM n""")
def capped_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records within the size cap and with usable charges, and how many were left out for which reason."""
    a = F.col("atoms")
    n, low = F.size(a), F.array_min(F.transform(a, lambda x: x["q"]))
    fit = (n <= 5) & s.charges_usable(a)
    return structures(spark, sf_dir).agg(F.count_if(fit & (low >= -0.07)).alias("kept"), F.count_if(n > 5).alias("oversize"), F.count_if(fit & (low < -0.07)).alias("unusable"))


@both("""WITH d AS (SELECT l_partkey % 30 AS i, l_suppkey % 30 AS j, avg(l_quantity) AS d FROM lineitem GROUP BY 1, 2), b AS (SELECT i, j, d FROM d UNION ALL SELECT j, i, d FROM d) SELECT i, j, round(CASE WHEN i = j THEN 0 ELSE avg(d) END, 6) AS d FROM b WHERE i <= j GROUP BY i, j""")
def stored_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored distance table made symmetric, with a zero diagonal, as pairs i <= j."""
    keys = [(F.col("l_partkey") % 30).alias("i"), (F.col("l_suppkey") % 30).alias("j")]
    d = table(spark, sf_dir, "lineitem").groupBy(*keys).agg(F.avg("l_quantity").alias("d"))
    return rounded(means.symmetrised(d))


@both(f"""WITH {A}, u AS (SELECT gidx FROM a GROUP BY gidx HAVING max(abs(q)) < 0.1), f AS (SELECT o_orderkey AS gidx, o_orderpriority AS family FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) SELECT gidx, family FROM f SEMI JOIN u USING (gidx)""")
def usable_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of some categories that every arm can process."""
    usable = structures(spark, sf_dir).where(F.forall("atoms", lambda a: F.abs(a["q"]) < 0.1)).select("gidx")
    rows = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    return rows.select(F.col("o_orderkey").alias("gidx"), F.col("o_orderpriority").alias("family")).join(usable, "gidx", "left_semi")


@both("""WITH r AS (SELECT o_custkey AS key, count(*) AS length FROM orders GROUP BY 1) SELECT key, coalesce(sum(length) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, length FROM r""")
def sorted_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start and length of each key's run in the order of keys."""
    runs = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").alias("length"))
    placed = durable(sampling.global_places(runs, ["key"]))
    return hot_keys.running_totals(placed, [], "place", "length", "start").select("key", F.col("start").cast("long").alias("start"), "length")


@both("""SELECT vec_id, label, row_number() OVER (ORDER BY label, vec_id) AS place FROM embeddings""")
def category_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contiguous order by category, ties by id."""
    return sampling.global_places(table(spark, sf_dir, "embeddings").select("vec_id", "label"), ["label", "vec_id"])


@both(f"""WITH {P}, x AS (SELECT unnest(range(1, 65)) AS k, e, y FROM p), c AS (SELECT k::INTEGER AS feature, round(abs(sum(e[k] * y)), 6) AS strength FROM x GROUP BY k) SELECT feature, strength FROM c ORDER BY strength DESC, feature LIMIT 10""")
def feature_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten features with the largest products with the target."""
    rows = points(spark, sf_dir).select("y", F.posexplode(F.col("embedding").cast("array<double>")).alias("k", "x"))
    strength = rows.groupBy((F.col("k") + 1).alias("feature")).agg(F.round(F.abs(F.sum(F.col("x") * F.col("y"))), 6).alias("strength"))
    return strength.orderBy(F.desc("strength"), "feature").limit(10)


@both("""SELECT 'both' AS side, key FROM (SELECT c_nationkey AS key FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'left', key FROM (SELECT c_nationkey AS key FROM customer EXCEPT SELECT s_nationkey FROM supplier)""")
def category_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories of both sides, and those of the left one alone."""
    left, right = (table(spark, sf_dir, t).select(F.col(c).alias("key")) for t, c in (("customer", "c_nationkey"), ("supplier", "s_nationkey")))
    return left.intersect(right).select(F.lit("both").alias("side"), "key").unionAll(left.exceptAll(left.join(right, "key", "left_semi")).distinct().select(F.lit("left").alias("side"), "key"))


@both("""SELECT DISTINCT round(l_quantity / (l_quantity + l_linenumber), 6) AS share, l_linenumber AS p FROM lineitem""")
def metric_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct metrics: two weights count by their share, with the exponent."""
    share = F.col("l_quantity") / (F.col("l_quantity") + F.col("l_linenumber"))
    return rounded(table(spark, sf_dir, "lineitem").select(share.alias("share"), F.col("l_linenumber").alias("p"))).distinct()


@both("""WITH f AS (SELECT l_orderkey AS gidx, sqrt(power(l_quantity, 2) + power(l_discount, 2) + power(l_tax, 2)) AS f FROM lineitem) SELECT gidx, round(max(f), 6) AS fmax, round(sqrt(avg(f * f)), 6) AS frms FROM f GROUP BY gidx""")
def force_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest and root mean squared norm of a record's forces."""
    forces = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("gidx")).agg(F.collect_list(F.array("l_quantity", "l_discount", "l_tax")).alias("f"))
    return rounded(forces.select("gidx", *(v.alias(k) for k, v in s.norm_summary(F.col("f")).items())))


@both(f"""WITH {A}, m AS (SELECT gidx, avg(px) AS mx, avg(py) AS my, avg(pz) AS mz, count(*) AS n FROM a GROUP BY gidx), c AS (SELECT gidx, n, q, px - mx AS x, py - my AS y, pz - mz AS z FROM a JOIN m USING (gidx)),
  t AS (SELECT gidx, any_value(n) AS n, sum(q * (3 * x * x - (x * x + y * y + z * z))) AS xx, sum(q * (3 * y * y - (x * x + y * y + z * z))) AS yy, sum(q * (3 * z * z - (x * x + y * y + z * z))) AS zz, sum(3 * q * x * y) AS xy, sum(3 * q * x * z) AS xz, sum(3 * q * y * z) AS yz FROM c GROUP BY gidx)
  SELECT gidx, round(sqrt(xx * xx + yy * yy + zz * zz + 2 * (xy * xy + xz * xz + yz * yz)) / n, 6) AS quadrupole FROM t""")
def quadrupoles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(structures(spark, sf_dir).select("gidx", s.quadrupole(F.col("atoms")).alias("quadrupole")))


@both("""WITH k AS (SELECT l_orderkey, count(*) AS k FROM lineitem GROUP BY 1) SELECT l_orderkey, l_linenumber, round(o_totalprice / (k + 0.1::DOUBLE), 6) AS share FROM lineitem JOIN k USING (l_orderkey) JOIN orders ON o_orderkey = l_orderkey""")
def energy_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge shares of a record's value among its parts: the normal equations of a record are constant, so each part gets y / (k + r)."""
    li = table(spark, sf_dir, "lineitem")
    of = li.groupBy("l_orderkey").agg(F.count("*").alias("k")).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice"), "l_orderkey")
    return rounded(li.select("l_orderkey", "l_linenumber").join(of, "l_orderkey").select("l_orderkey", "l_linenumber", (F.col("o_totalprice") / (F.col("k") + 0.1)).alias("share")))


ARD = [1 + k / 64 for k in range(64)]
SCALED = "list_transform(e, lambda x, k: x / (1 + (k - 1) / 64::DOUBLE))"


@both(f"""WITH {P}, s AS (SELECT vec_id, label, {SCALED} AS e FROM p), d AS (SELECT a.label AS cat, list_distance(a.e, b.e) / 4::DOUBLE AS t FROM s a JOIN s b ON a.label = b.label AND a.vec_id < b.vec_id) SELECT cat, count(*) AS nnz, round(sum(power(1 - t, 37) * (1368 * t * t + 111 * t + 3) / 3), 6) AS mass FROM d WHERE t < 1 GROUP BY cat""")
def gram_ard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compact kernel of distances with a length for each dimension, of the form that is positive definite in all 64."""
    p = points(spark, sf_dir).withColumn("embedding", F.zip_with(F.col("embedding").cast("array<double>"), F.array(*map(F.lit, ARD)), lambda x, w: x / w))
    near = pairs.category_pairs(p, WHOLE, within={"z": 4.0})
    k = kernels.wendland(kernels.scaled(F.col("d_z"), 4.0), 64, 2)
    return rounded(near.groupBy("cat").agg(F.count("*").alias("nnz"), F.sum(k).alias("mass")))


@both(f"""WITH {P}, d AS (SELECT a.vec_id // 8 AS pool, list_distance(a.e, b.e) / 1.38::DOUBLE AS t FROM p a JOIN p b ON a.vec_id // 8 = b.vec_id // 8 AND a.vec_id < b.vec_id), o AS (SELECT pool, sum({W2("t")}) AS off FROM d GROUP BY pool), c AS (SELECT vec_id // 8 AS pool, count(*) AS n FROM p GROUP BY 1)
  SELECT pool, round(n + 2 * coalesce(off, 0), 6) AS diagonal FROM c LEFT JOIN o USING (pool)""")
def pooled_diagonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagonal of the kernel between pools, from the members of each pool alone."""
    p = points(spark, sf_dir).withColumn("pool", F.floor(F.col("vec_id") / 8))
    near = pairs.category_pairs(p, WHOLE, cat_col="pool", within={"z": 1.38})
    off = near.groupBy(F.col("cat").alias("pool")).agg(F.sum(kernels.wendland_c2(kernels.scaled(F.col("d_z"), 1.38))).alias("off"))
    n = p.groupBy("pool").agg(F.count("*").alias("n"))
    return rounded(n.join(off, "pool", "left").select("pool", (F.col("n") + 2 * F.coalesce("off", F.lit(0.0))).alias("diagonal")))


@both(f"""WITH {D}, r AS (SELECT cat, 1.25::DOUBLE + 0.01::DOUBLE * (cat % 10) AS rho FROM d GROUP BY cat), n AS (SELECT label AS cat, count(*) AS n FROM p GROUP BY label) SELECT cat, any_value(n) AS n, count_if(d < rho) AS pairs, round((2 * count_if(d < rho) + any_value(n)) / (any_value(n)::DOUBLE * any_value(n)), 9) AS density FROM d JOIN r USING (cat) JOIN n USING (cat) GROUP BY cat""")
def density_per_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density of the support where each category has a radius of its own."""
    p = points(spark, sf_dir)
    near = pairs.category_pairs(p, WHOLE, within={"z": 1.34})
    rho = F.lit(1.25) + F.lit(0.01) * (F.col("cat") % 10)
    c = near.groupBy("cat").agg(F.count_if(F.col("d_z") < rho).alias("pairs"))
    n = p.groupBy(F.col("label").alias("cat")).agg(F.count("*").alias("n"))
    found = n.join(c, "cat", "left").select("cat", "n", F.coalesce("pairs", F.lit(0)).alias("pairs"))
    return found.withColumn("density", F.round((2 * F.col("pairs") + F.col("n")) / (F.col("n").cast("double") * F.col("n")), 9))


@both(f"""WITH {N}, t AS (SELECT unnest([1.1, 1.2, 1.3]::DOUBLE[]) AS radius), m AS (SELECT count(*) AS n FROM p), c AS (SELECT radius, count(*) AS nnz FROM s CROSS JOIN t WHERE d < radius GROUP BY radius)
  SELECT radius, round((nnz + n) / (n::DOUBLE * n), 9) AS density, round((nnz + n) / (n::DOUBLE * n) * 1e6 * 1e6, 3) AS nnz_at_1m, round(12 * (nnz + n) / (n::DOUBLE * n) * 1e6 * 1e6 / 1e9, 6) AS csr_gb FROM c CROSS JOIN m""")
def projected_storage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density by radius and what it means for a million rows, at 12 bytes an entry."""
    p = points(spark, sf_dir)
    radii = [1.1, 1.2, 1.3]
    c = pairs.neighbour_counts(p, radii).agg(*(F.sum(f"c{k}").alias(f"c{k}") for k in range(3)), F.count("*").alias("n"))
    rows = c.select("n", F.inline(F.array(*(F.struct(F.lit(r).alias("radius"), F.col(f"c{k}").alias("nnz")) for k, r in enumerate(radii)))))
    density = (F.col("nnz") + F.col("n")) / (F.col("n").cast("double") * F.col("n"))
    return rows.select("radius", F.round(density, 9).alias("density"), F.round(density * 1e12, 3).alias("nnz_at_1m"), F.round(12 * density * 1e3, 6).alias("csr_gb"))


def sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with a size, a target that scales with it, and their category."""
    p = points(spark, sf_dir).select("vec_id", "label", F.slice(F.col("embedding").cast("array<double>"), 1, 4).alias("z"), (F.col("vec_id") % 50 + 2).cast("double").alias("size"), "y")
    return p.withColumn("y", F.col("y") + F.element_at("z", 1) * F.log("size") * 3)


@both("")
def size_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear mean with size terms and their products with the vector: residual and variance of the mean of each row."""
    rows = sized(spark, sf_dir)
    model = means.size_mean(rows, "z", "size", "y")
    return rounded(rows.select("vec_id", (F.col("y") - model.predict("z", "size")).alias("residual"), model.variance("z", "size").alias("mean_var")))


@both("")
def variance_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deviation of each row's residual by size and category."""
    rows = sized(spark, sf_dir)
    model = means.size_mean(rows, "z", "size", "y")
    r = rows.select("vec_id", "label", "size", (F.col("y") - model.predict("z", "size")).alias("r"))
    return rounded(means.deviation(r, "r", "size", "label").select("vec_id", "sigma"))


@both("")
def extensive_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residuals of the ridge mean on element counts, charge, spin and size."""
    rows = structures(spark, sf_dir).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("gidx"), (F.col("o_totalprice") / 1000).alias("y")), "gidx")
    x = means.extensive_design(F.col("atoms"), [1, 6, 7, 8], F.col("gidx") % 3 - 1, F.col("gidx") % 2 + 1)
    model = regression.ridge(regression.moments(rows, x, F.col("y")), 1e-6)
    return rounded(rows.select("gidx", (F.col("y") - model.predict(x)).alias("residual")))


@both(f"""WITH {N}, h AS (SELECT query_id, ql, qy, cy, row_number() OVER (PARTITION BY query_id ORDER BY d, neighbour_id) AS k FROM r WHERE ql <> cl), i AS (SELECT query_id, ql, qy, cy, rank AS k FROM r),
  e AS (SELECT 'held_out' AS arm, ql AS cat, query_id, any_value(qy) AS y, avg(cy) AS mu FROM h WHERE k <= 10 GROUP BY ql, query_id UNION ALL SELECT 'control', ql, query_id, any_value(qy), avg(cy) FROM i WHERE k <= 10 GROUP BY ql, query_id),
  m AS (SELECT cat, arm, sqrt(avg((y - mu) * (y - mu))) AS rmse FROM e GROUP BY cat, arm)
  SELECT cat, round(max(rmse) FILTER (arm = 'held_out'), 6) AS held_out, round(max(rmse) FILTER (arm = 'control'), 6) AS control, round(max(rmse) FILTER (arm = 'held_out') / max(rmse) FILTER (arm = 'control'), 6) AS degradation FROM m GROUP BY cat""")
def held_out_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error of neighbour means where a category has none of its own rows, beside its error where it has."""
    return rounded(means.degradation(points(spark, sf_dir), 10))


QUERIES, ORACLE_SQL = Q, O
