"""Variograms and screens on same-category pairs of `embeddings`, and scores of a prediction table from `lineitem`."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skerry.functions import stats
from skerry.operators import grouping as g
from skerry.operators import pair_order, pairs, sampling
from skerry.operators import variogram as v
from skerry.plans.census import rounded
from skerry.plans.pairs import D, N, WHOLE, points, with_labels
from skerry.session import table

Q, O = {}, {}  # noqa: E741


def both(sql: str):
    def put(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return put


def pair_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    d = pairs.category_pairs(p, WHOLE).withColumnRenamed("d_z", "d")
    d = d.join(p.select(F.col("vec_id").alias("i"), F.col("y").alias("yi")), "i").join(p.select(F.col("vec_id").alias("j"), F.col("y").alias("yj")), "j")
    return d.select("cat", "d", (F.col("yi") - F.col("yj")).alias("dy"))


EC = f"""{D}, e AS (SELECT quantile_cont(d, {[k / 20 for k in range(1, 20)]}) AS edges FROM d), b AS (SELECT len(list_filter(edges, lambda x: x <= d))::INTEGER AS bin, d, yi - yj AS dy, cat FROM d CROSS JOIN e),
  c AS (SELECT bin, quantile_cont(d, 0.5) AS lag, 0.5 * avg(dy * dy) AS gamma, count(*) AS n FROM b GROUP BY bin)"""


@both(f"WITH {EC} SELECT bin, round(lag, 6) AS lag, round(gamma, 6) AS gamma, n FROM c")
def variogram_equal_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(v.pair_curve(points(spark, sf_dir), 20).drop("g"))


@both(f"WITH {D}, t AS (SELECT quantile_cont(d, 0.95) AS top FROM d), b AS (SELECT least(floor(d / (top / 24)), 23)::INTEGER AS bin, d, yi - yj AS dy FROM d CROSS JOIN t WHERE d <= top) SELECT bin, round(avg(d), 6) AS lag, round(0.5 * avg(dy * dy), 6) AS gamma, count(*) AS n FROM b GROUP BY bin")
def variogram_equal_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(v.pair_curve(points(spark, sf_dir), 24, "mean", upto=0.95).drop("g"))


@both(f"WITH {EC} SELECT bin, round(avg(d), 6) AS lag, round(0.5 * power(avg(power(dy * dy, 0.25)), 4) / (0.457 + 0.494 / count(*)), 6) AS gamma, count(*) AS n FROM b GROUP BY bin")
def variogram_cressie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(v.pair_curve(points(spark, sf_dir), 20, "mean", "cressie").drop("g"))


@both(f"WITH {EC}, s AS (SELECT var_pop(y) AS sill FROM p) SELECT round(sill, 6) AS sill, round(CASE WHEN max(gamma) <= 1.5 * sill THEN min(lag) FILTER (gamma >= 0.95 * sill) END, 6) AS range, round(max(gamma), 6) AS top FROM c CROSS JOIN s GROUP BY sill")
def variogram_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = v.pair_curve(points(spark, sf_dir), 20).drop("g")
    return rounded(v.guarded_range(curve, points(spark, sf_dir).agg(F.var_pop("y"))))


@both(f"""WITH {EC}, w AS (SELECT *, (coalesce(lag(gamma) OVER o, 0) + gamma + coalesce(lead(gamma) OVER o, 0)) / 3 AS s, row_number() OVER o AS place, count(*) OVER () AS m FROM c WINDOW o AS (ORDER BY bin)),
  z AS (SELECT arg_min(gamma, bin) AS nugget, quantile_cont(gamma, 0.5) FILTER (place > m - m // 3) AS sill FROM w) SELECT round(nugget, 6) AS nugget, round(sill, 6) AS sill, round(min(lag) FILTER (s >= nugget + 0.95 * (sill - nugget)), 6) AS range FROM w CROSS JOIN z GROUP BY nugget, sill""")
def variogram_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(v.nugget_sill_range(v.pair_curve(points(spark, sf_dir), 20).drop("g")))


@both(f"""WITH {D}, e AS (SELECT cat, quantile_cont(d, {[k / 12 for k in range(1, 12)]}) AS edges FROM d GROUP BY cat), b AS (SELECT cat, len(list_filter(edges, lambda x: x <= d))::INTEGER AS bin, d, yi - yj AS dy FROM d JOIN e USING (cat))
  SELECT cat, bin, round(quantile_cont(d, 0.5), 6) AS lag, round(0.5 * avg(dy * dy), 6) AS gamma, count(*) AS n FROM b GROUP BY cat, bin""")
def variogram_per_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(v.pair_curve(points(spark, sf_dir), 12, whole=False).withColumnRenamed("g", "cat"))


@both(f"""WITH {N}, x AS (SELECT d, qy - cy AS dy FROM s WHERE rank = 1), e AS (SELECT quantile_cont(d, {[k / 10 for k in range(1, 10)]}) AS edges FROM x), b AS (SELECT len(list_filter(edges, lambda t: t <= d))::INTEGER AS bin, d, dy FROM x CROSS JOIN e),
  c AS (SELECT bin, avg(d) AS nn, sqrt(avg(dy * dy)) AS rmse, sum(dy * dy) AS se, count(*) AS n FROM b GROUP BY bin)
  SELECT bin, round(nn, 6) AS nn, round(rmse, 6) AS rmse, round(sqrt(sum(se) OVER o / sum(n) OVER o), 6) AS cumulative, round(quantile_cont(rmse, 0.5) OVER (ORDER BY bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS rolling,
  round(quantile_cont(rmse, 0.5) OVER (ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS suffix FROM c WINDOW o AS (ORDER BY bin)""")
def rmse_vs_nn(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    near = with_labels(pairs.nearest(p, 1), p).select("d", (F.col("qy") - F.col("cy")).alias("dy"))
    return rounded(v.by_nearest(near, 10))


@both(f"""WITH {N}, c AS (SELECT k, query_id, min(d) AS d FROM n CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS k) WHERE query_id % 5 = 0 AND neighbour_id % 5 <> 0 AND neighbour_id // 5 % 4 < k GROUP BY 1, 2), m AS (SELECT k, avg(d) AS nn FROM c GROUP BY k)
  SELECT round(regr_slope(ln(nn), ln(k)), 6) AS slope, round(-1 / regr_slope(ln(nn), ln(k)), 4) AS d_eff FROM m""")
def nn_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope of log nearest distance on log size: a fifth of the rows asks nested quarters, up to all, of the rest."""
    slope = F.regr_slope(F.log("nn"), F.log("k"))
    return nearest_by_size(spark, sf_dir).agg(F.round(slope, 6).alias("slope"), F.round(-1 / slope, 4).alias("d_eff"))


def nearest_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(nn, k): mean nearest distance of a fifth of the rows among k quarters of the rest."""
    p, parts = points(spark, sf_dir), []
    for k in (1, 2, 3, 4):
        held = (F.col("vec_id") % 5 != 0) & (F.floor(F.col("vec_id") / 5) % 4 < k)
        near = pairs.nearest(p, 1, cat_col=None, queries=F.col("vec_id") % 5 == 0, candidates=held)
        parts.append(near.agg(F.avg("d").alias("nn")).withColumn("k", F.lit(k)))
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


@both(f"""WITH {N}, x AS (SELECT d, qy - cy AS dy FROM s WHERE rank = 1), e AS (SELECT quantile_cont(d, {[k / 10 for k in range(1, 10)]}) AS edges FROM x), b AS (SELECT len(list_filter(edges, lambda t: t <= d))::INTEGER AS bin, d, dy FROM x CROSS JOIN e),
  c AS (SELECT bin, avg(d) AS nn, 1 - avg(dy * dy) / (SELECT var_pop(y) FROM p) AS r2 FROM b GROUP BY bin), ar AS (SELECT list(nn ORDER BY nn) AS xs, list(r2 ORDER BY nn) AS ys FROM c),
  g AS (SELECT k, query_id, min(d) AS d FROM n CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS k) WHERE query_id % 5 = 0 AND neighbour_id % 5 <> 0 AND neighbour_id // 5 % 4 < k GROUP BY 1, 2), m AS (SELECT k, avg(d) AS nn FROM g GROUP BY k),
  sl AS (SELECT regr_slope(ln(nn), ln(k)) AS slope, max(nn) FILTER (k = 4) AS now FROM m), t AS (SELECT factor, now * power(factor, slope) AS pos FROM sl CROSS JOIN (SELECT unnest([1, 2, 4, 8, 16]) AS factor)),
  z AS (SELECT factor, pos, xs, ys, len(list_filter(xs, lambda v: v <= pos)) AS k FROM t CROSS JOIN ar)
  SELECT factor, round(pos, 6) AS nn, round(CASE WHEN k = 0 THEN ys[1] WHEN k = len(xs) THEN ys[-1] ELSE ys[k] + (ys[k + 1] - ys[k]) * (pos - xs[k]) / (xs[k + 1] - xs[k]) END, 6) AS r2 FROM z""")
def projected_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2 of the nearest row's value at 1 to 16 times the rows: the scaling law gives the distance, the curve of R2 by distance the value there."""
    p = points(spark, sf_dir)
    near = with_labels(pairs.nearest(p, 1), p).select("d", (F.col("qy") - F.col("cy")).alias("dy"))
    curve = v.equal_count_bins(near, 10).groupBy("bin").agg(F.avg("d").alias("x"), F.avg(F.pow("dy", F.lit(2))).alias("e"))
    curve = curve.withColumn("var", p.agg(F.var_pop("y")).scalar()).withColumn("r2", 1 - F.col("e") / F.col("var"))
    law = nearest_by_size(spark, sf_dir).agg(F.regr_slope(F.log("nn"), F.log("k")).alias("slope"), F.max(F.when(F.col("k") == 4, F.col("nn"))).alias("now"))
    targets = law.select(F.explode(F.array(*map(F.lit, (1, 2, 4, 8, 16)))).alias("factor"), "slope", "now")
    targets = targets.select("factor", (F.col("now") * F.pow(F.col("factor"), F.col("slope"))).alias("nn"))
    return rounded(v.interpolated(targets, "nn", curve, "x", "r2", "r2"))


@both(f"""WITH {D}, x AS (SELECT d, abs(yi - yj) AS a FROM d), r AS (SELECT rank() OVER (ORDER BY d) + (count(*) OVER (PARTITION BY d) - 1) / 2 AS rd, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra FROM x) SELECT count(*) AS n, round(corr(rd, ra), 6) AS rho FROM r""")
def distance_target_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, rho, loss = pair_order.rank_correlation(points(spark, sf_dir))
    if loss < pair_order.LOSS:
        return spark.createDataFrame([(n, None if rho is None else round(rho, 6))], "n long, rho double")
    # Values that leading bits don't part, on both sides: pairs are written and ranked.
    x = pair_differences(spark, sf_dir).select(F.lit(0).alias("all"), "d", F.abs("dy").alias("a"))
    return rounded(g.spearman(x, ["all"], "d", "a").drop("all"))


@both(f"""WITH {N}, w AS (SELECT d, 0.5 * (qy - cy) * (qy - cy) AS v, ql = cl AS alike FROM n WHERE query_id < neighbour_id), u AS (SELECT count_if(alike) AS n_within, corr(d, v) FILTER (alike) AS corr_within, avg(v) FILTER (alike) AS gamma_within, count(*) AS n_all, corr(d, v) AS corr_all, avg(v) AS gamma_all FROM w),
  z AS (SELECT *, (atanh(corr_within) - atanh(corr_all)) / sqrt(1 / (n_within - 3)::DOUBLE + 1 / (n_all - 3)::DOUBLE) AS z FROM u)
  SELECT n_within, round(corr_within, 6) AS corr_within, round(gamma_within, 6) AS gamma_within, n_all, round(corr_all, 6) AS corr_all, round(gamma_all, 6) AS gamma_all, round(z, 4) AS z, CASE WHEN corr_within > 0 AND z > -1.96 THEN 'orthogonal' ELSE 'redundant' END AS verdict FROM z""")
def same_group_orthogonality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether distances still tell the target apart where the group, here the label, is the same."""
    p = points(spark, sf_dir)
    found = pairs.fisher_contrast(pairs.pair_correlation(p, F.col("label"), "y"), pairs.pair_correlation(p, F.lit(0), "y"))
    return rounded(found.withColumn("z", F.round("z", 4)))


# A prediction table: the mean of y by quantity as forecast, its deviation as sigma.
def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), F.col("l_returnflag").alias("cat"), "l_quantity", "l_discount", (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_orderkey") % 2).alias("half"))
    m = li.groupBy("l_quantity").agg(F.avg("y").alias("mu"), F.stddev_pop("y").alias("s"))
    return li.join(m, "l_quantity").withColumn("sigma", F.col("s") * (0.8 + 4 * F.col("l_discount")))


PR = """m AS (SELECT l_quantity, avg(l_extendedprice / 1000) AS mu, stddev_pop(l_extendedprice / 1000) AS s FROM lineitem GROUP BY 1),
  pr AS (SELECT concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, l_returnflag AS cat, l_orderkey % 2 AS half, l_extendedprice / 1000 AS y, mu, s * (0.8::DOUBLE + 4 * l_discount) AS sigma FROM lineitem JOIN m USING (l_quantity))"""


def erf_sql(x: str) -> str:
    a1, a2, a3, a4, a5 = stats.ERF_A
    t = f"(1 / (1 + {stats.ERF_P}::DOUBLE * abs({x})))"
    return f"(sign({x}) * (1 - ((((({a5}::DOUBLE * {t} + {a4}::DOUBLE) * {t} + {a3}::DOUBLE) * {t} + {a2}::DOUBLE) * {t} + {a1}::DOUBLE) * {t}) * exp(-({x}) * ({x}))))"


def crps_sql(s: str) -> str:
    z = f"((y - mu) / {s})"
    return f"({s} * ({z} * ({erf_sql(z + ' / sqrt(2::DOUBLE)')}) + 2 * exp(-0.5 * {z} * {z}) / sqrt(2 * pi()) - 1 / sqrt(pi())))"


def root_mean(x: Column) -> Column:
    return F.sqrt(F.avg(x * x))


def residual() -> Column:
    return F.col("y") - F.col("mu")


def z_score() -> Column:
    return residual() / F.col("sigma")


@both(f"WITH {PR} SELECT cat, count(*) AS n, round(1 - avg((y - mu) * (y - mu)) / var_pop(y), 6) AS r2, round(sqrt(avg((y - mu) * (y - mu))), 6) AS rmse, round(avg(abs(y - mu)), 6) AS mae FROM pr GROUP BY cat")
def point_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(predictions(spark, sf_dir).groupBy("cat").agg(F.count("*").alias("n"), (1 - F.avg(residual() * residual()) / F.var_pop("y")).alias("r2"), root_mean(residual()).alias("rmse"), F.avg(F.abs(residual())).alias("mae")))


@both(f"""WITH {PR} SELECT cat, round(avg({crps_sql('sigma')}), 6) AS crps, round(avg(0.5 * ln(2 * pi() * sigma * sigma) + 0.5 * power((y - mu) / sigma, 2)), 6) AS nlpd,
  {", ".join(f"round(avg((abs((y - mu) / sigma) <= {NormalDist().inv_cdf(0.5 + p / 200)!r}::DOUBLE)::INT), 6) AS cov{p}" for p in (50, 90, 95))}, round(stddev_pop((y - mu) / sigma), 6) AS std_z, round(avg(sigma), 6) AS sharpness FROM pr GROUP BY cat""")
def crps_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, mu, s = F.col("y"), F.col("mu"), F.col("sigma")
    covers = [F.avg((F.abs(z_score()) <= NormalDist().inv_cdf(0.5 + p / 200)).cast("int")).alias(f"cov{p}") for p in (50, 90, 95)]
    return rounded(predictions(spark, sf_dir).groupBy("cat").agg(F.avg(stats.crps(y, mu, s)).alias("crps"), F.avg(stats.nlpd(y, mu, s)).alias("nlpd"), *covers, F.stddev_pop(z_score()).alias("std_z"), F.avg(s).alias("sharpness")))


@both(f"""WITH {PR}, c AS (SELECT sqrt(avg((y - mu) * (y - mu))) AS flat, sqrt(avg(power((y - mu) / sigma, 2)) FILTER (half = 0)) AS alpha FROM pr)
  SELECT round(1 - avg({crps_sql('sigma')}) / avg({crps_sql('flat')}), 6) AS skill, round(1 - avg({crps_sql('(alpha * sigma)')}) FILTER (half = 1) / avg({crps_sql('flat')}) FILTER (half = 1), 6) AS scaled_skill FROM pr CROSS JOIN c""")
def crps_skill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skill against one constant deviation; the second with a scale fitted on one half and scored on the other."""
    p = predictions(spark, sf_dir)
    c = p.agg(F.struct(root_mean(residual()).alias("flat"), F.sqrt(F.avg(F.when(F.col("half") == 0, z_score() * z_score()))).alias("alpha")))
    p = p.withColumn("c", c.scalar())
    score = lambda s: stats.crps(F.col("y"), F.col("mu"), s)
    own, flat, scaled = score(F.col("sigma")), score(F.col("c.flat")), score(F.col("c.alpha") * F.col("sigma"))
    held = lambda x: F.avg(F.when(F.col("half") == 1, x))
    return rounded(p.agg((1 - F.avg(own) / F.avg(flat)).alias("skill"), (1 - held(scaled) / held(flat)).alias("scaled_skill")))


LEVELS = [k / 20 for k in range(1, 20)]


@both(f"""WITH {PR}, l AS (SELECT unnest({LEVELS}::DOUBLE[]) AS p, unnest({[NormalDist().inv_cdf(0.5 + p / 2) for p in LEVELS]}::DOUBLE[]) AS q), c AS (SELECT cat, p, avg((abs((y - mu) / sigma) <= q)::INT) AS got FROM pr CROSS JOIN l GROUP BY cat, p) SELECT cat, round(avg(abs(got - p)), 6) AS area FROM c GROUP BY cat""")
def miscalibration_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = predictions(spark, sf_dir).groupBy("cat").agg(*(F.abs(F.avg((F.abs(z_score()) <= NormalDist().inv_cdf(0.5 + p / 2)).cast("int")) - p).alias(f"l{k}") for k, p in enumerate(LEVELS)))
    return rounded(per.select("cat", (sum(F.col(f"l{k}") for k in range(len(LEVELS))) / len(LEVELS)).alias("area")))


@both(f"""WITH {PR}, r AS (SELECT cat, row_number() OVER (PARTITION BY cat ORDER BY sigma DESC, id) AS a, row_number() OVER (PARTITION BY cat ORDER BY abs(y - mu) DESC, id) AS b, greatest(floor(0.05 * count(*) OVER (PARTITION BY cat)), 1) AS k FROM pr) SELECT cat, any_value(k)::BIGINT AS k, round(count_if(a <= k AND b <= k) / any_value(k)::DOUBLE, 6) AS recall FROM r GROUP BY cat""")
def rank_topk_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of the top 5% by sigma and by error: both sets by a distributed order, then a join on the id."""
    p = predictions(spark, sf_dir).select("cat", "id", "sigma", F.abs(residual()).alias("e"))
    n = p.groupBy("cat").agg(F.greatest(F.floor(0.05 * F.count("*")), F.lit(1)).alias("k"))
    top = lambda c: sampling.places_within(p, ["cat"], [F.desc(c), "id"], "r").join(n, "cat").where("r <= k").select("cat", "k", "id")
    both_ = top("sigma").join(top("e").drop("k"), ["cat", "id"], "left_semi").groupBy("cat").agg(F.count("*").alias("c"))
    return rounded(n.join(both_, "cat", "left").select("cat", "k", (F.coalesce("c", F.lit(0)) / F.col("k")).alias("recall")))


@both(f"""WITH {PR}, r AS (SELECT cat, rank() OVER a + (count(*) OVER (PARTITION BY cat, round(sigma, 9)) - 1) / 2 AS rs, rank() OVER b + (count(*) OVER (PARTITION BY cat, round(abs(y - mu), 9)) - 1) / 2 AS re FROM pr WINDOW a AS (PARTITION BY cat ORDER BY round(sigma, 9)), b AS (PARTITION BY cat ORDER BY round(abs(y - mu), 9))) SELECT cat, count(*) AS n, round(corr(rs, re), 5) AS rho FROM r GROUP BY cat""")
def sigma_rank_skill(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir).select("cat", F.round("sigma", 9).alias("s"), F.round(F.abs(residual()), 9).alias("e"))
    return rounded(g.spearman(p, ["cat"], "s", "e"), 5)


@both(f"""WITH {PR}, a AS (SELECT cat, half AS seed, sqrt(avg((y - mu) * (y - mu))) AS m FROM pr GROUP BY 1, 2), b AS (SELECT half AS seed, sqrt(avg((y - mu) * (y - mu))) AS base FROM pr GROUP BY 1)
  SELECT cat, round(avg(m), 6) AS mean, round(avg(m - base), 6) AS delta, round(stddev_samp(m - base), 6) AS sd, round(avg(m - base) / (stddev_samp(m - base) / sqrt(count(*))), 4) AS t FROM a JOIN b USING (seed) GROUP BY cat""")
def paired_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arms (categories) against the pooled baseline, paired by seed (half)."""
    p = predictions(spark, sf_dir)
    a = p.groupBy("cat", F.col("half").alias("seed")).agg(root_mean(residual()).alias("m"))
    b = p.groupBy(F.col("half").alias("seed")).agg(root_mean(residual()).alias("base"))
    d = F.col("m") - F.col("base")
    out = a.join(b, "seed").groupBy("cat").agg(F.avg("m").alias("mean"), F.avg(d).alias("delta"), F.stddev_samp(d).alias("sd"), (F.avg(d) / (F.stddev_samp(d) / F.sqrt(F.count("*")))).alias("t"))
    return out.select("cat", *(F.round(c, 6).alias(c) for c in ("mean", "delta", "sd")), F.round("t", 4).alias("t"))


@both("SELECT l_returnflag AS cat, round(100.0 * (count_if(l_quantity < 25) + count_if(l_quantity <= 25) + (count_if(l_quantity = 25) > 0)::INT) / 2 / count(*), 6) AS score FROM lineitem GROUP BY 1")
def percentile_of_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    lt, le = F.count_if(F.col("l_quantity") < 25), F.count_if(F.col("l_quantity") <= 25)
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("cat")).agg(F.round((lt + le + (lt < le).cast("int")) * 50 / F.count("*"), 6).alias("score"))


@both("""WITH s AS (SELECT count(*) AS n, avg(l_quantity) AS mx, avg(l_extendedprice) AS my, regr_slope(l_extendedprice, l_quantity) AS slope, regr_r2(l_extendedprice, l_quantity) AS r2, corr(l_extendedprice, l_quantity) AS rho FROM lineitem) SELECT n, round(slope, 6) AS slope, round(r2, 6) AS r2, round(rho, 6) AS rho, abs(rho) > 0.3 AND r2 > 0.1 AS size_driven FROM s""")
def residual_size_diagnostic(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = "l_quantity", "l_extendedprice"
    s = table(spark, sf_dir, "lineitem").agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_r2(y, x).alias("r2"), F.corr(y, x).alias("rho"))
    return rounded(s.withColumn("size_driven", (F.abs("rho") > 0.3) & (F.col("r2") > 0.1)))


QUERIES, ORACLE_SQL = Q, O
