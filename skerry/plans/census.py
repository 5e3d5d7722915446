"""Grouped statistics, windows, sampling and set queries over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skerry.operators import grouping as g
from skerry.operators import sampling
from skerry.session import table

Q, O = {}, {}  # noqa: E741


def both(sql: str):
    def put(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return put


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the dimensions that nest: brand and type of the part, nation and region of the supplier."""
    t = lambda n: table(spark, sf_dir, n)
    li = t("lineitem").join(t("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type", "p_size"), "l_partkey")
    li = li.join(t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey")), "l_suppkey")
    return li.join(t("nation"), "n_nationkey").withColumn("y", F.col("l_extendedprice") / 1000)


L = """l AS (SELECT *, l_extendedprice / 1000 AS y FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))


def anova(keys: str, over: str = "") -> str:
    o = f"{over}, " if over else ""
    tail = f"GROUP BY {over}" if over else ""
    return f"""WITH {L}, g AS (SELECT {o}{keys}, count(y) AS m, avg(y) AS mean, var_pop(y) AS v FROM l GROUP BY {o}{keys}),
      s AS (SELECT {o}sum(m) AS n, count(*) AS groups, sum(m * mean * mean) - sum(m) * power(sum(m * mean) / sum(m), 2) AS ss_between, sum(m * v) AS ss_within,
              power(sum(m)::DOUBLE, 2) / sum(m * m) AS effective_groups, sum(CASE WHEN m >= 2 THEN m ELSE 0 END) / sum(m)::DOUBLE AS multi_share FROM g {tail})
      SELECT {o}n::BIGINT AS n, groups, round(ss_between, 4) AS ss_between, round(ss_within, 4) AS ss_within, round(effective_groups, 4) AS effective_groups, round(multi_share, 4) AS multi_share,
        round(ss_within / nullif(n - groups, 0), 4) AS within_var, round(ss_between / nullif(ss_between + ss_within, 0), 4) AS ceiling,
        round(1 - ss_within / nullif(n - groups, 0) / nullif((ss_between + ss_within) / nullif(n - 1, 0), 0), 4) + 0 AS ceiling_unbiased FROM s"""


@both(anova("p_brand"))
def anova_decompose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(g.decompose(lines(spark, sf_dir), ["p_brand"], "y"), 4)


@both(anova("p_brand, p_type", "n_regionkey"))
def anova_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(g.decompose(lines(spark, sf_dir), ["p_brand", "p_type"], "y", ["n_regionkey"]), 4)


@both(f"""WITH {L} SELECT n_regionkey, p_brand, count(*) AS n, round(avg(y), 6) AS mean, round(var_pop(y), 6) AS var FROM l GROUP BY GROUPING SETS ((), (n_regionkey), (p_brand), (n_regionkey, p_brand))""")
def anova_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["n_regionkey", "p_brand"]
    sets = lines(spark, sf_dir).groupingSets([[], [F.col(keys[0])], [F.col(keys[1])], [F.col(k) for k in keys]], *keys)
    return sets.agg(F.count("*").alias("n"), F.round(F.avg("y"), 6).alias("mean"), F.round(F.var_pop("y"), 6).alias("var"))


@both("""WITH s AS (SELECT count(*) AS size FROM lineitem GROUP BY l_orderkey), k AS (SELECT unnest(range(1, 65))::INTEGER AS k)
  SELECT k, count(*) AS groups, round(count(*) / (SELECT count(*) FROM s)::DOUBLE, 6) AS group_share, round(sum(size) / (SELECT sum(size) FROM s)::DOUBLE, 6) AS row_share FROM k JOIN s ON size >= k GROUP BY k""")
def group_size_ccdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(g.size_ccdf(table(spark, sf_dir, "lineitem"), ["l_orderkey"]))


@both("""WITH g AS (SELECT count(l_quantity) AS m, var_pop(l_quantity) AS v, max(l_quantity) - min(l_quantity) AS r FROM lineitem GROUP BY l_orderkey)
  SELECT count(*) AS groups, round(avg((m >= 2)::INT), 6) AS multi, round(sqrt(sum(m * v) FILTER (m >= 2) / sum(m) FILTER (m >= 2)), 6) AS rms_within, round(quantile_cont(sqrt(v), 0.5) FILTER (m >= 2), 6) AS median_std,
  max(r) FILTER (m >= 2) AS max_range, count_if(m = 1) AS size_1, count_if(m = 2) AS size_2, count_if(m = 3) AS size_3, count_if(m = 4) AS size_4, count_if(m >= 5) AS size_5 FROM g""")
def group_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(g.spread(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_quantity"))


@both("""WITH g AS (SELECT count(*) AS m, count(DISTINCT l_returnflag) AS k FROM lineitem GROUP BY l_orderkey) SELECT count(*) AS groups, round(avg((k > 1)::INT), 6) AS split FROM g WHERE m >= 2""")
def group_split_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(g.split_rate(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_returnflag", 2))


@both(f"""WITH {L}, a AS (SELECT n_name, count(*) AS m, avg(y) AS mean, var_pop(y) AS v FROM l GROUP BY n_name) SELECT round(1 - sum(m * v) / (SELECT sum(power(y - (SELECT avg(y) FROM l), 2)) FROM l), 6) AS eta2 FROM a""")
def eta_squared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(g.decompose(lines(spark, sf_dir), ["n_name"], "y").select(F.col("ceiling").alias("eta2")))


@both("""WITH x AS (SELECT 'quantity' AS "column", l_quantity AS x FROM lineitem UNION ALL SELECT 'discount', l_discount FROM lineitem UNION ALL SELECT 'price', l_extendedprice FROM lineitem)
  SELECT "column", """ + ", ".join(f"round(quantile_cont(x, {p}), 6) AS p{round(p * 100)}" for p in (0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1)) + """, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, count(x) AS n_finite FROM x GROUP BY "column" """)
def quantile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_extendedprice").alias("price"))
    return rounded(g.quantile_summary(li, ["quantity", "discount", "price"]))


@both("SELECT event_type, count(*) AS n, round(avg((value > 50)::INT), 6) AS above_50, count(DISTINCT user_id) AS users, round(count(*)::DOUBLE / count(DISTINCT user_id), 6) AS per_user FROM events GROUP BY event_type")
def hygiene_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("event_type")
    return rounded(e.agg(F.count("*").alias("n"), g.rate_above(F.col("value"), 50.0).alias("above_50"), F.count_distinct("user_id").alias("users"), (F.count("*") / F.count_distinct("user_id")).alias("per_user")))


@both("SELECT p_type AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_type)::INTEGER AS rank FROM part GROUP BY p_type")
def value_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("value")).agg(F.count("*").alias("n"))
    return sampling.global_places(c, [F.desc("n"), "value"], "rank").withColumn("rank", F.col("rank").cast("int"))


@both("""WITH b AS (SELECT l_returnflag AS flag, least(greatest(floor((l_quantity - 1) / 2.5), 0), 19) AS bin, count(*) AS c FROM lineitem GROUP BY ALL),
  t AS (SELECT flag, sum(c) OVER (PARTITION BY flag) AS n, bin, row_number() OVER (PARTITION BY flag ORDER BY c DESC, bin) AS r FROM b) SELECT flag, n::BIGINT AS n, 1 + 2.5 * (bin + 0.5) AS mode FROM t WHERE r = 1""")
def histogram_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("flag", F.col("l_returnflag"))
    return g.histogram_mode(li, ["flag"], "l_quantity", 1.0, 2.5, 20, 30)


@both("SELECT l_returnflag AS a, l_linestatus AS b, floor(l_discount / 0.02)::BIGINT AS bin, count(*) AS n FROM lineitem GROUP BY ALL")
def sparse_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b"), F.floor(F.col("l_discount") / 0.02).alias("bin")).agg(F.count("*").alias("n"))


@both("SELECT round(power(corr(l_quantity, l_extendedprice), 2), 6) AS r2_quantity, round(power(corr(l_discount, l_extendedprice), 2), 6) AS r2_discount, round(power(corr(l_tax, l_extendedprice), 2), 6) AS r2_tax FROM lineitem")
def metadata_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    r2 = lambda c: F.pow(F.corr(c, "l_extendedprice"), 2).alias(f"r2_{c[2:]}")
    return rounded(table(spark, sf_dir, "lineitem").agg(r2("l_quantity"), r2("l_discount"), r2("l_tax")))


@both("""WITH r AS (SELECT l_returnflag AS flag, rank() OVER w + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS rx, rank() OVER v + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2 AS ry FROM lineitem
   WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_quantity), v AS (PARTITION BY l_returnflag ORDER BY l_extendedprice)) SELECT flag, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r GROUP BY flag""")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("flag", F.col("l_returnflag"))
    return rounded(g.spearman(li, ["flag"], "l_quantity", "l_extendedprice"))


@both("""WITH m AS (SELECT event_type, count(value) AS n, avg(value) AS mu, var_pop(value) AS v FROM events GROUP BY event_type), c AS (SELECT event_type, any_value(n) AS n, sqrt(any_value(v)) / any_value(mu) AS cv, avg(power(value - mu, 3)) / power(any_value(v), 1.5) AS skew, avg(power(value - mu, 4)) / power(any_value(v), 2) - 3 AS kurt FROM events JOIN m USING (event_type) GROUP BY event_type)
  SELECT event_type, n, round(cv, 6) AS cv, round(skew, 6) AS skew, round(kurt, 6) AS kurt, round((skew * skew + 1) / (kurt + 3), 6) AS bimodality FROM c""")
def moments_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(g.moments(table(spark, sf_dir, "events"), ["event_type"], "value"))


@both("SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority)::INTEGER - 1 AS code FROM orders")
def category_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.category_codes(table(spark, sf_dir, "orders"), "o_orderpriority", "code").select("o_orderkey", "code")


@both("""WITH s AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS d FROM lineitem WHERE l_orderkey % 5 <> 0) SELECT l_orderkey, l_linenumber, round((l_quantity - m) / d, 6) AS standard, round((l_quantity - m) / sqrt(d), 6) AS pareto, round(l_quantity - m, 6) AS centred FROM lineitem CROSS JOIN s""")
def column_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(F.col("l_quantity").alias(c) for c in ("standard", "pareto", "centred")))
    fit = F.col("l_orderkey") % 5 != 0
    for c, how in (("standard", "standard"), ("pareto", "pareto"), ("centred", "center")):
        li = g.scaled(li, [c], how, fit)
    return rounded(li)


@both("""SELECT p_partkey, CASE WHEN split_part(p_brand, '#', 2) IN (SELECT split_part(p_brand, '#', 2) FROM part GROUP BY 1 HAVING count(*) >= 30) THEN split_part(p_brand, '#', 2) ELSE 'other' END AS bucket FROM part""")
def catch_all_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.split_part("p_brand", F.lit("#"), F.lit(2)).alias("label"))
    common = p.groupBy("label").agg(F.count("*").alias("n")).where("n >= 30").select("label", F.lit(True).alias("kept"))
    return p.join(common, "label", "left").select("p_partkey", F.when(F.col("kept"), F.col("label")).otherwise("other").alias("bucket"))


@both("""WITH e AS (SELECT *, md5('7:' || o_orderkey) AS h FROM orders), r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY h, o_orderkey) AS r FROM e),
  a AS (SELECT o_orderkey, o_orderpriority, r <= 40 AS early, r, row_number() OVER (ORDER BY r <= 40 DESC, md5('7:' || o_orderkey), o_orderkey) AS g FROM r) SELECT o_orderkey, o_orderpriority FROM a WHERE g <= 220""")
def stratified_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified_equal(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderpriority", size=220, per=40, seed=7).select("o_orderkey", "o_orderpriority")


@both("""WITH c AS (SELECT o_orderpriority, greatest(50, ceil(0.02 * count(*)))::BIGINT AS quota FROM orders GROUP BY 1), r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('7:' || o_orderkey), o_orderkey) AS r FROM orders)
  SELECT o_orderkey, o_orderpriority FROM r JOIN c USING (o_orderpriority) WHERE r <= quota""")
def stratified_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified_share(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderpriority", share=0.02, floor=50, seed=7).select("o_orderkey", "o_orderpriority")


@both("""WITH s AS (SELECT o_custkey, count(*) AS size, md5('7:' || o_custkey) AS h FROM orders GROUP BY 1 HAVING count(*) >= 2), c AS (SELECT o_custkey, coalesce(sum(least(size, 8)) OVER (ORDER BY h, o_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s),
  r AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY md5('7:' || o_orderkey), o_orderkey) AS r FROM orders) SELECT o_orderkey, o_custkey FROM r JOIN c USING (o_custkey) WHERE r <= 8 AND before < 300""")
def cluster_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.cluster(table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey", size=300, cap=8, least=2, seed=7).select("o_orderkey", "o_custkey")


@both("SELECT o_orderkey, md5('7:' || o_orderkey) < '33333333333333333333333333333333' AS test FROM orders")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", (sampling.order_key("o_orderkey", 7) < "3" * 32).alias("test"))


@both("SELECT o_orderkey FROM orders WHERE o_totalprice > 0 ORDER BY md5('7:' || o_orderkey), o_orderkey LIMIT 100")
def uniform_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.uniform(table(spark, sf_dir, "orders").where("o_totalprice > 0"), "o_orderkey", 100, 7).select("o_orderkey")


@both("""SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders) WHERE r % 13 = 1""")
def strided_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.strided(table(spark, sf_dir, "orders"), "o_orderkey", 13).select("o_orderkey")


@both("""SELECT o_orderkey, ('0x' || substr(md5('7:' || o_custkey), 1, 8))::BIGINT % 5 AS fold FROM orders""")
def group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.folds(table(spark, sf_dir, "orders"), "o_custkey", 5, 7).select("o_orderkey", "fold")


@both("""WITH w AS (SELECT md5('7:' || doc_id) AS h, doc_id, unnest(list_distinct(string_split(text, ' '))) AS label FROM documents), d AS (SELECT doc_id, row_number() OVER (ORDER BY md5('7:' || doc_id), doc_id) AS place FROM documents),
  o AS (SELECT label, place, row_number() OVER (PARTITION BY label ORDER BY place) AS k FROM w JOIN d USING (doc_id)), n AS (SELECT DISTINCT t >> k AS n FROM (SELECT count(*) AS t FROM documents) CROSS JOIN (SELECT unnest(range(0, 60)) AS k) WHERE k = 0 OR t >> k >= 10) SELECT n, count_if(k = 1) AS labels, count_if(k = 2) AS twice FROM n JOIN o ON place <= n GROUP BY n""")
def nested_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = docs.select("doc_id", F.explode(F.array_distinct(F.split("text", " "))).alias("label"))
    return sampling.growth(docs.select("doc_id"), labels, "doc_id", "label", 7)


@both("""WITH h AS (SELECT date_trunc('hour', ts) AS t, avg(value) AS v FROM events GROUP BY 1) SELECT t, round(quantile_cont(v, 0.5) OVER (ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS rolling,
  round((coalesce(lag(v) OVER (ORDER BY t), 0) + v + coalesce(lead(v) OVER (ORDER BY t), 0)) / 3, 6) AS smooth, round(max(v) OVER (ORDER BY t), 6) AS running_max FROM h""")
def rolling_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("t")).agg(F.avg("value").alias("v"))
    w = Window.orderBy("t")  # one row an hour
    v = F.col("v")
    smooth = (F.coalesce(F.lag(v).over(w), F.lit(0.0)) + v + F.coalesce(F.lead(v).over(w), F.lit(0.0))) / 3
    return rounded(h.select("t", F.percentile(v, 0.5).over(w.rowsBetween(-1, 1)).alias("rolling"), smooth.alias("smooth"), F.max(v).over(w).alias("running_max")))


@both("""WITH h AS (SELECT date_trunc('day', ts) AS t, sum(value) AS v FROM events GROUP BY 1), c AS (SELECT t, sum(v) OVER (ORDER BY t) AS c, sum(v) OVER () AS total FROM h) SELECT min(t) FILTER (c >= 0.95 * total) AS reach, min(t) FILTER (c >= 0.5 * total) AS half FROM c""")
def first_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "events").groupBy(F.date_trunc("day", "ts").alias("t")).agg(F.sum("value").alias("v"))
    c = h.withColumn("c", F.sum("v").over(Window.orderBy("t"))).withColumn("total", h.agg(F.sum("v")).scalar())
    at = lambda f: F.min(F.when(F.col("c") >= f * F.col("total"), F.col("t")))
    return c.agg(at(0.95).alias("reach"), at(0.5).alias("half"))


@both("""WITH x AS (SELECT l_orderkey, l_linenumber, ntile(20) OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS bin, l_extendedprice AS p, l_quantity AS q FROM lineitem) SELECT bin::INTEGER AS bin, count(*) AS n, round(min(p), 6) AS low, round(max(p), 6) AS high, round(avg(q), 6) AS mean FROM x GROUP BY bin""")
def equal_count_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    binned = sampling.equal_count(li, ["l_extendedprice", "l_orderkey", "l_linenumber"], 20)
    return rounded(binned.groupBy("bin").agg(F.count("*").alias("n"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"), F.avg("l_quantity").alias("mean")))


QUERIES, ORACLE_SQL = Q, O
