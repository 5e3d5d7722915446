"""Deviations of out-of-fold predictions over `embeddings`, by arm, by category, and where a category is held out.

Folds are vec_id modulo 5, halves the next bit, size classes vec_id modulo 3.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.operators import arms
from skerry.plans.census import rounded
from skerry.plans.pairs import N, points
from skerry.plans.spatial import crps_sql

Q, O = {}, {}  # noqa: E741


def both(sql: str):
    def put(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return put


_Q90 = f"{NormalDist().inv_cdf(0.95)!r}::DOUBLE"
_LONG = f"""{N}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, neighbour_id) AS k FROM n WHERE query_id % 5 <> neighbour_id % 5),
  g AS (SELECT query_id AS id, any_value(ql) AS cat, any_value(qy) AS y, avg(cy) AS mu, stddev_pop(cy) AS latent, min(d) AS distance FROM o WHERE k <= 10 GROUP BY 1),
  rr AS (SELECT *, id % 5 AS fold, id // 5 % 2 AS half, id % 3 AS size, (y - mu) * (y - mu) AS e FROM g),
  lo AS (SELECT a.cat, a.size, a.fold, (any_value(t.s) - sum(a.e)) / nullif(any_value(t.n) - count(*), 0) AS local FROM rr a JOIN (SELECT cat, size, sum(e) AS s, count(*) AS n FROM rr GROUP BY 1, 2) t ON t.cat = a.cat AND t.size = a.size GROUP BY 1, 2, 3),
  no AS (SELECT fold, (any_value(t.s) - sum(e)) / nullif(any_value(t.n) - count(*), 0) AS noise FROM rr CROSS JOIN (SELECT sum(e) AS s, count(*) AS n FROM rr) t GROUP BY fold),
  h AS (SELECT rr.*, sqrt(coalesce(local, noise)) AS sc, sqrt(latent * latent * 1.1::DOUBLE + noise) AS ln FROM rr LEFT JOIN lo USING (cat, size, fold) LEFT JOIN no USING (fold)),
  l AS (SELECT id, cat, half, y, mu, unnest(['constant', 'size_category', 'distance', 'latent', 'latent_noise']) AS arm, greatest(unnest([1.0::DOUBLE, sc, distance, latent, ln]), 1e-9) AS sigma FROM h),
  fi AS (SELECT arm, 1 - half AS half, sqrt(avg(power((y - mu) / sigma, 2))) AS scale FROM l GROUP BY 1, 2), x AS (SELECT l.*, greatest(scale * sigma, 1e-9) AS scaled, (y - mu) / greatest(scale * sigma, 1e-9) AS z FROM l JOIN fi USING (arm, half))"""


def _scores_sql(keys: str) -> str:
    area = " + ".join(f"abs(avg((abs(z) <= {NormalDist().inv_cdf(0.5 + p / 2)!r}::DOUBLE)::INT) - {p})" for p in arms.LEVELS)
    return f"""hv AS (SELECT {keys}, half, avg(0.5 * ln(2 * pi() * scaled * scaled) + 0.5 * z * z) AS nlpd, avg({crps_sql("scaled")}) AS crps FROM x GROUP BY {keys}, half), ha AS (SELECT {keys}, avg(nlpd) AS nlpd, avg(crps) AS crps FROM hv GROUP BY {keys}),
      wh AS (SELECT {keys}, count(*) AS n, ({area}) / 19 AS area, stddev_pop(z) AS std_z, avg((abs(z) <= {_Q90})::INT) AS cover90, stddev_pop(sigma) / avg(sigma) AS spread FROM x GROUP BY {keys}),
      ks AS (SELECT *, abs(y - mu) AS error FROM x), rk AS (SELECT {keys}, sigma, error, rank() OVER (PARTITION BY {keys} ORDER BY sigma) + (count(*) OVER (PARTITION BY {keys}, sigma) - 1) / 2 AS rs, rank() OVER (PARTITION BY {keys} ORDER BY error) + (count(*) OVER (PARTITION BY {keys}, error) - 1) / 2 AS re FROM ks),
      rh AS (SELECT {keys}, covar_pop(rs, re) / nullif(stddev_pop(rs) * stddev_pop(re), 0) AS rho, list_reverse_sort(list(sigma)) AS ls, list_reverse_sort(list(error)) AS le, greatest(floor(0.05 * count(*)), 1)::INT AS k FROM rk GROUP BY {keys}),
      hi AS (SELECT {keys}, any_value(rho) AS rho, count_if(sigma >= ls[k] AND error >= le[k]) / greatest(count_if(sigma >= ls[k]), count_if(error >= le[k]))::DOUBLE AS recall FROM rk JOIN rh USING ({keys}) GROUP BY {keys})"""


def long_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).withColumn("fold", F.col("vec_id") % 5)
    found = arms.predicted(p, "fold", 10).join(p.select(F.col("vec_id").alias("id"), "label"), "id").withColumn("size", F.col("id") % 3)
    return arms.cross_scaled(arms.candidates(found, "label", "size", 10), F.floor(F.col("id") / 5) % 2)


@both(f"""WITH {_LONG}, {_scores_sql("arm")} SELECT arm, n, round(nlpd, 6) AS nlpd, round(crps, 6) AS crps, round(area, 6) AS area, round(std_z, 6) AS std_z, round(cover90, 6) AS cover90, round(spread, 6) AS spread, round(rho, 6) AS rho, round(recall, 6) AS recall,
  round(1 - crps / (SELECT crps FROM ha WHERE arm = 'constant'), 6) AS skill FROM ha JOIN wh USING (arm) JOIN hi USING (arm)""")
def arm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each arm at its own cross-fitted scale: density, CRPS and its skill, calibration, spread, rank skill and recall."""
    x = long_table(spark, sf_dir)
    return rounded(arms.with_skill(arms.scores(x, ["arm"]).join(arms.rank_skill(x, ["arm"]), "arm"), []))


@both(f"""WITH {_LONG}, {_scores_sql("arm, cat")} SELECT arm, cat, n, round(nlpd, 6) AS nlpd, round(a.crps, 6) AS crps, round(area, 6) AS area, round(std_z, 6) AS std_z, round(cover90, 6) AS cover90, round(spread, 6) AS spread, round(rho, 6) AS rho, round(recall, 6) AS recall, round(1 - a.crps / b.crps, 6) AS skill
  FROM ha a JOIN wh USING (arm, cat) JOIN hi USING (arm, cat) JOIN (SELECT cat, crps FROM ha WHERE arm = 'constant') b USING (cat)""")
def arm_scores_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same within categories, with the scales of the whole table."""
    x = long_table(spark, sf_dir)
    return rounded(arms.with_skill(arms.scores(x, ["arm", "cat"]).join(arms.rank_skill(x, ["arm", "cat"]), ["arm", "cat"]), ["cat"]))


@both(f"""WITH {N}, c AS (SELECT label AS cat, count(*) AS n FROM p GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 4), t AS (SELECT vec_id AS id, label AS cat, y FROM p WHERE vec_id // 5 % 2 = 0 AND label IN (SELECT cat FROM c)),
  f AS (SELECT c.cat AS scope, c.n, vec_id, row_number() OVER (PARTITION BY c.cat ORDER BY md5('9:' || vec_id), vec_id) AS place, (SELECT count(*) FROM p) AS total FROM p CROSS JOIN c WHERE NOT (label = c.cat AND vec_id // 5 % 2 = 0)),
  e AS (SELECT 'held_out' AS split, query_id, neighbour_id, cy, d FROM n JOIN t ON t.id = query_id WHERE cl <> t.cat UNION ALL SELECT 'control', query_id, neighbour_id, cy, d FROM n JOIN t ON t.id = query_id JOIN f ON f.scope = t.cat AND f.vec_id = neighbour_id AND f.place <= f.total - f.n),
  k AS (SELECT *, row_number() OVER (PARTITION BY split, query_id ORDER BY d, neighbour_id) AS k FROM e), g AS (SELECT split, query_id AS id, avg(cy) AS mu, greatest(stddev_pop(cy) * sqrt(1.1::DOUBLE), 1e-9) AS sigma FROM k WHERE k <= 10 GROUP BY 1, 2),
  x AS (SELECT cat, split, y, mu, sigma, (y - mu) / sigma AS z FROM g JOIN t USING (id)), rk AS (SELECT *, rank() OVER (PARTITION BY cat, split ORDER BY sigma) + (count(*) OVER (PARTITION BY cat, split, sigma) - 1) / 2 AS rs, rank() OVER (PARTITION BY cat, split ORDER BY abs(y - mu)) + (count(*) OVER (PARTITION BY cat, split, abs(y - mu)) - 1) / 2 AS re FROM x),
  ss AS (SELECT cat, split, count(*) AS n, sqrt(avg((y - mu) * (y - mu))) AS rmse, avg(sigma) AS sharpness, avg({crps_sql("sigma")}) AS crps, avg((abs(z) <= {_Q90})::INT) AS cover90, covar_pop(rs, re) / nullif(stddev_pop(rs) * stddev_pop(re), 0) AS rho FROM rk GROUP BY cat, split)
  SELECT a.cat, a.split, a.n, round(a.rmse, 6) AS rmse, round(a.sharpness, 6) AS sharpness, round(a.crps, 6) AS crps, round(a.cover90, 6) AS cover90, round(a.rho, 6) AS rho, round(a.rmse / b.rmse, 6) AS degradation FROM ss a JOIN ss b ON b.cat = a.cat AND b.split = 'control'""")
def held_out_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four largest categories without any row of their own, beside a control of matched size: error, deviation, CRPS, coverage and rank skill."""
    x = arms.held_out(points(spark, sf_dir), 10, 4, F.floor(F.col("vec_id") / 5) % 2 == 0, 9)
    return rounded(arms.split_scores(x))


QUERIES, ORACLE_SQL = Q, O
