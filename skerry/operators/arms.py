"""Candidate deviations of predictions: built out of fold, scaled on one half, scored on the other, by arm and category.

A prediction is the mean of the k nearest rows of other folds. Its candidates for a deviation are a constant, the
residual's deviation in the row's size class and category, the nearest distance, the neighbours' own deviation, and that
with the error of their mean and the noise. What is fitted for a fold comes from sums over all rows less the fold's, so
that one pass serves every fold.

Rows with a null id, vector, fold or y take no part; deviations are at least LEAST.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.functions import stats
from skerry.operators import order_stats, pairs
from skerry.operators.sampling import global_places, order_key
from skerry.session import durable

LEAST = 1e-9
ARMS = ("constant", "size_category", "distance", "latent", "latent_noise")
LEVELS = [k / 20 for k in range(1, 20)]


def neighbour_means(near: DataFrame, rows: DataFrame, id_col: str, y: str) -> DataFrame:
    """(id, mu, latent, distance) of (query_id, neighbour_id, d): mean and population deviation of the neighbours' y, and the least d."""
    of = rows.select(F.col(id_col).alias("neighbour_id"), F.col(y).alias("v"))
    met = near.join(of, "neighbour_id")
    return met.groupBy(F.col("query_id").alias("id")).agg(F.avg("v").alias("mu"), F.coalesce(F.stddev_pop("v"), F.lit(0.0)).alias("latent"), F.min("d").alias("distance"))


def predicted(rows: DataFrame, fold: str, k: int, id_col: str = "vec_id", vector_col: str = "embedding", y: str = "y") -> DataFrame:
    """(id, fold, y, mu, latent, distance) from the k nearest rows of other folds; searched once, since what is fitted reads it many times."""
    rows = rows.where(F.col(fold).isNotNull() & F.col(y).isNotNull())
    near = pairs.nearest(rows, k, id_col, vector_col, None, apart=F.col(fold))
    own = rows.select(F.col(id_col).alias("id"), F.col(fold).alias("fold"), F.col(y).alias("y"))
    return durable(own.join(neighbour_means(near, rows, id_col, y), "id"))


def other_folds(rows: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """(keys, fold, `name`): mean of a value over the group's rows of other folds, null where there are none."""
    own = rows.groupBy(*keys, "fold").agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    if keys:
        all_ = own.groupBy(*keys).agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
        met = own.join(all_, keys)
    else:
        total = own.agg(F.struct(F.sum("s").alias("s"), F.sum("n").alias("n")))
        met = own.withColumn("all", total.scalar()).select("*", F.col("all.s").alias("all_s"), F.col("all.n").alias("all_n"))
    return met.select(*keys, "fold", ((F.col("all_s") - F.col("s")) / F.nullif(F.col("all_n") - F.col("n"), F.lit(0))).alias(name))


def candidates(found: DataFrame, cat: str, size: str, k: int) -> DataFrame:
    """(id, cat, fold, y, mu, arm, sigma), a row for each arm, of predictions with their category and size class."""
    square = F.pow(F.col("y") - F.col("mu"), 2)
    local = other_folds(found, [cat, size], square, "local")
    noise = other_folds(found, [], square, "noise")
    met = found.join(local, [cat, size, "fold"], "left").join(F.broadcast(noise), "fold", "left")  # one row a fold
    arms = {
        "constant": F.lit(1.0),
        "size_category": F.sqrt(F.coalesce("local", "noise")),
        "distance": F.col("distance"),
        "latent": F.col("latent"),
        "latent_noise": F.sqrt(F.col("latent") * F.col("latent") * (1 + 1 / k) + F.col("noise")),
    }
    each = F.array(*(F.struct(F.lit(n).alias("arm"), F.greatest(s, F.lit(LEAST)).alias("sigma")) for n, s in arms.items()))
    return met.select("id", F.col(cat).alias("cat"), "fold", "y", "mu", F.inline(each))


def cross_scaled(long: DataFrame, half: Column) -> DataFrame:
    """long with `scaled`: the deviation times the root mean square of errors over deviations of its arm's other half (0 or 1)."""
    rows = long.withColumn("half", half.cast("int"))
    z = F.pow((F.col("y") - F.col("mu")) / F.col("sigma"), 2)
    fits = rows.groupBy("arm", "half").agg(F.sqrt(F.avg(z)).alias("scale")).select("arm", (1 - F.col("half")).alias("half"), "scale")
    return durable(rows.join(F.broadcast(fits), ["arm", "half"]).withColumn("scaled", F.greatest(F.col("scale") * F.col("sigma"), F.lit(LEAST))).drop("scale"))  # two rows an arm


def rank_skill(long: DataFrame, keys: list[str], share: float = 0.05) -> DataFrame:
    """(keys, rho, recall): Spearman's rho of deviation and error, and the overlap of the top shares of both.

    A top share holds all rows that reach its least value; the overlap is counted against the larger of the two. Rho is
    null where either is constant.
    """
    rows = long.withColumn("error", F.abs(F.col("y") - F.col("mu")))
    ranked = order_stats.average_ranks(order_stats.average_ranks(rows.select(*keys, "sigma", "error"), keys, "sigma", "rs"), keys, "error", "re")
    flat = F.stddev_pop("rs") * F.stddev_pop("re")
    rho = ranked.groupBy(*keys).agg((F.covar_pop("rs", "re") / F.nullif(flat, F.lit(0.0))).alias("rho"))
    at = F.col("n") - F.greatest(F.floor(share * F.col("n")), F.lit(1))

    def least(x: str, name: str) -> DataFrame:
        places = order_stats.value_places(rows, keys, x)
        return places.where((F.col("before") <= at) & (at < F.col("before") + F.col("c"))).select(*(F.col(f"key.`{k}`").alias(k) for k in keys), F.col("value").alias(name))

    held = rows.join(F.broadcast(least("sigma", "least_s").join(least("error", "least_e"), keys)), keys)  # one row a group
    top_s, top_e = F.col("sigma") >= F.col("least_s"), F.col("error") >= F.col("least_e")
    hits = held.groupBy(*keys).agg((F.count_if(top_s & top_e) / F.greatest(F.count_if(top_s), F.count_if(top_e))).alias("recall"))
    return rho.join(hits, keys)


def scores(scaled: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, nlpd, crps, area, std_z, cover90, spread) of cross-scaled rows; densities and CRPS are means of the means of the two halves."""
    y, mu, s = F.col("y"), F.col("mu"), F.col("scaled")
    rows = scaled.withColumn("z", (y - mu) / s)
    halves = rows.groupBy(*keys, "half").agg(F.avg(stats.nlpd(y, mu, s)).alias("nlpd"), F.avg(stats.crps(y, mu, s)).alias("crps")).groupBy(*keys).agg(F.avg("nlpd").alias("nlpd"), F.avg("crps").alias("crps"))
    inside = lambda p: F.avg((F.abs("z") <= NormalDist().inv_cdf(0.5 + p / 2)).cast("int"))
    area = sum(F.abs(inside(p) - p) for p in LEVELS) / len(LEVELS)
    whole = rows.groupBy(*keys).agg(F.count("*").alias("n"), area.alias("area"), F.stddev_pop("z").alias("std_z"), inside(0.9).alias("cover90"), (F.stddev_pop("sigma") / F.avg("sigma")).alias("spread"))
    return whole.join(halves, keys)


def with_skill(found: DataFrame, keys: list[str]) -> DataFrame:
    """found (arm, keys, crps, ...) with `skill`, one less the CRPS over that of the constant arm."""
    base = found.where("arm = 'constant'").select(*keys, F.col("crps").alias("base"))
    met = found.join(base, keys) if keys else found.withColumn("base", base.select("base").scalar())
    return met.withColumn("skill", 1 - F.col("crps") / F.col("base")).drop("base")


def held_out(rows: DataFrame, k: int, families: int, test: Column, seed: int, id_col: str = "vec_id", vector_col: str = "embedding", cat: str = "label", y: str = "y") -> DataFrame:
    """(cat, split, id, y, mu, sigma) of the test rows of the largest categories, predicted without any row of the category, and in a control.

    The control may use the category's other rows; its candidates are drawn in seeded order down to the number that the
    held-out split has, so that the two differ in what they may see and not in how much.
    """
    rows = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("z"), F.col(cat).alias("cat"), F.col(y).alias("y"), test.alias("asks")).dropna()
    chosen = [(r["cat"], r["n"]) for r in rows.groupBy("cat").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cat").limit(families).collect()]
    total = rows.count()
    asked = F.col("asks") & F.col("cat").isin([c for c, _ in chosen])
    apart = pairs.nearest(rows, k, "id", "z", None, queries=asked, apart=F.col("cat"))
    scopes = F.array(*(F.struct(F.lit(c).alias("scope"), F.lit(n).alias("n")) for c, n in chosen))
    copies = rows.select("id", "z", "asks", F.col("cat").alias("own"), F.inline(scopes)).withColumn("q", F.col("asks") & (F.col("own") == F.col("scope")))
    free = global_places(copies.where("NOT q").select("scope", "n", "id", order_key("id", seed).alias("h")), ["scope", "h", "id"], "at")
    first = free.groupBy("scope").agg(F.min("at").alias("first"))
    kept = free.join(F.broadcast(first), "scope").where(F.col("at") - F.col("first") < F.lit(total) - F.col("n")).select("scope", "id", F.lit(True).alias("held"))
    control = copies.join(kept, ["scope", "id"], "left").withColumn("held", F.coalesce("held", F.lit(False)))
    inside = pairs.nearest(control, k, "id", "z", "scope", queries=F.col("q"), candidates=F.col("held"))
    both = [neighbour_means(near, rows, "id", "y").withColumn("split", F.lit(name)) for near, name in ((apart, "held_out"), (inside, "control"))]
    sigma = F.greatest(F.col("latent") * F.sqrt(F.lit(1 + 1 / k)), F.lit(LEAST))
    return durable(rows.select("id", "cat", "y").join(both[0].unionByName(both[1]), "id").select("cat", "split", "id", "y", "mu", sigma.alias("sigma")))  # as in `predicted`


def split_scores(found: DataFrame) -> DataFrame:
    """(cat, split, n, rmse, sharpness, crps, cover90, rho, degradation) of (cat, split, y, mu, sigma); degradation is the error over the control's."""
    y, mu, s = F.col("y"), F.col("mu"), F.col("sigma")
    inside = (F.abs((y - mu) / s) <= NormalDist().inv_cdf(0.95)).cast("int")
    keys = ["cat", "split"]
    sums = found.groupBy(*keys).agg(F.count("*").alias("n"), F.sqrt(F.avg(F.pow(y - mu, 2))).alias("rmse"), F.avg(s).alias("sharpness"), F.avg(stats.crps(y, mu, s)).alias("crps"), F.avg(inside).alias("cover90"))
    sums = sums.join(rank_skill(found, keys).select(*keys, "rho"), keys)
    base = sums.where("split = 'control'").select("cat", F.col("rmse").alias("base"))
    return sums.join(base, "cat").withColumn("degradation", F.col("rmse") / F.col("base")).drop("base")
