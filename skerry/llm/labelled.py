"""A bounded, seeded sample of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.session import durable


def remainder(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n (null for a null id)."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(n))


def labelled_sample(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str, text_col: str, label_col: str, most: int, seed: int = 5) -> DataFrame:
    """(text, label) of at most `most` labelled rows for which `learn`, a condition on the id, holds.

    Ids are drawn by hash; of rows with equal ids the one with the smallest text hash is taken.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).where(learn)
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("label"))
    drawn = durable(known.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(most))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = rows.join(F.broadcast(drawn), "id")  # `most` narrow rows at most
    one = found.groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("label").alias("label"))
    return one.select("text", F.col("label").cast("int").alias("label"))
