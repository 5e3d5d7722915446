"""Feature channels joined into one vector of a fixed layout, and vocabularies fitted on training rows.

A channel gives (row, slot, value) with slots from 0; a directory says where each channel stands in the vector. Only
places and values that are not zero move, and a row's vector is filled inside its task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skerry.operators.graphs import vocabulary
from skerry.operators.hot_keys import hot_join
from skerry.operators.sampling import global_places


@dataclass(frozen=True)
class Channel:
    """name, number of slots, and (row, slot, value); values of one slot add up, nulls count as zero."""

    name: str
    width: int
    entries: DataFrame

    @classmethod
    def dense(cls, name: str, width: int, rows: DataFrame, values: Column) -> Channel:
        """From (row, ...) with an array of `width` values, of which zeros don't move."""
        every = rows.select("row", F.posexplode(values).alias("slot", "value"))
        return cls(name, width, every.where((F.coalesce("value", F.lit(0)) != 0) | (F.col("slot") >= width)))


def directory(channels: list[Channel]) -> list[tuple[str, int, int]]:
    """(name, first place, width) of each channel."""
    firsts = accumulate([0] + [c.width for c in channels[:-1]])
    return [(c.name, first, c.width) for c, first in zip(channels, firsts)]


def assembled(rows: DataFrame, channels: list[Channel]) -> DataFrame:
    """(row, vector) for each row of `rows`; slots outside a channel's width raise an error, rows without entries are zeros.

    Rows with a null in `row` and entries of unknown rows take no part.
    """
    width = sum(c.width for c in channels)
    parts = []
    for c, (name, first, held) in zip(channels, directory(channels)):
        inside = (F.col("slot") >= 0) & (F.col("slot") < held)
        slot = F.when(inside, F.col("slot") + first).otherwise(F.raise_error(F.concat(F.lit(f"slot outside channel {name}: "), F.col("slot").cast("string"))).cast("long"))
        parts.append(c.entries.select("row", slot.cast("int").alias("slot"), F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value")))
    sparse = reduce(DataFrame.unionByName, parts).groupBy("row").agg(F.collect_list("slot").alias("slots"), F.collect_list("value").alias("values"))
    whole = rows.select("row").dropna().distinct().join(sparse, "row", "left").select("row", F.coalesce("slots", F.array().cast("array<int>")).alias("slots"), F.coalesce("values", F.array().cast("array<double>")).alias("values"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 1024):
                part = batch.slice(a, 1024)
                sizes = part.column(1).value_lengths().to_numpy(zero_copy_only=False)
                dense = np.zeros((len(part), width))
                np.add.at(dense, (np.repeat(np.arange(len(part)), sizes), part.column(1).flatten().to_numpy(zero_copy_only=False)), part.column(2).flatten().to_numpy(zero_copy_only=False))
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * width), pa.array(dense.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column(0), vectors], names=["row", "vector"])

    return whole.mapInArrow(fill, T.StructType([whole.schema["row"], T.StructField("vector", T.ArrayType(T.DoubleType()))]))


def fitted_vocabulary(counts: DataFrame, train: Column, least: int) -> DataFrame:
    """(depth, label, doc_freq, col) of the labels of at least `least` training records, by depth and label; columns count from 0."""
    return global_places(vocabulary(counts.where(train), least), ["depth", "label"], "col").withColumn("col", F.col("col") - 1)


def label_matrix(counts: DataFrame, vocab: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, col, val) of counts (gidx, depth, label, cnt) by a vocabulary, and (row, unseen), the share of a record's counts outside it."""
    held = counts.groupBy("depth", "label").agg(F.count("*").alias("n")).join(vocab.select("depth", "label", "col"), ["depth", "label"], "left")
    met = hot_join(counts.select("gidx", "depth", "label", "cnt"), held, ["depth", "label"], counts.count()).withColumnRenamed("gidx", "row")
    unseen = met.groupBy("row").agg((F.sum(F.when(F.col("col").isNull(), F.col("cnt")).otherwise(0.0)) / F.sum("cnt")).alias("unseen"))
    return met.where("col IS NOT NULL").select("row", "col", F.col("cnt").alias("val")), unseen
