"""The corpus pipeline: quality rules, near-duplicates, secrets, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents:

* quality rules: documents that a rule rejects go;
* near_dup: one document of each class of near copies stays, the one with the smallest id;
* secrets: every secret in a text is replaced by a mark, and n_chars follows; no document goes;
* mix: each document stays as often as the mix takes it, so some come twice or three times and some not at all;
* pack: one row for each piece of a document, with its sequence and its place there.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from skerry.llm import mixing, near_dup, packing, quality_rules, secret_scan
from skerry.session import prepare, remove_folder, shared_folder, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.passing(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.deduplicated(docs, radius=3)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.drawn(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, most=2048)


STAGES = [
    ("quality_rules", keep_quality),
    ("simhash_near_dup", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack),
]

ORACLE_SQL = None  # fingerprints and tokens have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again in the shared folder; what a stage read goes once it is done."""
    prepare(spark)
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(out := f"{base}/{k}-{name}")
        docs = spark.read.parquet(out)
        if before:
            remove_folder(spark, before)
        before = out
    return docs
