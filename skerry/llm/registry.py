"""The numbered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm import lexical_search, lm_scoring, mixing, near_dup, nearest, packing, prefix_trie, quality_model, quality_rules, secret_scan, token_files, toxicity, url_filter
from skerry.llm.labelled import remainder
from skerry.session import shared_folder, table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scanned(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, most=2048)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.encoded(table(spark, sf_dir, "documents"), shared_folder(spark), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, added=True)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, part = table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 3)
    model = quality_model.fitted(docs, table(spark, sf_dir, "labels"), part != 1)
    return quality_model.scored(docs, model).select("doc_id", (part == 1).alias("held_out"), "score", "predicted")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, part = table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 5)
    model = toxicity.fitted(docs, table(spark, sf_dir, "labels"), part != 0)
    spans = F.array_join(F.transform("passages", lambda p: F.concat_ws(":", p["first"], p["last"])), ",").alias("passages")
    return toxicity.scored(docs, model).select("doc_id", (part == 0).alias("held_out"), "score", "predicted", spans)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"))


def op10_simhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.linked(table(spark, sf_dir, "documents"), radius=3)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.scored(table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 7) == 2)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.crc32(F.col("c").cast("string").cast("binary")) % 6
    nodes = prefix_trie.trie(table(spark, sf_dir, "conversations"), base=F.col("c") - F.col("c") % 100, head=head, most_head=5)
    return nodes.drop("position", "subtree_end")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_secret_scan": op2_secret_scan,
    "op3_packing": op3_packing,
    "op4_token_files": op4_token_files,
    "op5_quality_rules": op5_quality_rules,
    "op6_nearest": op6_nearest,
    "op7_quality_model": op7_quality_model,
    "op8_toxicity": op8_toxicity,
    "op9_url_filter": op9_url_filter,
    "op10_simhash_near_dup": op10_simhash_near_dup,
    "op11_lexical_search": op11_lexical_search,
    "op12_lm_scoring": op12_lm_scoring,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLE_SQL: dict[str, str] = {
    "op5_quality_rules": quality_rules.ORACLE_SQL,
    "op6_nearest": nearest.ORACLE_SQL,
    "op9_url_filter": url_filter.ORACLE_SQL,
    "op11_lexical_search": lexical_search.ORACLE_SQL,
    "op13_prefix_trie": prefix_trie.ORACLE_SQL,
}
