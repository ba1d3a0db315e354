"""The subpackage's registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.llm import backoff_lm, bm25, chat, host_rules, html_consensus, knn_quality, langid, mixing, packing, simhash
from strataline.session import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = bm25.search(docs, docs.where(F.col("doc_id") % 20 == 0))
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), "place")


def op3_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotated(table(spark, sf_dir, "conversations"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op6_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = host_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_html_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_consensus.extracted(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op8_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predicted(table(spark, sf_dir, "documents"))


def op10_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = backoff_lm.scored(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", "n_backoff", F.round("log_score", 6).alias("log_score"), F.round("mean_log", 6).alias("mean_log"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_simhash, op2_bm25, op3_perspectives, op4_mixing, op5_packing, op6_host_rules, op7_html_consensus, op8_knn_quality, op9_langid, op10_backoff_lm)}
