"""A corpus pipeline of five operators, each stage written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.llm import host_rules, knn_quality, mixing, packing, simhash
from strataline.session import stored, table

DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose nearest labelled neighbours vote for them.

    Every row is scored on its own, null and empty texts from no terms, so repeated rows stay or go together; without labels every row has 0.5
    and stays; an empty table stays empty.
    """
    scored = knn_quality.scored(docs.select(*DOCUMENT), table(spark, sf_dir, "labels"), keep=True)
    return scored.where(F.col("_score") >= knn_quality.THRESHOLD).select(*DOCUMENT)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host isn't rejected.

    Null, empty and short texts go; a null source is a host of its own; repeated rows are judged alike; an empty table stays empty.
    """
    return host_rules.judge(docs.select(*DOCUMENT), keep_rows=True).where("kept").select(*DOCUMENT)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group at a similarity of 0.8 or more of five-word shingles: of the smallest id, rows without one last, then by a hash of the row.

    Groups are of rows: rows of one id with unlike texts all stay, and rows without an id are like any other. Texts of fewer words are one
    shingle; null, empty and blank texts are one group; an empty table stays empty.
    """
    first = [F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64(*DOCUMENT).alias("hash")]
    return simhash.deduplicated(docs.select(*DOCUMENT), first).select(*DOCUMENT)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources mixed to their target weights, in runs of slots.

    A row comes once an epoch that takes words of it, cut at the last; texts without words are never taken; a null source is a source;
    repeated rows are taken one by one; an empty table stays empty.
    """
    return mixing.sampled(docs.select(*DOCUMENT))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's tokens in windows. Null and empty texts are the end token alone; repeated rows are packed one by one; an empty table gives no piece."""
    return packing.packed(docs.select(*DOCUMENT))


STAGES = [("quality_classifier", quality_classifier), ("quality_rules", quality_rules), ("near_dedup", near_dedup), ("source_mix", source_mix), ("pack", pack)]

#: Classifier, fingerprints and tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, on the whole documents table; what passes between them lies in the folder that all executors share."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))  # a stage's rows go once the next one's are written
    return docs
