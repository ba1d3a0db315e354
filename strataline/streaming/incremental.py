"""Incremental forms: mergeable partial aggregates over a stream of batches, and clusters that grow with their input.

The aggregates are monotone, so no watermark is needed. State lives in tables in a folder; a batch that is replayed after a failure replaces what
its first attempt wrote, because every batch writes under its own number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def merged(partials: DataFrame, keys: list[str], rules: dict[str, str]) -> DataFrame:
    """Partials of one key become one row: `rules` maps columns to max, min or sum."""
    how = {"max": F.max, "min": F.min, "sum": F.sum}
    return partials.groupBy(*keys).agg(*[how[r](c).alias(c) for c, r in rules.items()])


def running_aggregate(stream: DataFrame, partial, keys: list[str], rules: dict[str, str], folder: str, checkpoint: str):
    """Starts a query that keeps each batch's partials in `folder`; `current` reads them merged. `partial` maps a batch to partials."""

    def save(batch: DataFrame, number: int) -> None:
        merged(partial(batch), keys, rules).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, folder: str, keys: list[str], rules: dict[str, str]) -> DataFrame:
    return merged(spark.read.parquet(folder).drop("batch"), keys, rules)


def assign_new(batch: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """Rows of the batch whose key the state doesn't have yet."""
    return batch.join(state.select(key), key, "left_anti")


def streamed_edges(stream: DataFrame, query_name: str, mode: str = "complete"):
    """The best statistics of every edge as a streaming aggregate in an in-memory table."""
    best = stream.groupBy("a", "b").agg(F.max("pident").alias("pident"), F.min("evalue").alias("evalue"), F.max("bitscore").alias("bitscore"), F.max("length").alias("length"))
    return best.writeStream.outputMode(mode).format("memory").queryName(query_name).trigger(availableNow=True).start()
