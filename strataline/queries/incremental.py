"""Incremental queries: events replayed in batches."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strataline.queries import query
from strataline.session import shared_folder, table
from strataline.streaming import incremental as I

SQL_BEST = "SELECT user_id, max(value) AS top, min(event_id) AS first, count(*) AS n FROM events GROUP BY user_id"
RULES = {"top": "max", "first": "min", "n": "sum"}


def _partial(batch):
    return batch.groupBy("user_id").agg(F.max("value").alias("top"), F.min("event_id").alias("first"), F.count(F.lit(1)).alias("n"))


@query(SQL_BEST)
def str02_str03_replayed_batches(spark, d):
    parts = None
    for k in range(3):
        p = _partial(table(spark, d, "events").where(F.col("event_id") % 3 == k))
        parts = p if parts is None else parts.union(p)
    return I.merged(parts, ["user_id"], RULES)


@query(SQL_BEST)
def str03_streamed_aggregate(spark, d):
    schema = table(spark, d, "events").schema
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(d)
    I.running_aggregate(stream, _partial, ["user_id"], RULES, f"{folder}/state", f"{folder}/progress").awaitTermination()
    return I.current(spark, f"{folder}/state", ["user_id"], RULES)


@query("SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_id % 20 = 0)")
def str04_new_keys(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id")
    return I.assign_new(e, e.where("event_id % 20 = 0").select("user_id").distinct(), "user_id")
