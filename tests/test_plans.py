"""Numbering, running sums, components and stored tables."""

import gc
import os
import random
import time

from pyspark.sql import functions as F

from strataline.plans.components import connected_components
from strataline.plans.ordering import numbered, running
from strataline.session import arrow_rows, bounded, cut, shared_folder, stored, swept


def test_numbered(spark):
    rng = random.Random(1)
    rows = [(k, rng.randrange(40), rng.randrange(100)) for k in range(500)]
    df = spark.createDataFrame(rows, "id long, v long, n long").repartition(7)
    got = {r.id: (r.place, r.ahead) for r in numbered(df, [F.desc("v"), F.col("id")], "place", {"ahead": F.col("n")}).collect()}
    ahead = 0
    for place, (k, _, n) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0]))):
        assert got[k] == (place, ahead)
        ahead += n
    assert numbered(df.limit(0), ["id"]).count() == 0


def test_running_with_nulls_and_ties(spark):
    rows = [(None, k % 3, 2) for k in range(20)] + [("a", k, 1) for k in range(30)]
    df = spark.createDataFrame(rows, "g string, o long, n long").withColumn("bucket", F.floor(F.col("o") / 4))
    out = running(df, ["g"], "bucket", [F.col("o")], F.col("n")).collect()
    for g in (None, "a"):
        own = sorted((r for r in out if r.g == g), key=lambda r: r.rank0)
        assert [r.rank0 for r in own] == list(range(len(own))) and [r.o for r in own] == sorted(r.o for r in own)
        assert [r.before for r in own] == [sum(x.n for x in own[:k]) for k in range(len(own))]


def test_components(spark):
    edges = [(k, k + 1) for k in range(100, 140)] + [(7, 7), (1, 500), (500, 3), (None, 2)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{k: 100 for k in range(100, 141)}, 7: 7, 1: 1, 3: 1, 500: 1}


def test_stored_tables_go_when_nothing_reads_them(spark):
    before = set(os.listdir(shared_folder(spark).removeprefix("file:")))
    rows = stored(spark.range(100).withColumn("t", F.lit("x")))
    derived = rows.where("id < 50").select("id")
    made = {f for f in set(os.listdir(shared_folder(spark).removeprefix("file:"))) - before if f.startswith("stored-")}
    assert len(made) == 1
    del rows
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)
    swept(spark)
    assert derived.count() == 50  # still read by a plan that was made from it
    del derived
    for _ in range(20):
        spark.range(3).count()  # Spark's listeners hold the last query's plan
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)
        swept(spark)
        if not made & set(os.listdir(shared_folder(spark).removeprefix("file:"))):
            break
    assert not made & set(os.listdir(shared_folder(spark).removeprefix("file:")))


def test_bounded_joins_and_small_batches(spark):
    left, right = spark.range(50), cut(spark.range(10))
    assert left.join(bounded(right, 5), "id").count() == left.join(bounded(right, 10), "id").count() == 10
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    with arrow_rows(spark, 7):
        sizes = spark.range(100).coalesce(1).mapInArrow(lambda batches: (b.slice(0, 1) for b in batches), "id long").count()
    assert sizes == 15 and spark.conf.get(key) == was
