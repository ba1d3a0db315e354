"""Means of doubles that lie within rounding of a bound: their side is that of the rows summed in the order of the table."""

import random

import duckdb
from pyspark.sql import functions as F

from strataline.operators import relational as O
from strataline.queries import load

QUERIES, SQL = load()


def test_burial_of_means_on_a_bound(spark, tmp_path):
    rng, rows = random.Random(1), []
    for key in [None, *range(300)]:
        own = [rng.randrange(1, 50) for _ in range(6)]
        own += [50 + 10 * ((key or 0) % 2) - q for q in own]  # the mean is 25 or 30
        rows += [(key, float(q)) for q in own] + [(key, None)]
    rng.shuffle(rows)
    at = f"{tmp_path}/lineitem.parquet"
    for k in range(5):  # several files, whose partial sums would be added in any order
        spark.createDataFrame(rows[k::5], "l_partkey long, l_quantity double").coalesce(1).write.mode("append").parquet(at)
    db = duckdb.connect()
    db.sql("SET threads = 1")
    db.sql(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{at}/*.parquet')")
    want = db.sql(SQL["cls04_geo07_burial"]).fetchall()
    got = QUERIES["cls04_geo07_burial"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr) and len({b for _, b in want}) > 1


def test_burial_sums_in_the_order_named(spark):
    terms = [q / 5 - 8 for q in (2, 26, 44, 37, 21, 20)]  # the mean is -3; forwards just above, backwards not
    df = spark.createDataFrame([(1, k, t) for k, t in enumerate(terms)], "v long, k int, d double").repartition(3, "k")
    got = [tuple(O.burial(df.withColumn("k", F.col("k") * way), "v", "d", order=["k"]).first()) for way in (1, -1)]
    assert got == [(1, 0, -2.9999999999999996), (1, 1, -3.0)]
