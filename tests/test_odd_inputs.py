"""Queries on tables with odd rows, held against their SQL, and groups that give no row."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from compare_oracle import plain
from strataline.functions import text as T
from strataline.operators import kernels as K
from strataline.queries import load
from strataline.sources import records as R

QUERIES, SQL = load()


def agrees(spark, folder, name, table, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    got, want = QUERIES[name](spark, str(folder)), db.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted((tuple(map(plain, r)) for r in got.select(*want.columns).collect()), key=repr) == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("named", ["surfaces", "triangulated"])
def test_groups_without_facets_or_edges(spark, named):
    rng = np.random.default_rng(1)
    rows = [("solid", k, *map(float, rng.random(3))) for k in range(8)] + [("two", k, float(k), 0.0, 0.0) for k in range(2)] + [("flat", k, 0.0, 0.0, 0.0) for k in range(8)]
    df = spark.createDataFrame(rows, "ligand string, id long, x double, y double, z double")
    assert {r.ligand for r in getattr(K, named)(df, "ligand").collect()} == {"solid"}
    assert getattr(K, named)(df.where("ligand <> 'solid'"), "ligand").collect() == []


def test_burial_counts_missing_distances(spark, tmp_path):
    rows = [(1, 1.0)] * 6 + [(1, None)] * 5 + [(2, 1.0), (2, 2.0), (2, 50.0)] + [(3, None), (3, None)] + [(None, 1.0), (None, 40.0), (None, None)] + [(4, 1.0), (4, 1.0), (4, 38.0), (4, None)]
    agrees(spark, tmp_path, "cls04_geo07_burial", "lineitem", rows, "l_partkey long, l_quantity double")


def test_search_hits_of_missing_values(spark, tmp_path):
    whole = (1, 2, 17.0, 0.05, 900.5, "N")
    rows = [whole] + [tuple(None if j == k else x for j, x in enumerate(whole)) for k in range(6)] + [(None, 3, None, None, None, None), (2, 6, None, 0.1, 1.0, "R"), (3, 7, None, 0.1, 1.0, "R"), (4, 1, 5.0, None, 1.0, "R")]
    rows += [(5, 1, float("nan"), float("inf"), -1e300, "A"), (9_000_000_000_000_000_000, 1, 1e7, 1e-5, 0.0, "A")]
    agrees(spark, tmp_path, "src10_search_hits", "lineitem", rows, "l_orderkey long, l_linenumber int, l_quantity double, l_discount double, l_extendedprice double, l_returnflag string")


def test_search_hits_without_a_token_for_missing_values(spark):
    lines = ["q\t90\t7\t\t5\tt", "q\t\t7\t1\t5\tt", "q\t90\t\t1\t5\tt", "q\t90\t7\tNA\tx\tt", "\\N\t90\t7\t1\t\\N\tt", "\\N\t90\t7\t1\t5\tt"]
    got = R.search_hits(spark.createDataFrame([("f", k, v) for k, v in enumerate(lines)], "file string, line_no long, value string")).collect()
    assert sorted((r.line_no, r.qseqid, r.evalue) for r in got) == [(0, "q", float("inf")), (5, "\\N", 1.0)]


def test_casts_of_missing_values(spark, tmp_path):
    rows = [(1, 2.5), (None, 3.5), (2, None), (None, None), (-3, -2.5), (9_000_000_000_000_000_000, 1e15), (4, -0.0), (5, 1e-9)]
    agrees(spark, tmp_path, "scalar_casts", "orders", rows, "o_orderkey long, o_totalprice double")


def test_whole_numbers_of_floats_without_one(spark):
    df = spark.createDataFrame([("NaN",), ("inf",), ("1e30",), (" 7.9 ",), ("-7.9",), ("x",), (None,)], "x string")
    assert [r[0] for r in df.select(T.whole_of_float(F.col("x"), 9)).collect()] == [9, 9, 9, 7, -7, 9, 9]
