"""File queries: tables written by a sink and read again by a scan, in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strataline.functions import geometry as G
from strataline.operators import relational as O
from strataline.operators import spatial as S
from strataline.queries import query
from strataline.queries.geometry import facets
from strataline.session import shared_folder, table
from strataline.sinks import writers as W
from strataline.sources import records as R


def _folder(spark):
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, CASE WHEN c_custkey % 4 = 0 THEN 'NA' WHEN c_custkey % 4 = 1 THEN '' ELSE c_mktsegment END AS segment FROM customer")
def src03_src05_src07_header_table(spark, d):
    c = table(spark, d, "customer")
    segment = F.when(F.col("c_custkey") % 4 == 0, "NA").when(F.col("c_custkey") % 4 == 1, "").otherwise(F.col("c_mktsegment"))
    W.write_table(c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), segment.alias("segment")), to := _folder(spark), gzip=True)
    return R.header_table(spark, to, ["id", "segment"])


@query("SELECT ceil(count(*) / 500) AS files, count(*) AS n FROM customer")
def snk02_rolled_over_files(spark, d):
    W.write_table(table(spark, d, "customer").select("c_custkey", "c_name"), to := _folder(spark), single=True, rows_a_file=500)
    rows = spark.read.option("header", True).option("sep", "\t").csv(to).select(F.col("_metadata.file_path").alias("f"))
    return rows.agg(F.countDistinct("f").cast("double").alias("files"), F.count(F.lit(1)).alias("n"))


@query("SELECT lang AS class, count(*) AS n, sum(length(text) - length(replace(text, chr(10), ''))) AS breaks FROM documents GROUP BY lang UNION ALL SELECT 'la', 0, 1")
def snk10_fasta_by_class(spark, d):
    docs = table(spark, d, "documents")
    W.write_fasta_by_class(docs, to := _folder(spark), F.col("doc_id").cast("string"), F.col("text"), F.col("lang"), ["en", "la"])
    rows = spark.read.text(to).groupBy("class").agg(F.count_if(F.col("value").startswith(">")).alias("n"), F.count_if(~F.col("value").startswith(">")).alias("m"))
    return rows.select("class", "n", (F.col("m") - F.col("n")).alias("breaks"))


@query("SELECT l_returnflag AS a, round(sum(l_quantity), 3) AS q FROM lineitem GROUP BY 1")
def snk07_snk09_sorted_csv(spark, d):
    li = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("a")).agg(F.round(F.sum("l_quantity"), 3).alias("q"))
    W.write_table(li, to := _folder(spark), [F.desc("q"), F.col("a")], sep=",", single=True)
    return spark.read.csv(to, header=True, schema="a string, q double")


@query("""WITH e AS (SELECT o_custkey % 50 AS component, o_orderkey % 100000 AS a, o_custkey AS b FROM orders), s AS (SELECT *, count(*) OVER (PARTITION BY component) AS n FROM e)
SELECT row_number() OVER (ORDER BY n DESC, component, a, b) AS place, printf('CONECT%5d%5d', a, b) AS line FROM s""")
def snk13_conect_lines(spark, d):
    e = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("component"), (F.col("o_orderkey") % 100000).alias("a"), F.col("o_custkey").alias("b"))
    return W.conect_lines(e)


@query("SELECT p_partkey AS rank, CAST(NULL AS VARCHAR) AS tm, p_name AS extra FROM part UNION ALL SELECT s_suppkey, NULL, NULL FROM supplier")
def snk01_dynamic_columns(spark, d):
    both = W.union_rows(table(spark, d, "part").select(F.col("p_name").alias("extra"), F.col("p_partkey").alias("rank")), table(spark, d, "supplier").select(F.col("s_suppkey").alias("rank")))
    return W.dynamic_columns(both, ("rank", "tm"))


@query("SELECT 'id30_bs30.5' AS suffix, 'min_identity' AS name, '30.0' AS value")
def snk05_snk18_run_log(spark, d):
    return W.parameter_log(spark, min_identity=30.0).select(F.lit(W.run_suffix(id=30.0, bs=30.5)).alias("suffix"), "name", "value")


@query()
def geo06_divided_facets(spark, d):
    return S.divided_facets(facets(spark, d).select("chain", "a", "b", "c", "pa", "pb", "pc"), 50.0).select("chain", "a", "b", "c", "part", F.round("area", 6).alias("area"))


ALIGNED = """p AS (SELECT p_partkey AS k, 'A' || repeat('-', CAST(p_size % 3 AS INT)) || 'STNKX' AS a, 'AS' || repeat('T', CAST(p_size % 3 AS INT)) || 'TN-X' AS b FROM part),
c AS (SELECT k, a, b, unnest(range(1, length(a) + 1)) AS i FROM p), s AS (SELECT k, i, a[i] AS x, b[i] AS y FROM c),
z AS (SELECT *, CASE WHEN x = '-' OR y = '-' THEN ' ' WHEN x = y AND x <> 'X' THEN '*' WHEN (x || y) IN ('ST', 'TS', 'SA', 'AS', 'TA', 'AT', 'NK', 'KN') THEN ':' WHEN (x || y) IN ('TN', 'NT', 'SN', 'NS', 'TK', 'KT') THEN '.' ELSE ' ' END AS m FROM s)"""


def _aligned(spark, d):
    n = (F.col("p_size") % 3).cast("int")
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.concat(F.lit("A"), F.repeat(F.lit("-"), n), F.lit("STNKX")).alias("aligned1"), F.concat(F.lit("AS"), F.repeat(F.lit("T"), n), F.lit("TN-X")).alias("aligned2"))


@query(f"""WITH {ALIGNED}, v AS (SELECT k, count(*) FILTER (m = '*') AS f, count(*) FILTER (m = ':') AS g, count(*) FILTER (m = '.') AS w, count(*) FILTER (x NOT IN ('-', 'X') AND y NOT IN ('-', 'X')) AS e, count(*) FILTER (x <> '-') AS l1, count(*) FILTER (y <> '-') AS l2 FROM z GROUP BY k),
r AS (SELECT *, least(l1, l2) AS n FROM v) SELECT k AS "Traceback Depth", 'a' || k AS "Sequence 1", 'b' || k AS "Sequence 2", f AS "Full Matches (*)", g AS "Strong Similar (:)", w AS "Weak Similar (.)",
round(round(100.0 * f / e, 1) + round(100.0 * g / e, 1) + round(100.0 * w / e, 1), 1) AS "Total Identity (Effective)", round(100.0 * f / e, 1) AS "Raw Identity (Effective) (%)", round(100.0 * g / e, 1) AS "Strong Identity (Effective) (%)", round(100.0 * w / e, 1) AS "Weak Identity (Effective) (%)",
round(round(100.0 * f / n, 1) + round(100.0 * g / n, 1) + round(100.0 * w / n, 1), 1) AS "Total Identity (Seq1 Norm)", round(100.0 * f / n, 1) AS "Raw Identity (Seq1 Norm) (%)", round(100.0 * g / n, 1) AS "Strong Identity (Seq1 Norm) (%)", round(100.0 * w / n, 1) AS "Weak Identity (Seq1 Norm) (%)",
e AS "Alignment Length (Effective)", l1 AS "Seq1 Sequence Length", l2 AS "Seq2 Sequence Length" FROM r""")
def snk11_identity_table(spark, d):
    m = O.identity_metrics(_aligned(spark, d)).withColumns({"one": F.concat(F.lit("a"), "k"), "two": F.concat(F.lit("b"), "k")})
    return W.identity_table(m, "k", "one", "two")


@query(f"""WITH {ALIGNED}, n AS (SELECT k, i, x, y, m, sum(CASE WHEN x = '-' THEN 0 ELSE 1 END) OVER w AS n1, sum(CASE WHEN y = '-' THEN 0 ELSE 1 END) OVER w AS n2 FROM z WINDOW w AS (PARTITION BY k ORDER BY i))
SELECT k, CAST(i - 1 AS INT) AS place, CASE WHEN x = '-' THEN '' ELSE CAST(n1 AS VARCHAR) END || chr(9) || x || chr(9) || CASE WHEN y = '-' THEN '' ELSE CAST(n2 AS VARCHAR) END || chr(9) || y || chr(9) || m AS line FROM n""")
def snk11_match_rows(spark, d):
    return W.match_rows(_aligned(spark, d), ["k"])


@query("""WITH s AS (SELECT 'german' AS sheet, source AS value, count(*) AS n FROM documents WHERE lang = 'de' GROUP BY source UNION ALL SELECT 'all', source, count(*) FROM documents GROUP BY source UNION ALL SELECT 'summary', 'source', NULL) SELECT * FROM s""")
def snk03_count_sheets(spark, d):
    docs = table(spark, d, "documents").select("lang", "source")
    folder = _folder(spark)
    W.write_sheets(W.count_sheets({"german": docs.where("lang = 'de'"), "all": docs}, "source", {"column": "source"}), folder)
    read = lambda name: spark.read.option("header", True).option("sep", "\t").csv(f"{folder}/{name}")
    rows = [read(name).select(F.lit(name).alias("sheet"), F.col("source").alias("value"), F.col("count").cast("long").alias("n")) for name in ("german", "all")]
    return rows[0].union(rows[1]).union(read("summary").select(F.lit("summary"), "value", F.lit(None).cast("long")))


@query("SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp FROM events")
def scalar_time_stamp(spark, d):
    return table(spark, d, "events").select("event_id", W.time_stamp(F.col("ts")).alias("stamp"))


@query("SELECT p_partkey, round(p_retailprice * (p_size * 10) / 25.4, 6) AS from_mm, round(p_retailprice * (p_size * 10), 6) AS from_inch FROM part")
def scalar_unit_conversion(spark, d):
    at = lambda unit: F.round(G.to_pixels(F.col("p_retailprice"), unit, F.col("p_size") * 10), 6)
    return table(spark, d, "part").select("p_partkey", at("mm").alias("from_mm"), at("inch").alias("from_inch"))
