"""Relational queries: joins, dedup, sets, aggregates, histograms, ladders and sorts on the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataline.operators import relational as O
from strataline.plans.ordering import numbered
from strataline.queries import query
from strataline.session import table
from strataline.sinks import writers as K


def t(spark, d, name):
    return table(spark, d, name)


@query("""WITH tok AS (SELECT p_partkey, unnest(string_split(p_type, ' ')) AS id, generate_subscripts(string_split(p_type, ' '), 1) AS pos FROM part), dict AS (SELECT split_part(p_type, ' ', 1) AS id, min(p_brand) AS descr FROM part GROUP BY 1)
SELECT p_partkey, string_agg(upper(CASE WHEN descr IS NULL THEN '(' || tok.id || ');' ELSE '(' || tok.id || ') ' || descr || ';' END), ' ' ORDER BY pos) AS out FROM tok LEFT JOIN dict ON tok.id = dict.id GROUP BY p_partkey""")
def jn02_prj07_described_list(spark, d):
    p = t(spark, d, "part")
    dictionary = p.groupBy(F.split_part("p_type", F.lit(" "), F.lit(1)).alias("id")).agg(F.min("p_brand").alias("descr"))
    rows = p.select("p_partkey", F.split("p_type", " ").alias("ids"))
    return O.described_list(rows, "p_partkey", "ids", dictionary, "id", "descr", "out").select("p_partkey", "out")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def jn03_flt03_in_sets(spark, d):
    rich = t(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    big = t(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return O.in_sets(t(spark, d, "orders"), {"o_custkey": rich, "o_orderkey": big, "o_orderstatus": None}).select("o_orderkey", "o_custkey")


@query("SELECT 'matched' AS kind, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0 UNION ALL SELECT 'missed', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def jn04_with_misses(spark, d):
    hit, miss = O.with_misses(t(spark, d, "orders"), t(spark, d, "customer").where("c_acctbal > 0").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")
    n = F.count(F.lit(1)).alias("n")
    return hit.agg(n).select(F.lit("matched").alias("kind"), "n").union(miss.agg(n).select(F.lit("missed"), "n"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def jn05_wanted_sequences(spark, d):
    return t(spark, d, "documents").join(t(spark, d, "labels").where("quality = 1"), "doc_id", "left_semi").select("doc_id", "lang")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def set07_missing_ids(spark, d):
    return t(spark, d, "customer").join(t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("SELECT user_id, event_id AS first, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS second FROM events QUALIFY second IS NOT NULL")
def jn06_adjacent_pairs(spark, d):
    return O.adjacent_pairs(t(spark, d, "events"), "event_id", ["ts", "event_id"], ["user_id"])


@query("SELECT DISTINCT o_custkey AS key FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_nationkey < 10")
def jn07_set04_key_intersection(spark, d):
    return t(spark, d, "orders").select(F.col("o_custkey").alias("key")).intersect(t(spark, d, "customer").where("c_nationkey < 10").select("c_custkey"))


@query("SELECT c_custkey, coalesce(n, 0) AS n, coalesce(top, 0.0) AS top FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def jn08_jn10_default_join(spark, d):
    agg = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top"))
    return O.joined_with_default(t(spark, d, "customer").select("c_custkey"), agg, "c_custkey", {"n": 0, "top": 0.0})


@query("""WITH a AS (SELECT c_nationkey AS k, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS place FROM customer), b AS (SELECT s_nationkey AS k, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey DESC) AS place FROM supplier)
SELECT k, CAST(place AS INT) AS place, c_custkey, s_suppkey FROM a JOIN b USING (k, place)""")
def jn09_positional_join(spark, d):
    a, b = t(spark, d, "customer").select(F.col("c_nationkey").alias("k"), "c_custkey"), t(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), "s_suppkey", (-F.col("s_suppkey")).alias("_o"))
    return O.positional_join(a, b, ["k"], ["c_custkey"], ["_o"]).drop("_o")


@query("SELECT n_name, r_name FROM nation, region")
def jn12_all_pairs(spark, d):
    return t(spark, d, "nation").select("n_name").crossJoin(t(spark, d, "region").select("r_name"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'x' END AS a, p_name AS b FROM part")
def prj03_coalesced(spark, d):
    p = t(spark, d, "part")
    left = p.select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("a"), F.lit("old").alias("b"))
    return O.coalesced(left, p.select("p_partkey", F.lit("x").alias("a"), F.col("p_name").alias("b")), "p_partkey", ["a", "b"], ["b"])


@query("SELECT p_partkey AS id, p_name AS protein, p_size AS rank FROM part")
def prj04_renamed(spark, d):
    return t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("protein"), F.col("p_size").alias("rank"))


@query("SELECT l_orderkey, l_linenumber, greatest(l_discount, l_tax) AS best FROM lineitem")
def prj08_best_score(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.greatest("l_discount", "l_tax").alias("best"))


@query("SELECT count(*) AS n FROM lineitem WHERE l_discount >= 0.05 AND l_quantity >= 20")
def flt01_thresholds(spark, d):
    return t(spark, d, "lineitem").where("l_discount >= 0.05 and l_quantity >= 20").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 7 = 0 THEN 'bad_pattern' WHEN p_partkey % 5 = 0 THEN 'bad_rank' WHEN p_size > 3 THEN 'not_requested' ELSE 'ok' END AS reason FROM part) GROUP BY reason""")
def flt11_skip_reasons(spark, d):
    p = t(spark, d, "part")
    name = F.when(F.col("p_partkey") % 7 == 0, "plain").otherwise("1--x")
    rank = F.when(F.col("p_partkey") % 5 != 0, F.col("p_size"))
    return p.select(O.skip_reason(name, rank, [1, 2, 3]).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey BETWEEN 1 AND 30")
def flt12_job_subset(spark, d):
    jobs = spark.range(1, 31).withColumnRenamed("id", "o_custkey")
    return t(spark, d, "orders").join(jobs, "o_custkey", "left_semi").select("o_orderkey")


@query("SELECT count(*) FILTER (l_quantity > 10 AND l_quantity < 20) AS open, count(*) FILTER (l_quantity >= 10 AND l_quantity < 20) AS half FROM lineitem")
def flt14_area_windows(spark, d):
    q = F.col("l_quantity")
    return t(spark, d, "lineitem").agg(F.count_if((q > 10) & (q < 20)).alias("open"), F.count_if((q >= 10) & (q < 20)).alias("half"))


LADDER = """CASE WHEN l_tax >= 0.07 THEN CASE WHEN cov >= 0.5 THEN 'r2 NTC' ELSE 'r3 LC' END WHEN l_discount >= 0.09 THEN CASE WHEN cov >= 0.5 THEN 'r2 CTC' ELSE 'r3 LC' END
WHEN l_linenumber > 3 THEN CASE WHEN gap > 0.5 THEN 'r3 LC' WHEN gap > 0.15 THEN 'r2 ICG' WHEN cov > 0.7 THEN 'r1 OK' ELSE 'r2 ICG' END WHEN cov < 0.7 THEN CASE WHEN cov >= 0.5 THEN 'r2 LC' ELSE 'r3 LC' END ELSE 'r1 OK' END"""


@query(f"SELECT c AS class, count(*) AS n FROM (SELECT {LADDER} AS c FROM (SELECT *, l_quantity / 50 AS cov, l_suppkey % 10 / 10 AS gap FROM lineitem)) GROUP BY c")
def cls01_hit_ladder(spark, d):
    li = t(spark, d, "lineitem")
    c = O.hit_class(F.when(F.col("l_tax") >= 0.07, 1.0).otherwise(0.0), F.when(F.col("l_discount") >= 0.09, 1.0).otherwise(0.0), F.col("l_linenumber") > 3, F.col("l_suppkey") % 10 / 10, F.col("l_quantity") / 50)
    return li.select(c.alias("c")).select(F.concat_ws(" ", "c.class", "c.flag").alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT l_partkey AS v, l_quantity / 5 - 8 AS d FROM lineitem), a AS (SELECT v, avg(d) AS mean, min(abs(d)) AS lo, max(d) - min(d) AS spread, avg(CASE WHEN d < -3 THEN 1 ELSE 0 END) AS below FROM s GROUP BY v)
SELECT v, CASE WHEN mean <= -3 THEN CASE WHEN below > 0.6 THEN -1 WHEN spread > 5 THEN 1 ELSE -1 END WHEN mean <= -2 THEN CASE WHEN mean < 0 OR lo <= -2 THEN 0 ELSE 1 END WHEN lo <= -2 THEN 0 ELSE 1 END AS burial FROM a""")
def cls04_geo07_burial(spark, d):
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]  # the order in which one thread reads the rows
    s = t(spark, d, "lineitem").select(F.col("l_partkey").alias("v"), (F.col("l_quantity") / 5 - 8).alias("d"), *at)
    return O.burial(s, "v", "d", order=["file", "row"]).select("v", "burial")


# ---- dedup and sets --------------------------------------------------------------------------------------------------------------


SOURCES = "u AS (SELECT c_nationkey AS k, 'swiss' AS src, c_custkey AS id FROM customer UNION ALL SELECT s_nationkey, 'trembl', s_suppkey FROM supplier)"


def _sources(spark, d):
    a = t(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.lit("swiss").alias("src"), F.col("c_custkey").alias("id"))
    return K.union_rows(a, t(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("trembl").alias("src"), F.col("s_suppkey").alias("id")))


@query(f"WITH {SOURCES} SELECT src, count(*) AS n FROM u GROUP BY src")
def set01_union_sources(spark, d):
    return O.deduplicated(_sources(spark, d), "k", "src", "none", "swiss", "trembl", ["id"]).groupBy("src").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SOURCES} SELECT k, src, id FROM u QUALIFY row_number() OVER (PARTITION BY k ORDER BY CASE WHEN src = 'trembl' THEN 0 ELSE 1 END, id) = 1")
def set02_prefer_second(spark, d):
    return O.deduplicated(_sources(spark, d), "k", "src", "prefer_second", "swiss", "trembl", ["id"])


TOKENS = "tok AS (SELECT DISTINCT c_nationkey % 3 AS grp, o_orderpriority AS domain, o_custkey AS token FROM orders JOIN customer ON o_custkey = c_custkey)"


def _tokens(spark, d):
    j = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return j.select((F.col("c_nationkey") % 3).alias("grp"), F.col("o_orderpriority").alias("domain"), F.col("o_custkey").alias("token"))


@query(f"""WITH {TOKENS}, c AS (SELECT grp, token, string_agg(domain, ' & ' ORDER BY domain) AS combination FROM tok GROUP BY grp, token), s AS (SELECT grp, combination, count(*) AS size FROM c GROUP BY 1, 2 HAVING count(*) >= 5)
SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY grp ORDER BY size DESC, combination) <= 8""")
def agg10_top02_exclusive_intersections(spark, d):
    return O.intersections(_tokens(spark, d), "grp", "domain", "token", 5, 8)


@query(f"""WITH {TOKENS}, doms AS (SELECT DISTINCT grp, domain FROM tok UNION SELECT DISTINCT grp, 'EMPTY' FROM tok WHERE grp = 2), n AS (SELECT grp, count(*) AS n FROM doms GROUP BY grp),
sh AS (SELECT grp, count(*) AS shared FROM (SELECT grp, token, count(*) AS k FROM tok GROUP BY 1, 2) JOIN n USING (grp) WHERE k = n GROUP BY grp), sz AS (SELECT grp, domain, count(*) AS size FROM tok GROUP BY 1, 2)
SELECT grp, domain, coalesce(size, 0) AS size, coalesce(shared, 0) AS shared, coalesce(size, 0) - coalesce(shared, 0) AS only FROM doms LEFT JOIN sz USING (grp, domain) LEFT JOIN sh USING (grp)""")
def agg11_set03_set_sizes(spark, d):
    tok = _tokens(spark, d)
    doms = tok.select("grp", "domain").union(tok.where("grp = 2").select("grp", F.lit("EMPTY")))
    return O.set_sizes(tok, doms, "grp", "domain", "token")


@query("""SELECT o_custkey AS token, CAST(max(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS INT) AS "1-URGENT", CAST(max(CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS INT) AS "2-HIGH" FROM orders GROUP BY 1""")
def agg12_snk08_membership_matrix(spark, d):
    return O.membership_matrix(t(spark, d, "orders").select(F.col("o_custkey").alias("token"), F.col("o_orderpriority").alias("domain")), "token", "domain", ["1-URGENT", "2-HIGH"])


@query("SELECT p_partkey FROM part WHERE p_size > 20 EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 48")
def set03_except(spark, d):
    return t(spark, d, "part").where("p_size > 20").select("p_partkey").exceptAll(t(spark, d, "lineitem").where("l_quantity > 48").select("l_partkey").distinct())


# ---- aggregates ------------------------------------------------------------------------------------------------------------------


@query("SELECT o_custkey, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS o_orderkey, min(o_totalprice) AS best FROM orders GROUP BY o_custkey")
def agg07_best_with_payload(spark, d):
    best = F.min_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_totalprice", "o_orderkey")).alias("b")
    return t(spark, d, "orders").groupBy("o_custkey").agg(best).select("o_custkey", "b.o_orderkey", F.col("b.o_totalprice").alias("best"))


@query("WITH c AS (SELECT unnest(['en', 'de', 'fr', 'es', 'la']) AS class) SELECT class, count(doc_id) AS n FROM c LEFT JOIN documents ON lang = class GROUP BY class")
def agg09_class_counts(spark, d):
    classes = spark.createDataFrame([(c,) for c in ("en", "de", "fr", "es", "la")], "class string")
    n = t(spark, d, "documents").groupBy(F.col("lang").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return O.joined_with_default(classes, n, "class", {"n": 0})


@query("SELECT population, lang, count(*) AS n FROM (SELECT 'all' AS population, lang FROM documents UNION ALL SELECT CASE WHEN n_chars > 1000 THEN 'hit' ELSE 'rest' END, lang FROM documents) GROUP BY 1, 2")
def agg08_three_populations(spark, d):
    docs = t(spark, d, "documents").select("lang", (F.col("n_chars") > 1000).alias("hit"))
    rows = docs.select("lang", F.explode(F.array(F.lit("all"), F.when(F.col("hit"), "hit").otherwise("rest"))).alias("population"))
    return rows.groupBy("population", "lang").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CAST(CASE WHEN v = 1.00 THEN 10 ELSE floor((v - 0.45) / 0.05 + 0.000001) END AS INT) AS bin, count(*) AS n FROM (SELECT CAST(round(0.4 + l_quantity / 80, 2) AS DOUBLE) AS v FROM lineitem) WHERE v BETWEEN 0.45 AND 1.0 GROUP BY 1""")
def agg13_score_bins(spark, d):
    return O.score_bins(t(spark, d, "lineitem").select(F.round(0.4 + F.col("l_quantity") / 80, 2).alias("v")), "v")


@query("WITH m AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) SELECT CAST(least(floor((l_extendedprice - lo) * 20 / (hi - lo)), 19) AS INT) AS bin, count(*) AS n FROM lineitem, m GROUP BY 1")
def agg14_equal_width_bins(spark, d):
    return O.equal_width_bins(t(spark, d, "lineitem"), "l_extendedprice", 20)


GRID = """grid AS (SELECT CAST(least(floor(x * 18 / 1.0), 17) AS INT) AS ix, CAST(least(floor(y * 18 / 1.0), 17) AS INT) AS iy, count(*) AS n FROM (SELECT l_quantity / 50 AS x, l_extendedprice / 100000 AS y FROM lineitem) WHERE x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1 GROUP BY 1, 2)"""


def _points(spark, d):
    return t(spark, d, "lineitem").select((F.col("l_quantity") / 50).alias("x"), (F.col("l_extendedprice") / 100000).alias("y"))


@query(f"WITH {GRID} SELECT ix, iy, n, n / max(n) OVER () AS density FROM grid")
def agg15_density_grid(spark, d):
    return O.density_grid(_points(spark, d), "x", "y", 0.0, 1.0, 18)


@query(f"""WITH {GRID}, o AS (SELECT dx, dy, exp(-(dx * dx + dy * dy) / 4.5) AS w FROM (SELECT unnest(range(-5, 6)) AS dx), (SELECT unnest(range(-5, 6)) AS dy)), k AS (SELECT dx, dy, w / sum(w) OVER () AS w FROM o)
SELECT CAST(ix + dx AS INT) AS ix, CAST(iy + dy AS INT) AS iy, round(sum(n * w), 5) AS n FROM grid, k WHERE ix + dx BETWEEN 0 AND 17 AND iy + dy BETWEEN 0 AND 17 GROUP BY 1, 2""")
def agg15_blurred_grid(spark, d):
    return O.blurred(O.density_grid(_points(spark, d), "x", "y", 0.0, 1.0, 18), 18).withColumn("n", F.round("n", 5))


@query("""WITH p AS (SELECT CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), s AS (SELECT count(*) AS n, var_samp(x) * count(*) ^ (-1.0 / 3) AS sx, var_samp(y) * count(*) ^ (-1.0 / 3) AS sy, covar_samp(x, y) * count(*) ^ (-1.0 / 3) AS sxy FROM p),
c AS (SELECT a AS ix, b AS iy, -0.5 + (a + 0.5) * 0.1 AS cx, -0.5 + (b + 0.5) * 0.1 AS cy FROM (SELECT CAST(unnest(range(10)) AS INT) AS a), (SELECT CAST(unnest(range(10)) AS INT) AS b))
SELECT ix, iy, round(sum(exp(-(sy * (cx - x) * (cx - x) - 2 * sxy * (cx - x) * (cy - y) + sx * (cy - y) * (cy - y)) / (sx * sy - sxy * sxy) / 2)) / (2 * pi() * sqrt(any_value(sx * sy - sxy * sxy)) * any_value(n)), 6) AS density FROM p, s, c GROUP BY ix, iy""")
def agg16_kernel_density(spark, d):
    e = t(spark, d, "embeddings").select(F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return O.kernel_density(e, "x", "y", -0.5, 0.5, 10).withColumn("density", F.round("density", 6))


@query("SELECT label, avg(CASE WHEN embedding[1] > 0 THEN 1.0 ELSE 0.0 END) AS share, count(*) AS n FROM embeddings GROUP BY label")
def agg21_agg23_share(spark, d):
    return t(spark, d, "embeddings").groupBy("label").agg(F.avg(F.when(F.col("embedding")[0] > 0, 1.0).otherwise(0.0)).alias("share"), F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag, median(l_extendedprice) AS med FROM lineitem GROUP BY 1")
def agg26_medians(spark, d):
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.percentile("l_extendedprice", 0.5).alias("med"))


@query("""WITH p AS (SELECT a.doc_id, upper(regexp_replace(a.text, '[^A-Za-z]', '', 'g')) AS x, upper(regexp_replace(b.text, '[^A-Za-z]', '', 'g')) AS y FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1), q AS (SELECT doc_id, x[1:least(length(x), length(y))] AS x, y[1:least(length(x), length(y))] AS y FROM p),
c AS (SELECT doc_id, unnest(string_split(x, '')) AS a, unnest(string_split(y, '')) AS b FROM q WHERE length(x) > 0), s AS (SELECT unnest(['STA','NEQK','NHQK','NDEQ','QHRK','MILV','MILF','FYW']) AS g), w AS (SELECT unnest(['CSA','ATV','SAG','STNK','STPA','SGND','SNDEQK','NDEQHK','NEQHRK','FVLIM','HFY']) AS g),
m AS (SELECT DISTINCT a, b, CASE WHEN a = b AND a <> 'X' THEN '*' WHEN EXISTS (SELECT 1 FROM s WHERE contains(g, a) AND contains(g, b)) THEN ':' WHEN EXISTS (SELECT 1 FROM w WHERE contains(g, a) AND contains(g, b)) THEN '.' ELSE ' ' END AS z FROM (SELECT DISTINCT a, b FROM c))
SELECT doc_id, count(*) FILTER (z = '*') AS identical, count(*) FILTER (z = ':') AS strong, count(*) FILTER (z = '.') AS weak, count(*) FILTER (c.a <> 'X' AND c.b <> 'X') AS compared FROM c JOIN m ON c.a = m.a AND c.b = m.b GROUP BY doc_id""")
def agg20_identity_metrics(spark, d):
    docs = t(spark, d, "documents")
    bare = docs.select("doc_id", F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("x"))
    pair = bare.join(bare.select((F.col("doc_id") - 1).alias("doc_id"), F.col("x").alias("y")), "doc_id").withColumn("n", F.least(F.length("x"), F.length("y"))).where("n > 0")
    pair = pair.select("doc_id", F.substring("x", F.lit(1), F.col("n")).alias("aligned1"), F.substring("y", F.lit(1), F.col("n")).alias("aligned2"))
    return O.identity_metrics(pair).select("doc_id", "identical", "strong", "weak", "compared")


# ---- sorts -----------------------------------------------------------------------------------------------------------------------


@query("""SELECT p_partkey, row_number() OVER (ORDER BY coalesce(CASE WHEN p_size % 5 > 0 THEN p_size END, 1000000000), coalesce(CASE WHEN p_partkey % 4 > 0 THEN p_retailprice END, CAST('-inf' AS DOUBLE)) DESC, p_partkey) AS place FROM part""")
def srt01_snk01_rank_order(spark, d):
    p = t(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 5 > 0, F.col("p_size")).alias("rank"), F.when(F.col("p_partkey") % 4 > 0, F.col("p_retailprice")).alias("tm"), F.lit(1.0).alias("coverage"))
    return numbered(p, [*O.rank_order(), F.col("p_partkey")]).select("p_partkey", (F.col("place0") + 1).alias("place"))


@query("SELECT l_partkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_discount, l_orderkey, l_linenumber, l_suppkey) AS place FROM lineitem QUALIFY place <= 3")
def srt02_top05_neighbour_order(spark, d):
    w = Window.partitionBy("l_partkey").orderBy(F.desc("l_extendedprice"), "l_discount", "l_orderkey", "l_linenumber", "l_suppkey")
    return t(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", F.row_number().over(w).alias("place")).where("place <= 3")


@query("SELECT lang, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, lang) AS place FROM documents GROUP BY lang")
def srt03_count_order(spark, d):
    n = t(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return numbered(n, [F.desc("n"), F.col("lang")]).select("lang", "n", (F.col("place0") + 1).alias("place"))


@query()
def prj11_sequence_columns(spark, d):
    docs = t(spark, d, "documents").select(F.repeat(F.lit("ACDEFGHIKL"), 7).alias("looks"), "lang", F.col("text").alias("seq"))
    return spark.createDataFrame([(c,) for c in O.sequence_columns(docs)], "column string")
