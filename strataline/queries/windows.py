"""Order-sensitive queries: the numbers of a user's events are a sequence with gaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataline.operators import windows as W
from strataline.queries import query
from strataline.session import table

POS = "pos AS (SELECT DISTINCT user_id AS u, event_id * 7919 % 400 AS p FROM events)"
FLAG = "flags AS (SELECT u, p, row_number() OVER (PARTITION BY u ORDER BY p) AS i, (p * 7 + u) % 5 > 1 AS f FROM pos)"


def _pos(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("u"), (F.col("event_id") * 7919 % 400).alias("p")).distinct()


def _flags(spark, d):
    rows = W.renumbered(_pos(spark, d), ["u"], ["p"]).withColumnRenamed("number", "i")
    return rows.select("u", "p", "i", ((F.col("p") * 7 + F.col("u")) % 5 > 1).alias("f"))


@query(f"WITH {POS} SELECT u, p, CAST(p - lag(p) OVER (PARTITION BY u ORDER BY p) - 1 AS BIGINT) AS missing FROM pos QUALIFY missing > 0")
def win01_numbering_gaps(spark, d):
    return W.numbering_gaps(_pos(spark, d), ["u"], "p")


@query(f"""WITH {POS}, s AS (SELECT u, p, CASE WHEN p - lag(p) OVER (PARTITION BY u ORDER BY p) <= 2 THEN 0 ELSE 1 END AS nw FROM pos), r AS (SELECT u, p, sum(nw) OVER (PARTITION BY u ORDER BY p ROWS UNBOUNDED PRECEDING) AS run FROM s)
SELECT u, CAST(run AS BIGINT) AS run, min(p) AS first, max(p) AS last, count(*) AS n FROM r GROUP BY u, run HAVING count(*) > 3""")
def win02_tolerant_runs(spark, d):
    return W.tolerant_runs(_pos(spark, d), ["u"], "p", 2, 3)


@query(f"""WITH {POS}, n AS (SELECT u, p, row_number() OVER (PARTITION BY u ORDER BY p) AS i FROM pos), h AS (SELECT a.u, a.i FROM n a JOIN n b ON a.u = b.u AND b.i = a.i + 3 WHERE b.p - a.p BETWEEN 5 AND 7)
SELECT DISTINCT n.u, n.p FROM n JOIN h ON n.u = h.u AND n.i BETWEEN h.i AND h.i + 3""")
def win03_marked_windows(spark, d):
    return W.marked_windows(_pos(spark, d), ["u"], "p", 4, lambda k: (k(3)["p"] - k(0)["p"]).between(5, 7))


@query(f"""WITH {POS}, {FLAG}, r AS (SELECT *, sum(f::INT) OVER (PARTITION BY u ORDER BY i ROWS UNBOUNDED PRECEDING) AS fw, sum(f::INT) OVER (PARTITION BY u ORDER BY i DESC ROWS UNBOUNDED PRECEDING) AS bw FROM flags)
SELECT u, count(*) AS n, CAST(sum(f::INT) AS BIGINT) AS covered, sum(f::INT) / count(*) AS coverage, coalesce(min(i) FILTER (fw = 15) / count(*), 0.0) AS n_truncation, coalesce((count(*) - max(i) FILTER (bw = 15)) / count(*), 0.0) AS c_truncation FROM r GROUP BY u""")
def win04_agg21_running_coverage(spark, d):
    return W.running_coverage(_flags(spark, d), ["u"], "i", "f")


@query(f"""WITH {POS}, {FLAG}, b AS (SELECT *, sum(f::INT) OVER (PARTITION BY u ORDER BY i ROWS UNBOUNDED PRECEDING) AS blk, count(*) OVER (PARTITION BY u) AS n FROM flags)
SELECT u, min(i) AS first, max(i) AS last, max(i) - min(i) + 1 AS gap FROM b WHERE NOT f GROUP BY u, blk, n HAVING max(i) - min(i) + 1 > 0.03 * n""")
def win05_coverage_gaps(spark, d):
    return W.coverage_gaps(_flags(spark, d), ["u"], "i", "f", 0.03)


RUNS = f"""{POS}, {FLAG}, c AS (SELECT *, CASE WHEN f THEN p % 6 END AS tg FROM flags), b AS (SELECT *, sum((tg IS NULL)::INT) OVER (PARTITION BY u ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM c),
runs AS (SELECT u, run, min(i) AS first, max(i) AS last, count(DISTINCT tg) AS diversity, min(tg) AS low, max(tg) AS high, count(DISTINCT tg) > 2 AS kept FROM b WHERE tg IS NOT NULL GROUP BY u, run)"""


def _runs(spark, d):
    rows = _flags(spark, d).withColumn("tg", F.when(F.col("f"), F.col("p") % 6))
    return W.run_diversity(rows, ["u"], "i", "tg", 2)


@query(f"WITH {RUNS} SELECT u, CAST(run AS BIGINT) AS run, first, last, diversity, low, high, kept FROM runs")
def win06_run_diversity(spark, d):
    return _runs(spark, d)


@query(f"WITH {RUNS} SELECT DISTINCT u, unnest(range(low, high + 1)) AS target FROM runs WHERE kept")
def win06_filled_targets(spark, d):
    return W.filled_targets(_runs(spark, d), ["u"])


@query()
def win07_erased_flags(spark, d):
    return W.revised_flags(_flags(spark, d), ["u"], "i", "f", fill=False)


@query()
def win07_geo09_filled_flags(spark, d):
    return W.revised_flags(_flags(spark, d), ["u"], "i", "f", fill=True)


@query(f"WITH {POS}, {FLAG}, b AS (SELECT *, min(CASE WHEN f THEN i END) OVER (PARTITION BY u) AS lo, max(CASE WHEN f THEN i END) OVER (PARTITION BY u) AS hi FROM flags) SELECT u, p, i, f FROM b WHERE i BETWEEN lo AND hi")
def win08_trimmed_runs(spark, d):
    return W.trimmed_runs(_flags(spark, d), ["u"], "i", "f")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS number FROM events")
def win09_renumbered(spark, d):
    return W.renumbered(table(spark, d, "events").select("event_id", "user_id", "ts"), ["user_id"], ["ts", "event_id"]).select("event_id", "number")


@query("""WITH n AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS k, count(*) OVER () AS l FROM part), b AS (SELECT i, (i * l) // 7 AS a, ((i + 1) * l) // 7 AS z FROM (SELECT unnest(range(7)) AS i), (SELECT max(l) AS l FROM n))
SELECT p_partkey, CAST(i AS INT) AS part, CAST(k % 7 AS INT) AS turn FROM n JOIN b ON k >= a AND k < z""")
def win11_even_split(spark, d):
    return W.round_robin(W.even_split(table(spark, d, "part").select("p_partkey"), ["p_partkey"], 7), ["p_partkey"], 7)


@query("""WITH s AS (SELECT user_id, sqrt(pow(value - lag(value) OVER w, 2) + pow(event_id % 100 - lag(event_id % 100) OVER w, 2)) AS step FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, round(coalesce(sum(step), 0), 4) AS length FROM s GROUP BY user_id""")
def win13_path_length(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "value", (F.col("event_id") % 100).alias("y"))
    return W.path_length(e, ["user_id"], "event_id", "value", "y").withColumn("length", F.round("length", 4))
