"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from strataline.llm.backoff_lm import BACKOFF, MIN_PAIR
from strataline.llm.bm25 import K1, TOP, B
from strataline.llm.host_rules import HOST_LIMIT, HOST_MARGIN

OP6 = rf"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1
), spread AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id
), m AS (
  SELECT w.doc_id, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(lines.n, 0) AS n_dup_lines, coalesce(spread.n, 0) AS n_repeat_words
  FROM w LEFT JOIN spread USING (doc_id) LEFT JOIN lines USING (doc_id)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
), hosts AS (
  SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS f FROM b GROUP BY source
), moments AS (
  SELECT avg(f / n) AS mean, var_samp(f / n) AS v FROM hosts
), prior AS (
  SELECT mean, CASE WHEN v > 0 THEN greatest(1.0, least(1000.0, mean * (1 - mean) / v - 1)) ELSE 1000.0 END AS strength FROM moments
), rates AS (
  SELECT source, (f + mean * strength) / (n + strength) AS r, n + strength AS rows FROM hosts, prior
), verdicts AS (
  SELECT source, r - {HOST_MARGIN} * sqrt(r * (1 - r) / (rows + 1)) > {HOST_LIMIT} AS rejected FROM rates
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept
FROM b JOIN verdicts ON b.source IS NOT DISTINCT FROM verdicts.source
"""


OP2 = rf"""
WITH w AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS w FROM documents
), tf AS (
  SELECT doc_id, w, count(*) AS tf FROM w GROUP BY ALL
), dl AS (
  SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY doc_id
), g AS (
  SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(dl) FROM dl) / (SELECT count(*) FROM documents) AS average
), df AS (
  SELECT w, count(*) AS df FROM tf GROUP BY w
), s AS (
  SELECT q.doc_id AS query_id, tf.doc_id, round(sum(q.tf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf.tf * {K1 + 1} / (tf.tf + {K1} * (1 - {B} + {B} * dl / average))), 9) AS score
  FROM tf AS q JOIN df USING (w) JOIN tf ON tf.w = q.w JOIN dl ON dl.doc_id = tf.doc_id, g WHERE q.doc_id % 20 = 0 GROUP BY 1, 2
)
SELECT query_id, doc_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS place FROM s QUALIFY place <= {TOP}
"""

OP3 = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS words FROM conversations
), p AS (
  SELECT DISTINCT conv_id AS c, speaker AS perspective FROM t WHERE speaker <> 'system'
), r AS (
  SELECT conv_id, perspective, turn, speaker, words,
         CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS chat_role
  FROM t JOIN p ON conv_id IS NOT DISTINCT FROM c
), h AS (
  SELECT *, CASE WHEN chat_role = 'user' THEN speaker END AS name,
         '<|im_start|>' || chat_role || CASE WHEN chat_role = 'user' THEN ' name=' || speaker ELSE '' END || chr(10) AS head FROM r
), s AS (
  SELECT *, head || words || '<|im_end|>' || chr(10) AS segment FROM h
), o AS (
  SELECT *, CAST(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, words ROWS UNBOUNDED PRECEDING) AS BIGINT) AS end_char FROM s
)
SELECT conv_id, perspective, turn, chat_role, name, segment, end_char - length(segment) AS start_char, end_char,
       CASE WHEN chat_role = 'assistant' THEN end_char - length(segment) + length(head) END AS loss_from,
       CASE WHEN chat_role = 'assistant' THEN end_char - 1 END AS loss_to
FROM o
"""

OP10 = rf"""
WITH w AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)
), p AS (
  SELECT doc_id, w, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS u FROM w
), c1 AS (
  SELECT w, count(*) AS n FROM w GROUP BY w
), c2 AS (
  SELECT u, w, count(*) AS n FROM p WHERE u IS NOT NULL GROUP BY u, w
), total AS (
  SELECT count(*) AS n FROM w
), s AS (
  SELECT p.doc_id, coalesce(c2.n, 0) >= {MIN_PAIR} AS seen,
         CASE WHEN coalesce(c2.n, 0) >= {MIN_PAIR} THEN ln(c2.n) - ln(a.n) ELSE CASE WHEN p.u IS NULL THEN 0 ELSE ln({BACKOFF}) END + ln(b.n) - ln(total.n) END AS value
  FROM p JOIN c1 AS b ON b.w = p.w LEFT JOIN c1 AS a ON a.w = p.u LEFT JOIN c2 ON c2.u = p.u AND c2.w = p.w, total
), d AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (NOT seen) AS alone, sum(value) AS value FROM s GROUP BY doc_id
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_words, CAST(coalesce(alone, 0) AS BIGINT) AS n_backoff, round(coalesce(value, 0), 6) AS log_score, round(value / n, 6) AS mean_log
FROM documents LEFT JOIN d USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_bm25": OP2, "op3_perspectives": OP3, "op6_host_rules": OP6, "op10_backoff_lm": OP10}
