"""Quality rules with verdicts on hosts.

Every text is measured with SQL functions alone. Failures of the base rules are summed by host, the hosts' failure rates are shrunk
towards a beta prior estimated from all hosts by moments, and a host has all its documents rejected when its shrunk rate, less `HOST_MARGIN`
standard deviations of its posterior, is still above `HOST_LIMIT`: most of what it holds fails, and it holds enough to say so.

Defined results: null and empty texts have no words and fail; ties and repeated rows are measured row by row and count row by row; a null
host is a host of its own; an empty table gives an empty result; further columns pass through, and a column that has the name of a
measure is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.session import bounded, cut, stored

SPACE = r"[\x20\x09-\x0D]+"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A host's documents go when its posterior share of failing ones is above the limit by the margin in standard deviations.
HOST_LIMIT, HOST_MARGIN = 0.5, 2.0
#: Verdicts are broadcast up to this many hosts; above, rows and verdicts meet in a shuffled join.
BROADCAST_HOSTS = 100_000
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def words_of(text: Column) -> Column:
    """The runs of characters other than ASCII white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """How many words lie in a 3-word window that the text holds twice or more.

    The windows' 64-bit hashes are sorted with their places; equal neighbours mark repeated windows, and the sorted places of those are
    summed as overlapping intervals of three. All of it is linear but for the sorts, so very long texts and single-word texts are alike.
    """
    windows = F.when(F.size(words) >= 4, F.array_sort(F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda i: F.struct(F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)).alias("h"), i.alias("i")))))
    return F.coalesce(covered(windows), F.lit(0)).cast("long")


def covered(windows: Column) -> Column:
    # transform keeps `windows` as a column of its own, else every lambda call would build it anew
    places = lambda s: F.array_sort(F.transform(F.filter(F.transform(s, lambda x, k: F.struct(x["i"].alias("i"), ((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])).alias("twice"))), lambda x: x["twice"]), lambda x: x["i"]))
    union = lambda p: F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-9).alias("at")), lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["at"])).alias("n"), i.alias("at")), lambda a: a["n"])
    inner = F.transform(F.array(windows), places)
    return F.get(F.transform(inner, union), F.lit(0))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the base measures and `base_failed`.

    The measures are one struct over a bound array of words: however plans move or repeat the expression, no lambda splits the text again.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def measures(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w)).cast("long").alias("word_chars"),
            repeated_words(words).alias("n_repeat_words"),
        )

    bound = F.get(F.transform(F.array(words_of(F.col(text))), measures), F.lit(0))
    out = docs.withColumn("_m", bound).withColumns(
        {
            "n_words": F.col("_m.n_words"),
            "word_chars": F.col("_m.word_chars"),
            "n_symbols": (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))).cast("long"),
            "n_dup_lines": F.get(F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x))), F.lit(0)).cast("long"),
            "n_repeat_words": F.col("_m.n_repeat_words"),
        }
    )
    return out.withColumn("base_failed", (F.col("_m.n_words") < MIN_WORDS) | (100 * F.col("_m.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("_m.n_words"))).drop("_m")


def host_verdicts(measures: DataFrame, host: str, host_limit: float = HOST_LIMIT) -> DataFrame:
    """One row a host: rows, failures, failure rate shrunk by the hosts' own beta prior, and whether the host is rejected.

    Moments: with mean m and variance v of the hosts' raw rates, the prior's strength is m(1-m)/v - 1, held to 1..1000; one host alone or
    no spread gives 1000 or what the mean allows. The two moments are the only values that reach the driver.
    """
    hosts = cut(measures.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n_docs"), F.count_if("base_failed").alias("n_failed")))
    raw = F.col("n_failed") / F.col("n_docs")
    mean, variance = hosts.agg(F.avg(raw), F.var_samp(raw)).first()
    mean = mean or 0.0
    strength = min(1000.0, max(1.0, mean * (1 - mean) / variance - 1)) if variance else 1000.0
    rows = F.col("n_docs") + F.lit(strength)
    rate = (F.col("n_failed") + F.lit(mean * strength)) / rows
    floor = rate - HOST_MARGIN * F.sqrt(rate * (1 - rate) / (rows + 1))
    return hosts.select("host", "n_docs", "n_failed", rate.alias("host_rate"), (floor > host_limit).alias("host_rejected"))


def judge(docs: DataFrame, host: str = "source", text: str = "text", host_limit: float = HOST_LIMIT, keep_rows: bool = False) -> DataFrame:
    """Every row with its measures, its host's shrunk failure rate and `kept`; with `keep_rows` the text stays too.

    Rows are measured once and written with their measures, which then meet their host's verdict.
    """
    rows = stored(measured(docs) if keep_rows else measured(docs).drop(text))
    verdicts = bounded(host_verdicts(rows, host, host_limit).select(F.col("host").alias("_host"), "host_rate", "host_rejected"), BROADCAST_HOSTS)
    joined = rows.drop("host_rate", "host_rejected").join(verdicts, rows[host].eqNullSafe(F.col("_host")), "left").drop("_host")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("host_rejected"), F.lit(False)))
