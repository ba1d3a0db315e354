"""Mixing sources to target weights by a low-discrepancy schedule.

Targets come from water-filling: weights share the budget, no source passes `max_epochs` times its size, and what is above is shared
again by weight. Golden-ratio points, one a slot, run through the cumulated targets and so name a source for every slot; slots are ranked
within their source. Each source's documents are shuffled by hash and laid end to end, once an epoch, and that line, cut at the target, is
cut into as many equal-token blocks as the source has slots. The k-th slot of a source takes its k-th block, so that any run of slots holds the
sources near their weights; a document's `first_slot` says where in the mix it begins.

Defined results: null and empty texts have size 0 and are taken 0 words of; a null source is a source of its own and comes last; repeated
rows are separate documents; an empty table gives an empty schedule; ties in the shuffle fall to doc_id and size, and rows equal in those
are interchangeable. Sources so small that no point meets them get one slot at the end.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.plans.ordering import even_buckets, numbered, running, unit_hash
from strataline.session import bounded, cut, stored

WORD = r"[^\x20\x09-\x0D]+"
GOLDEN = (math.sqrt(5) - 1) / 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], budget_ratio: float, max_epochs: float) -> DataFrame:
    """One row a source: src_no (by code point, null last), source_size, target and its whole part."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("src_no") % len(weights)) + 1).cast("int"))
    t = numbered(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), [F.col("source").asc_nulls_last()], "src_no").withColumn("weight", weight)
    t = t.withColumns({"limit": max_epochs * F.col("source_size"), "ratio": max_epochs * F.col("source_size") / F.col("weight")})
    t = cut(numbered(t, [F.col("ratio"), F.col("src_no")], "_place", {"limits": F.col("limit").cast("double"), "lighter": F.col("weight")}))
    words, heavy = t.agg(F.sum("source_size"), F.sum("weight")).first()
    # a source is at its limit if, with all of smaller ratio at theirs, its share of the rest would still reach it
    t = t.withColumn("level", (F.lit(float(budget_ratio * (words or 0))) - F.col("limits")) / (F.lit(float(heavy or 0)) - F.col("lighter"))).withColumn("full", F.col("level") >= F.col("ratio"))
    first = t.where(~F.col("full")).agg(F.min(F.struct("ratio", "src_no", "level"))["level"]).first()[0]
    shared = F.col("limit") if first is None else F.when(F.col("full"), F.col("limit")).otherwise(F.lit(first) * F.col("weight"))
    t = t.withColumn("target", shared.cast("double"))
    return t.select("source", F.col("src_no").cast("int").alias("src_no"), "source_size", "target", F.floor(F.col("target") + 1e-6).cast("long").alias("whole"))


def slot_sources(sources: DataFrame, budget: float, slot_words: int) -> DataFrame:
    """(slot, src_no, k): the source each golden-ratio point falls on, ranked within the source."""
    spark = sources.sparkSession
    n = max(1, math.ceil(budget / slot_words))
    cells = max(1, n // 8)
    spans = numbered(sources.where("whole > 0"), ["src_no"], "_place", {"ahead": F.col("target")}).withColumn("lo", F.col("ahead") / budget).withColumn("hi", F.col("lo") + F.col("target") / budget)
    spans = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1).cast("long")))))
    x = (F.col("slot") + 0.5) * F.lit(GOLDEN)
    points = spark.range(n).withColumnRenamed("id", "slot").withColumn("x", x - F.floor(x)).withColumn("cell", F.floor(F.col("x") * cells))
    hit = points.join(spans.select("cell", "lo", "hi", "src_no"), "cell").where("x >= lo and x < hi").select("slot", "src_no")
    missed = sources.where("whole > 0").join(hit.select("src_no").distinct(), "src_no", "left_anti").select((F.lit(n) + F.col("src_no")).cast("long").alias("slot"), "src_no")
    chunk = max(1, math.isqrt(n))
    slots = cut(hit.union(missed).withColumn("chunk", F.floor(F.col("slot") / chunk)))
    return running(slots, ["src_no"], "chunk", [F.col("slot")], rank="k").select("slot", "src_no", "k")


def laid_out(docs: DataFrame, *, doc: str = "doc_id", source: str = "source", text: str = "text", weights: Sequence[float] = (5, 2, 1), budget_ratio: float = 1.5, max_epochs: int = 2, slot_words: int = 4096, shuffle: Sequence[str] = ("doc_id",)) -> tuple[DataFrame, DataFrame]:
    """(documents, slots): every document with its place on its source's line, and the schedule's slots. `shuffle` names what the hash is taken of."""
    sizes = cut(docs.select(F.col(doc).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")))
    sources = cut(targets(sizes, weights, budget_ratio, max_epochs))
    rows, budget = sizes.count(), float(sources.agg(F.sum("target")).first()[0] or 0)
    slots = cut(slot_sources(sources, budget or 1.0, slot_words))
    each = sources.join(slots.groupBy("src_no").agg(F.count(F.lit(1)).alias("n_slots")), "src_no", "left")
    each = each.select(F.col("source").alias("_source"), "src_no", "source_size", "target", "whole", F.coalesce("n_slots", F.lit(0)).cast("long").alias("n_slots"))
    placed = sizes.join(each, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = placed.withColumn("unit", unit_hash(*[F.col(c) for c in shuffle], F.lit("mix"))).withColumn("bucket", even_buckets(F.col("unit"), rows))
    placed = running(placed, ["src_no"], "bucket", [F.col("unit"), F.col("doc_id"), F.col("size")], F.col("size"), rank="place")
    return cut(placed.drop("unit", "bucket")), slots


def epochs(placed: DataFrame, max_epochs: int = 2) -> DataFrame:
    """The words of each document that each epoch takes: [first, last) on the source's line, and `skip`, the document's words before them."""
    e = placed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))))
    e = e.withColumn("first", F.col("epoch") * F.col("source_size") + F.col("before")).withColumn("last", F.least(F.col("first") + F.col("size"), F.col("whole")))
    return e.where("last > first")


def schedule(placed: DataFrame, slots: DataFrame, max_epochs: int = 2) -> DataFrame:
    """(slot, src_no, place, doc_id, source, epoch, start, length): the words of each document that each slot takes, from `start` on."""
    base, extra = F.floor(F.col("whole") / F.col("n_slots")).cast("long"), (F.col("whole") % F.col("n_slots")).cast("long")
    e = epochs(placed, max_epochs).withColumns({"base": base, "extra": extra})
    # blocks are `base` words long, the first `extra` of them one longer
    block = lambda p: F.when(p < F.col("extra") * (F.col("base") + 1), F.floor(p / (F.col("base") + 1))).otherwise(F.col("extra") + F.floor((p - F.col("extra") * (F.col("base") + 1)) / F.greatest(F.col("base"), F.lit(1)))).cast("long")
    begin = lambda k: k * F.col("base") + F.least(k, F.col("extra"))
    e = e.withColumn("k", F.explode(F.sequence(block(F.col("first")), block(F.col("last") - 1))))
    e = e.withColumns({"_from": F.greatest(F.col("first"), begin(F.col("k"))), "_to": F.least(F.col("last"), begin(F.col("k") + 1))})
    e = e.select("src_no", "k", "place", "doc_id", "source", "epoch", (F.col("_from") - F.col("first")).alias("start"), (F.col("_to") - F.col("_from")).alias("length"))
    return e.join(slots, ["src_no", "k"]).drop("k")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """A row a document: size, its source's size and target, the words that the schedule's slots take of it, the first of those slots (null if none) and their number."""
    placed, slots = laid_out(docs, **how)
    taken = schedule(placed, slots, how.get("max_epochs", 2)).groupBy("src_no", "place").agg(F.sum("length").alias("taken"), F.min("slot").alias("first_slot"), F.count(F.lit(1)).alias("n_slots"))
    rows = placed.drop("n_slots").join(taken, ["src_no", "place"], "left")
    return rows.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot", F.coalesce("n_slots", F.lit(0)).cast("long").alias("n_slots"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, white space kept."""
    return F.array_join(F.slice(F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), F.lit(1), n.cast("int")), "")


def sampled(docs: DataFrame, *, doc: str = "doc_id", source: str = "source", text: str = "text", n_chars: str | None = "n_chars", **how) -> DataFrame:
    """The mix itself: the rows of `docs`, once an epoch that takes words of them, cut at the last word taken, in partitions by runs of slots and in slot order within them.

    Rows are told apart by a number given when they are written; the shuffle's hash is of the id and all columns, so repeated rows stay
    separate and only they are interchangeable. Columns may have any name.
    """
    spark = docs.sparkSession
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = stored(docs.select(F.struct(F.col(doc).alias("id"), F.xxhash64(whole).alias("hash"), F.monotonically_increasing_id().alias("row")).alias("key"), whole.alias("doc")))
    inner = rows.select("key", "key.id", "key.hash", F.col("doc").getField(source).alias("source"), F.col("doc").getField(text).alias("text"))
    placed, slots = laid_out(inner, doc="key", source="source", text="text", shuffle=("doc_id.id", "doc_id.hash"), **how)
    taken = schedule(placed, slots, how.get("max_epochs", 2)).groupBy("src_no", "place", "doc_id", "epoch").agg(F.sum("length").alias("taken"), F.min("slot").alias("slot"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    last = (slots.agg(F.max("slot")).first()[0] or 0) + 1
    taken = cut(taken.join(placed.select("src_no", "place", "size"), ["src_no", "place"]).select(F.col("doc_id.row").alias("_row"), "taken", "size", "slot", F.floor(F.col("slot") * parts / F.lit(last)).alias("part")))
    out = rows.join(bounded(taken), F.col("key.row") == F.col("_row")).repartition(parts, "part").sortWithinPartitions("slot", "key")
    body = F.col("doc").getField(text)
    body = F.when(F.col("taken") < F.col("size"), first_words(body, F.col("taken"))).otherwise(body)
    kept = {c: F.col("doc").getField(c) for c in docs.columns} | {text: body}
    if n_chars in docs.columns:
        kept[n_chars] = F.length(body).cast(docs.schema[n_chars].dataType)
    return out.select(*[c.alias(name) for name, c in kept.items()])
