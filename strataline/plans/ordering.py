"""Ranks and running sums over groups of any size.

A window over a whole group puts that group into one task. Here a group is cut into ordered buckets, ranked inside each bucket, and the
buckets' totals (about the square root of the row count of them) are accumulated in a second, small window.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataline.session import cut


def unit_hash(*cols: Column) -> Column:
    """A uniform number in [0, 1) made from the columns' values: 53 bits of a 64-bit hash."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))


def even_buckets(unit: Column, rows: int) -> Column:
    """Bucket of a number in [0, 1): about sqrt(rows) buckets in the number's order."""
    return F.floor(unit * F.lit(float(max(1, math.isqrt(max(1, rows)))))).cast("long")


def numbered(df: DataFrame, order: Sequence[Column | str], name: str = "place0", sums: dict[str, Column] | None = None) -> DataFrame:
    """Adds each row's 0-based place in a whole table's order and, for each of `sums`, the sum over the rows ahead of it, without one task for all rows.

    Ranges are sorted on their own and the counts and sums of the ranges before are added. The ranges are materialised first, so places don't
    move. Rows equal in `order` are numbered in any order.
    """
    sums = sums or {}
    rows = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    rows = rows.withColumns({"_part": F.shiftright("_id", 33), **{f"_v{k}": v for k, v in enumerate(sums.values())}})
    totals = rows.groupBy(F.col("_part").alias("_of")).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(f"_v{k}").alias(f"_t{k}") for k in range(len(sums))])  # a row a range
    ahead = Window.partitionBy(F.lit(0)).orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_of", *[F.coalesce(F.sum(f"_t{k}").over(ahead), F.lit(0)).alias(f"_b{k}") for k in range(len(sums))], F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    own = Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    for k, c in enumerate(sums):
        rows = rows.withColumn(f"_s{k}", F.coalesce(F.sum(f"_v{k}").over(own), F.lit(0)))
    placed = rows.join(F.broadcast(before), F.col("_part") == F.col("_of"))
    made = {name: F.col("_id").bitwiseAND(F.lit((1 << 33) - 1).cast("long")) + F.col("_before"), **{c: F.col(f"_s{k}") + F.col(f"_b{k}") for k, c in enumerate(sums)}}
    return placed.withColumns(made).drop("_id", "_part", "_of", "_before", *[f"{x}{k}" for k in range(len(sums)) for x in ("_v", "_s", "_b")])


def running(df: DataFrame, groups: Sequence[str], bucket: str, order: Sequence[Column], value: Column | None = None, rank: str = "rank0", before: str = "before") -> DataFrame:
    """Adds each row's 0-based rank in its group and, for `value`, the sum over the rows ahead of it.

    `bucket` must ascend with `order`. Empty input gives an empty result; null group keys form a group of their own.
    """
    # one struct as the key: nulls in it are equal, and the join below finds the rows dealt out as the window left them
    key = F.struct(*[F.col(g) for g in groups], F.col(bucket))
    amount = (F.lit(0) if value is None else F.coalesce(value, F.lit(0))).cast("long")
    rows = df.withColumns({"_key": key, "_amount": amount})
    inner = Window.partitionBy("_key").orderBy(*order)
    ranked = rows.withColumns({"_rank": (F.row_number().over(inner) - 1).cast("long"), "_before": F.sum("_amount").over(inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_amount")})
    outer = (Window.partitionBy(*[f"_key.{g}" for g in groups]) if groups else Window.partitionBy(F.lit(0))).orderBy(f"_key.{bucket}").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.sum("_amount").alias("_sum"))
    totals = totals.select(F.col("_key").alias("_of"), (F.sum("_n").over(outer) - F.col("_n")).alias("_n0"), (F.sum("_sum").over(outer) - F.col("_sum")).alias("_sum0"))
    joined = ranked.join(totals, F.col("_key") == F.col("_of")).withColumns({rank: F.col("_rank") + F.col("_n0"), before: F.col("_before") + F.col("_sum0")})
    return joined.drop("_key", "_of", "_amount", "_rank", "_before", "_n0", "_sum0", *([before] if value is None else []))
