"""Connected components of an edge table, wholly distributed.

Rounds of large-star and small-star steps turn every component into a star around its smallest node. A hub's edges meet its minimum in a
plain equi-join of two exchanges, which adaptive execution can split when the hub is hot; minima are pre-aggregated before they move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.session import bounded, stored


def _minima(edges: DataFrame) -> DataFrame:
    # the xor keeps the join from taking over the aggregate's partitioning, under which a hot key could not be split
    return edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").bitwiseXOR(F.lit(0).cast("long")).alias("u"), "m")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 64) -> DataFrame:
    """(node, component) for every node with an edge; component is the smallest node id reachable. Ids are longs; null ends are dropped."""
    e = edges.select(F.greatest(F.col(src), F.col(dst)).alias("u"), F.least(F.col(src), F.col(dst)).alias("v")).where(F.col(src).isNotNull() & F.col(dst).isNotNull())
    loops = e.where("u = v").select("u")
    # files tell their own size: a checkpoint would carry the plan's estimate, which joins square from round to round
    e = stored(e.where("u <> v").distinct())
    nodes = e.select("u").union(e.select(F.col("v").alias("u"))).union(loops).distinct()
    seen = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_minima(both), "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        minima = _minima(large)
        small = large.join(minima, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(small.union(minima.select("u", F.col("m").alias("v"))).distinct())
        state = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return nodes.join(e.withColumnRenamed("v", "m"), "u", "left").select(F.col("u").alias("node"), F.coalesce("m", "u").alias("component"))


def components_by_parts(edges: DataFrame, src: str = "src", dst: str = "dst", share: int = 16) -> DataFrame:
    """As `connected_components`, for graphs with many more edges than nodes: first over every `share`-th edge by hash, then over the edges that lead from one of those components to another.

    Every edge is looked at: those inside a component of the first step can't change it, all others are in the second.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where(F.col(src).isNotNull() & F.col(dst).isNotNull())
    first = stored(connected_components(e.where(F.pmod(F.xxhash64("u", "v"), F.lit(share)) == 0), "u", "v"))
    known = bounded(first)
    of = lambda c: known.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
    ends = e.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("_u", "u").alias("u"), F.coalesce("_v", "v").alias("v"), (F.col("u") == F.col("v")).alias("loop"))
    second = connected_components(stored(ends.where((F.col("u") != F.col("v")) | F.col("loop")).distinct()), "u", "v")
    second = stored(second.select(F.col("node").alias("of"), F.col("component").alias("least")))
    inside = first.join(second, F.col("component") == F.col("of"), "left").select("node", F.coalesce("least", "component").alias("component"))
    new = second.join(first.select(F.col("node").alias("of")), "of", "left_anti").select(F.col("of").alias("node"), F.col("least").alias("component"))
    return inside.union(new)
