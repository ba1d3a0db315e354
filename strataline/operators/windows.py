"""Order-sensitive operators: runs, gaps, running coverage, layouts of groups and in-place revision of flags."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataline.plans.ordering import numbered


def _ordered(group: Sequence[str], order: str):
    return Window.partitionBy(*group).orderBy(order)


def _ahead(group: Sequence[str], order: str):
    return _ordered(group, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def numbering_gaps(df: DataFrame, group: Sequence[str], number: str) -> DataFrame:
    """(group..., number, missing): rows whose number leaves a gap behind them, and how many numbers it misses."""
    gap = F.col(number) - F.lag(number).over(_ordered(group, number)) - 1
    return df.withColumn("missing", gap).where("missing > 0").select(*group, number, F.col("missing").cast("long").alias("missing"))


def tolerant_runs(df: DataFrame, group: Sequence[str], position: str, tolerance: int, longer_than: int) -> DataFrame:
    """(group..., run, first, last, n): runs of positions at most `tolerance` apart, of more than `longer_than` elements; a lone element is no run."""
    new = F.when(F.col(position) - F.lag(position).over(_ordered(group, position)) <= tolerance, 0).otherwise(1)
    rows = df.withColumn("_new", new).withColumn("run", F.sum("_new").over(_ahead(group, position)))
    out = rows.groupBy(*group, "run").agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count(F.lit(1)).alias("n"))
    return out.where((F.col("n") > 1) & (F.col("n") > longer_than))


def marked_windows(df: DataFrame, group: Sequence[str], order: str, width: int, predicate) -> DataFrame:
    """Rows of `df` that lie in some window of `width` consecutive rows for which `predicate(k -> struct of the k-th row)` holds."""
    w = _ordered(group, order)
    rows = df.withColumn("_nth", F.row_number().over(w)).withColumn("_me", F.struct(*df.columns))
    # the window's rows are columns of their own, else every mention of one in the predicate would be a window function
    ahead = rows.withColumns({f"_w{k}": F.lead("_me", k).over(w) for k in range(1, width)})
    held = ahead.withColumn("_hit", predicate(lambda k: F.col(f"_w{k}") if k else F.col("_me")) & F.col(f"_w{width - 1}" if width > 1 else "_me").isNotNull())
    near = _ordered(group, "_nth").rowsBetween(-(width - 1), 0)
    return held.withColumn("_in", F.max(F.coalesce(F.col("_hit"), F.lit(False))).over(near)).where("_in").select(*df.columns)


def running_coverage(df: DataFrame, group: Sequence[str], position: str, flag: str, mark: int = 15) -> DataFrame:
    """(group..., n, covered, coverage, n_truncation, c_truncation): the share covered, and how far in from either end the `mark`-th covered position lies, as shares."""
    on = F.when(F.col(flag), 1).otherwise(0)
    back = Window.partitionBy(*group).orderBy(F.desc(position)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = df.withColumns({"_on": on, "_fwd": F.sum(on).over(_ahead(group, position)), "_bwd": F.sum(on).over(back)})
    out = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.sum("_on").alias("covered"), F.min(F.when(F.col("_fwd") == mark, F.col(position))).alias("_from_n"), F.max(F.when(F.col("_bwd") == mark, F.col(position))).alias("_from_c"))
    share = lambda c: F.coalesce(c / F.col("n"), F.lit(0.0))
    return out.select(*group, "n", "covered", (F.col("covered") / F.col("n")).alias("coverage"), share(F.col("_from_n")).alias("n_truncation"), share(F.col("n") - F.col("_from_c")).alias("c_truncation"))


def coverage_gaps(df: DataFrame, group: Sequence[str], position: str, flag: str, share: float = 0.1) -> DataFrame:
    """(group..., first, last, gap): uncovered runs longer than a share of the group, a trailing one included."""
    rows = df.withColumns({"_block": F.sum(F.when(F.col(flag), 1).otherwise(0)).over(_ahead(group, position)), "_n": F.count(F.lit(1)).over(Window.partitionBy(*group))})
    gaps = rows.where(~F.col(flag)).groupBy(*group, "_block").agg(F.min(position).alias("first"), F.max(position).alias("last"), F.max("_n").alias("_n"))
    return gaps.withColumn("gap", F.col("last") - F.col("first") + 1).where(F.col("gap") > share * F.col("_n")).select(*group, "first", "last", "gap")


def run_diversity(df: DataFrame, group: Sequence[str], position: str, target: str, at_most: int = 5) -> DataFrame:
    """(group..., run, first, last, diversity, low, high, kept): covered runs (target not null), their distinct targets and the targets' interval; runs of few targets aren't kept."""
    cut = F.sum(F.when(F.col(target).isNull(), 1).otherwise(0)).over(_ahead(group, position))
    runs = df.withColumn("run", cut).where(F.col(target).isNotNull()).groupBy(*group, "run")
    out = runs.agg(F.min(position).alias("first"), F.max(position).alias("last"), F.countDistinct(target).alias("diversity"), F.min(target).alias("low"), F.max(target).alias("high"))
    return out.withColumn("kept", F.col("diversity") > at_most)


def filled_targets(runs: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group..., target): every target inside a kept run's interval, once."""
    return runs.where("kept").select(*group, F.explode(F.sequence("low", "high")).alias("target")).distinct()


def _revise(flags: list[bool], fill: bool) -> list[bool]:
    """Five-wide revision in place, left to right, until a pass changes nothing: runs of one to three equal flags between opposite ones flip."""
    f = [x != fill for x in flags]  # now True marks what may be flipped away
    n, changed = len(f), True
    while changed:
        changed = False
        for i in range(2, n - 2):
            if not f[i]:
                continue
            flips = []
            if not f[i - 1] and not f[i + 1]:
                flips = [i]
            elif not f[i - 2] and f[i - 1] and not f[i + 1]:
                flips = [i - 1, i]
            elif not f[i - 1] and f[i + 1] and not f[i + 2]:
                flips = [i, i + 1]
            elif f[i - 1] and f[i + 1] and not f[i - 2] and not f[i + 2]:
                flips = [i - 1, i, i + 1]
            for k in flips:
                f[k] = False
            changed |= bool(flips)
    return [x != fill for x in f]


def revised_flags(df: DataFrame, group: Sequence[str], position: str, flag: str, fill: bool) -> DataFrame:
    """The table with short covered runs erased (or, with `fill`, short uncovered runs covered), one group at a time."""
    columns = [*group, position, flag]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(position, kind="stable")
        return pdf.assign(**{flag: _revise(pdf[flag].tolist(), fill)})[columns]

    rows = df.select(*columns)
    return rows.groupBy(*group).applyInPandas(run, rows.schema)


def trimmed_runs(df: DataFrame, group: Sequence[str], position: str, flag: str) -> DataFrame:
    """Rows from a group's first flagged position to its last."""
    w = Window.partitionBy(*group)
    at = F.when(F.col(flag), F.col(position))
    return df.withColumns({"_lo": F.min(at).over(w), "_hi": F.max(at).over(w)}).where(F.col(position).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def renumbered(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    return df.withColumn("number", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def even_split(df: DataFrame, order: Sequence[str], parts: int, name: str = "part") -> DataFrame:
    """Adds the part of each row: part i holds rows [i L / parts, (i + 1) L / parts) in order."""
    n = df.count()
    return numbered(df, order, "_place").withColumn(name, F.floor(((F.col("_place") + 1) * parts - 1) / max(1, n)).cast("int")).drop("_place")


def round_robin(df: DataFrame, order: Sequence[str], parts: int, name: str = "turn") -> DataFrame:
    return numbered(df, order, "_place").withColumn(name, (F.col("_place") % parts).cast("int")).drop("_place")


def path_length(df: DataFrame, group: Sequence[str], order: str, x: str, y: str) -> DataFrame:
    """(group..., length): the summed steps between consecutive points."""
    w = _ordered(group, order)
    step = F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w))
    return df.withColumn("_step", step).groupBy(*group).agg(F.coalesce(F.sum("_step"), F.lit(0.0)).alias("length"))
