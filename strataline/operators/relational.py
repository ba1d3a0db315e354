"""Joins, aggregates, histograms, set algebra and rule ladders on tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataline.functions import text as T
from strataline.session import cut

# ---- joins -----------------------------------------------------------------------------------------------------------------------


def first_match(left: DataFrame, key: str, array: str, right: DataFrame, right_key: str, also: Column | None = None) -> DataFrame:
    """Rows of `left` with the first element of `array` that `right` has, and right's columns; rows without one are dropped."""
    rest = [c for c in right.columns if c != right_key]
    spread = left.select(key, F.posexplode(array).alias("_pos", right_key)).join(right, right_key)
    spread = spread if also is None else spread.where(also)
    best = F.min_by(F.struct(right_key, *rest), "_pos").alias("_r")
    return left.join(spread.groupBy(key).agg(best), key).select(*left.columns, "_r.*")


def described_list(rows: DataFrame, key: str, ids: str, dictionary: DataFrame, id_col: str, description: str, out: str) -> DataFrame:
    """Adds `out`: each id as `(ID) DESC;`, `(ID);` without a description, upper-cased, in order, blanks dropped."""
    spread = rows.select(key, F.posexplode(ids).alias("_pos", "_id")).where(T.strip_all(F.col("_id")) != "")
    found = spread.join(dictionary.select(F.col(id_col).alias("_id"), F.col(description).alias("_d")), "_id", "left")
    word = F.upper(F.when(F.coalesce("_d", F.lit("")) == "", F.concat(F.lit("("), F.col("_id"), F.lit(");"))).otherwise(F.concat(F.lit("("), F.col("_id"), F.lit(") "), F.col("_d"), F.lit(";"))))
    lists = found.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_pos", word.alias("w")))), lambda x: x["w"]), " ").alias(out))
    return rows.join(lists, key, "left").withColumn(out, F.coalesce(out, F.lit("")))


def in_sets(df: DataFrame, wanted: dict[str, DataFrame | None]) -> DataFrame:
    """Rows whose columns are all in their sets; a missing set doesn't filter."""
    return reduce(lambda d, kv: d if kv[1] is None else d.join(kv[1], kv[0], "left_semi"), wanted.items(), df)


def with_misses(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(matched rows, left rows without a match)."""
    return left.join(right, key), left.join(right.select(key), key, "left_anti")


def coalesced(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str], forced: Sequence[str] = ()) -> DataFrame:
    """Left's values where it has any, else right's; for `forced` columns the other way round."""
    j = left.alias("l").join(right.alias("r"), key, "left")
    pick = lambda c: F.coalesce(F.col(f"r.{c}"), F.col(f"l.{c}")) if c in forced else F.coalesce(F.col(f"l.{c}"), F.col(f"r.{c}"))
    return j.select(key, *[pick(c).alias(c) for c in columns])


def adjacent_pairs(df: DataFrame, value: str, order: Sequence[str], partition: Sequence[str] = ()) -> DataFrame:
    """(partition..., first, second): every value with the next one."""
    w = (Window.partitionBy(*partition) if partition else Window.partitionBy(F.lit(0))).orderBy(*order)
    return df.select(*partition, F.col(value).alias("first"), F.lead(value).over(w).alias("second")).where("second is not null")


def joined_with_default(left: DataFrame, right: DataFrame, key: str | Sequence[str], columns: dict[str, object]) -> DataFrame:
    """Left join in which missing values take a default."""
    j = left.join(right, key, "left")
    return j.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in columns.items()})


def positional_join(left: DataFrame, right: DataFrame, group: Sequence[str], left_order: Sequence[str], right_order: Sequence[str]) -> DataFrame:
    """The i-th row of a group on the left with the i-th on the right."""
    nth = lambda order: F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return left.withColumn("_i", nth(left_order)).join(right.withColumn("_i", nth(right_order)), [*group, "_i"]).withColumnRenamed("_i", "place")


# ---- dedup and sets --------------------------------------------------------------------------------------------------------------


def deduplicated(df: DataFrame, key: str, source: str, mode: str, first: str, second: str, order: Sequence[str]) -> DataFrame:
    """`none`: all rows. `prefer_first`, `prefer_second`: one row a key, of the preferred source where it has the key."""
    if mode == "none":
        return df
    preferred = first if mode == "prefer_first" else second
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.when(F.col(source) == preferred, 0).otherwise(1), *order))
    return df.withColumn("_n", place).where("_n = 1").drop("_n")


def intersections(tokens: DataFrame, group: str, domain: str, token: str, min_size: int = 1, top: int | None = 30) -> DataFrame:
    """(group, combination, size): how many tokens lie in exactly that combination of domains."""
    own = tokens.select(group, domain, token).distinct().groupBy(group, token).agg(F.array_join(F.array_sort(F.collect_set(domain)), " & ").alias("combination"))
    counted = own.groupBy(group, "combination").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= min_size)
    if top is None:
        return counted
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("size"), "combination"))
    return counted.withColumn("_n", place).where(F.col("_n") <= top).drop("_n")


def set_sizes(tokens: DataFrame, domains: DataFrame, group: str, domain: str, token: str) -> DataFrame:
    """(group, domain, size, shared, only): distinct tokens, those in all of the group's domains (empty ones count), and the rest."""
    rows = tokens.select(group, domain, token).distinct()
    n = domains.groupBy(group).agg(F.countDistinct(domain).alias("_n"))
    shared = rows.groupBy(group, token).agg(F.count(F.lit(1)).alias("_k")).join(n, group).where("_k = _n").groupBy(group).agg(F.count(F.lit(1)).alias("shared"))
    sizes = domains.select(group, domain).distinct().join(rows.groupBy(group, domain).agg(F.count(F.lit(1)).alias("size")), [group, domain], "left")
    out = sizes.join(shared, group, "left").withColumns({"size": F.coalesce("size", F.lit(0).cast("long")), "shared": F.coalesce("shared", F.lit(0).cast("long"))})
    return out.withColumn("only", F.col("size") - F.col("shared"))


def membership_matrix(tokens: DataFrame, token: str, domain: str, domains: Sequence[str]) -> DataFrame:
    """One row a token, a 0/1 column a domain."""
    wide = tokens.groupBy(token).pivot(domain, list(domains)).agg(F.lit(1))
    return wide.select(token, *[F.coalesce(F.col(f"`{d}`"), F.lit(0)).alias(d) for d in domains])


# ---- histograms ------------------------------------------------------------------------------------------------------------------


def score_bins(df: DataFrame, score: str, lo: str = "0.45", step: str = "0.05", bins: int = 11, legacy_bins: bool = False) -> DataFrame:
    """(bin, n) of decimal scores in fixed half-open bins, the last one closed.

    With `legacy_bins` the bounds are compared as binary numbers, which puts the exact scores .55, .65, .80 and .90 into the bin below.
    """
    v = F.col(score).cast("decimal(6,4)")
    k = F.floor((v - F.lit(lo).cast("decimal(6,4)")) / F.lit(step).cast("decimal(6,4)")).cast("int")
    if legacy_bins:
        k = F.when(v.isin(*[F.lit(x).cast("decimal(6,4)") for x in ("0.55", "0.65", "0.80", "0.90")]), k - 1).otherwise(k)
    k = F.when(v == F.lit(lo).cast("decimal(6,4)") + bins * F.lit(step).cast("decimal(6,4)"), bins - 1).otherwise(k)
    return df.select(k.alias("bin")).where(F.col("bin").between(0, bins - 1)).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def equal_width_bins(df: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, n): equal widths over the values' range, the last bin closed; one value fills the first bin."""
    lo, hi = df.agg(F.min(value), F.max(value)).first()
    if lo is None:
        return df.select(F.lit(0).alias("bin")).limit(0).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    k = F.lit(0) if lo == hi else F.least(F.floor((F.col(value) - lo) * bins / (hi - lo)), F.lit(bins - 1))
    return df.where(F.col(value).isNotNull()).select(k.cast("int").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def density_grid(df: DataFrame, x: str, y: str, lo: float, hi: float, bins: int) -> DataFrame:
    """(ix, iy, n, density): counts on a square grid over a fixed range, the last bins closed, density relative to the fullest cell."""
    cell = lambda c: F.least(F.floor((F.col(c) - lo) * bins / (hi - lo)), F.lit(bins - 1)).cast("int")
    kept = df.where(F.col(x).between(lo, hi) & F.col(y).between(lo, hi))
    grid = kept.groupBy(cell(x).alias("ix"), cell(y).alias("iy")).agg(F.count(F.lit(1)).alias("n"))
    return grid.withColumn("density", F.col("n") / F.max("n").over(Window.partitionBy(F.lit(0))))


def blurred(grid: DataFrame, bins: int, sigma: float = 1.5, value: str = "n") -> DataFrame:
    """(ix, iy, value): the grid under a Gaussian kernel of three sigmas; cells beyond the border count as empty."""
    import math

    r = math.ceil(3 * sigma)
    kernel = [(dx, dy, math.exp(-(dx * dx + dy * dy) / (2 * sigma * sigma))) for dx in range(-r, r + 1) for dy in range(-r, r + 1)]
    total = sum(w for *_, w in kernel)
    offsets = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(w / total).alias("w")) for dx, dy, w in kernel])
    spread = grid.select("ix", "iy", F.col(value).alias("_v"), F.explode(offsets).alias("o")).select((F.col("ix") + F.col("o.dx")).alias("ix"), (F.col("iy") + F.col("o.dy")).alias("iy"), (F.col("_v") * F.col("o.w")).alias("_v"))
    return spread.where(F.col("ix").between(0, bins - 1) & F.col("iy").between(0, bins - 1)).groupBy("ix", "iy").agg(F.sum("_v").alias(value))


def kernel_density(df: DataFrame, x: str, y: str, lo: float, hi: float, bins: int) -> DataFrame:
    """(ix, iy, density): Gaussian kernel density with Scott's bandwidth at cell centres.

    Every point meets every cell of a fixed grid, so the work grows in proportion to the points.
    """
    points = df.select(F.col(x).alias("x"), F.col(y).alias("y")).where("x is not null and y is not null")
    n, sx, sy, sxy = points.agg(F.count(F.lit(1)), F.var_samp("x"), F.var_samp("y"), F.covar_samp("x", "y")).first()
    h2 = n ** (-1 / 3)
    sx, sy, sxy = sx * h2, sy * h2, sxy * h2
    det = sx * sy - sxy * sxy
    step = (hi - lo) / bins
    cells = df.sparkSession.range(bins * bins).select((F.col("id") % bins).cast("int").alias("ix"), F.floor(F.col("id") / bins).cast("int").alias("iy"))
    dx, dy = F.lit(lo) + (F.col("ix") + 0.5) * step - F.col("x"), F.lit(lo) + (F.col("iy") + 0.5) * step - F.col("y")
    q = (sy * dx * dx - 2 * sxy * dx * dy + sx * dy * dy) / det
    near = points.join(F.broadcast(cells))  # bins x bins rows, whatever the points
    return near.groupBy("ix", "iy").agg((F.sum(F.exp(-q / 2)) / (2 * 3.141592653589793 * det**0.5 * n)).alias("density"))


# ---- ladders and ranking ---------------------------------------------------------------------------------------------------------


def hit_class(n_truncation: Column, c_truncation: Column, has_gaps: Column, gap_share: Column, coverage: Column) -> Column:
    """struct(class, flag) of a hit by truncation at either end, then gaps, then coverage."""
    r = lambda cls, flag: F.struct(F.lit(cls).alias("class"), F.lit(flag).alias("flag"))
    by_coverage = lambda flag: F.when(coverage >= 0.5, r("r2", flag)).otherwise(r("r3", "LC"))
    gaps = F.when(gap_share > 0.5, r("r3", "LC")).when(gap_share > 0.15, r("r2", "ICG")).when(coverage > 0.7, r("r1", "OK")).otherwise(r("r2", "ICG"))
    return F.when(n_truncation >= 0.15, by_coverage("NTC")).when(c_truncation >= 0.15, by_coverage("CTC")).when(has_gaps, gaps).when(coverage < 0.7, by_coverage("LC")).otherwise(r("r1", "OK"))


def burial(distances: DataFrame, key: str, distance: str, core: float = -3.0, margin: float = -2.0, order: Sequence[str] = ()) -> DataFrame:
    """(key, burial, mean): core -1, margin 0 or exposed 1 from a vertex's signed distances to the surface. The least distance is that without signs; it stands for the mean where it decides. A missing distance is not below the core.

    A sum of doubles hangs on the order of its terms. With `order`, columns that tell all rows of a key apart, a mean within rounding of a bound is that of the rows summed in this order; no other mean's side of a bound can change.
    """
    d = F.col(distance)
    agg = distances.groupBy(key).agg(
        F.avg(d).alias("mean"), F.min(F.abs(d)).alias("lo"), (F.max(d) - F.min(d)).alias("spread"), F.avg(F.when(d < core, 1).otherwise(0)).alias("below"), F.count(d).alias("n"), F.max(F.abs(d)).alias("most")
    )
    if order:
        error = (F.col("n") + 2) * F.col("most") * 2.0**-51  # two orders of n terms differ by less: each sum is off by n units of 2 ** -53 of n times the greatest at most
        close = F.least(*[F.abs(F.col("mean") - bound) for bound in (core, margin, 0.0)]) <= error
        known = cut(agg)
        rows = distances.join(known.where(close).select(F.col(key).alias("_key")), F.col(key).eqNullSafe(F.col("_key")), "left_semi").where(d.isNotNull())
        so_far = F.sum(d).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        sums = rows.select(key, *order, so_far.alias("_sum")).groupBy(F.col(key).alias("_key")).agg(F.max_by("_sum", F.struct(*order)).alias("_sum"))
        agg = known.join(sums, F.col(key).eqNullSafe(F.col("_key")), "left").withColumn("mean", F.coalesce(F.col("_sum") / F.col("n"), "mean"))
    deep = F.when(F.col("below") > 0.6, -1).when(F.col("spread") > 5.0, 1).otherwise(-1)
    near = F.when((F.col("mean") < 0) | (F.col("lo") <= margin), 0).otherwise(1)
    by_least = (F.col("mean") > margin) & (F.col("mean") > core) & (F.col("lo") <= margin)
    return agg.select(key, F.when(F.col("mean") <= core, deep).when(F.col("mean") <= margin, near).when(by_least, 0).otherwise(1).alias("burial"), F.when(by_least, F.col("lo")).otherwise(F.col("mean")).alias("mean"))


def rank_order() -> list[Column]:
    """Rank rising (missing last), then tm and coverage falling (missing last)."""
    low = F.lit(float("-inf"))
    return [F.coalesce(F.col("rank"), F.lit(10**9)).asc(), F.coalesce(F.col("tm"), low).desc(), F.coalesce(F.col("coverage"), low).desc()]


def skip_reason(name: Column, rank: Column, wanted: Sequence[int]) -> Column:
    return F.when(~name.rlike("--"), "bad_pattern").when(rank.isNull(), "bad_rank").when(~rank.isin(*wanted), "not_requested").otherwise("ok")


def sequence_columns(df: DataFrame, sample: int = 200) -> list[str]:
    """Columns that hold protein sequences: by name, or 80 % of the values in `sample` rows are 60 or more residue letters. The rows are those of smallest hash, so reruns agree."""
    named = [c for c in df.columns if c.lower() in ("sequence", "seq", "aa_sequence", "protein_sequence")]
    others = [c for c, t in df.dtypes if t == "string" and c not in named]
    looks = df.select(*others).orderBy(F.xxhash64(*others), *others).limit(sample).agg(*[F.avg(F.coalesce(F.col(c).rlike(r"^[ACDEFGHIKLMNPQRSTVWYBXZJUO*]{60,}$"), F.lit(False)).cast("int")).alias(c) for c in others]).first() if others else {}
    return named + [c for c in others if (looks[c] or 0) >= 0.8]


def identity_metrics(pairs: DataFrame, a: str = "aligned1", b: str = "aligned2") -> DataFrame:
    """Counts of equal, strongly and weakly similar columns of two aligned sequences, and their shares of the shorter, the longer and the gap-free length."""
    n = F.length(a)
    left, right = F.split(a, ""), F.split(b, "")
    symbols = F.zip_with(left, right, T.pair_symbol)
    whole = F.filter(F.zip_with(left, right, lambda x, y: ~x.isin("-", "X") & ~y.isin("-", "X")), lambda v: v)
    count = lambda s: F.size(F.filter("_s", lambda x: x == s)).cast("long")
    bare = lambda c: F.length(F.regexp_replace(c, "-", ""))
    out = pairs.withColumn("_s", F.when(n > 0, symbols).otherwise(F.array().cast("array<string>"))).withColumns({"identical": count("*"), "strong": count(":"), "weak": count("."), "compared": F.when(n > 0, F.size(whole)).otherwise(0).cast("long")})
    out = out.withColumns({"shorter": F.least(bare(a), bare(b)).cast("long"), "longer": F.greatest(bare(a), bare(b)).cast("long")})
    share = lambda d: F.when(F.col(d) > 0, F.round(100.0 * F.col("identical") / F.col(d), 1)).otherwise(0.0)
    return out.withColumns({f"identity_{d}": share(d) for d in ("shorter", "longer", "compared")}).drop("_s")
