"""Near-duplicates by SimHash and a Gray-order hierarchical index.

Equal fingerprints are one code. Two codes that differ in at most k bits agree on one of k + 1 bands, so codes are dealt by (band, value);
a bucket above `CELL` codes is dealt again by bands of its remaining bits, and one that stays large after `LEVELS` deals is cut into
cells so that every pair of its codes meets in one. Inside a bucket codes stand in Gray order, where neighbours share most bits: runs of `FAN`
become a node that keeps the bits its codes share (mask and value), runs of nodes become upper nodes, and the index is joined with itself
from the root down, dropping a pair of nodes as soon as the shared bits alone differ in more than k places. Of the links found, a bucket
returns only a spanning forest, so a group of near copies costs rows in proportion to its size; the forests are joined by distributed
connected components.

Defined results: null, empty and blank texts have the fingerprint zero and link like any other; rows with equal ids are separate rows of one
class at least when their texts link; null ids get their group's smallest id, null if it has none; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from strataline.plans.components import connected_components
from strataline.session import arrow_rows, bounded, cut, stored, trimmed

BITS, K, SHINGLE, SEED = 64, 4, 4, 42
CELL, FAN, LEVELS, TREE_ROWS = 1024, 8, 3, 1 << 15


def fingerprint_of(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint of one text."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and white space only
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first, last = np.concatenate(([0], ends[:-1] + 1)), ends[min(shingle, len(words)) - 1 :]
    return majority(np.fromiter((digest(line[a:b], seed) for a, b in zip(first.tolist(), last.tolist(), strict=False)), np.uint64, len(last)))


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of these hashes: a bit is 1 if it is in over half of them; of none, zero."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(id, fp): every row's fingerprint, as a signed long."""
    kind = docs.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint_of(t.as_py(), shingle, seed) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    return docs.select(doc, text).mapInArrow(run, f"id {kind}, fp long")


def gray_rank(code: Column) -> Column:
    """The place of a code in Gray order: the prefix xor of its bits."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code


def band_widths(bits: int, k: int) -> list[int]:
    return [bits // (k + 1) + (i < bits % (k + 1)) for i in range(k + 1)]


def dealt(rows: DataFrame, bits: int, k: int) -> tuple[DataFrame, int]:
    """Each row once a band of its `rest`: a new key of the old one and the band's value, and the other bits as the new rest."""
    parts, shift, widths = [], 0, band_widths(bits, k)
    rest = F.col("rest")
    for j, width in enumerate(widths):
        value = F.shiftrightunsigned(rest, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        high = F.shiftrightunsigned(rest, shift + width) if shift + width < 64 else F.lit(0).cast("long")
        low = rest.bitwiseAND(F.lit((1 << shift) - 1).cast("long"))
        parts.append(F.struct(F.xxhash64(F.col("key"), F.lit(j), value).alias("key"), F.shiftleft(high, shift).bitwiseOR(low).alias("rest")))
        shift += width
    out = rows.withColumn("part", F.explode(F.array(*parts)))
    return out.select("fp", F.col("part.key").alias("key"), F.col("part.rest").alias("rest")), bits - min(widths)


def in_cells(rows: DataFrame, cell: int) -> DataFrame:
    """Rows of buckets of n codes, dealt so that every pair of a bucket's codes meets in some cell of about 2 x cell codes."""
    grid = rows.withColumn("cells", F.ceil(F.col("n") / cell)).withColumn("own", F.pmod(F.xxhash64("fp", F.lit("cell")), F.col("cells")))
    grid = grid.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)))
    return grid.withColumn("key", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))).drop("cells", "own", "other", "n")


def buckets(codes: DataFrame, k: int, cell: int = CELL, levels: int = LEVELS) -> DataFrame:
    """(key, fp): codes by bucket; any two codes within k bits share a key, and a key has at most about 2 x cell codes."""
    rows, bits, done = codes.select("fp", F.lit(0).cast("long").alias("key"), F.col("fp").alias("rest")), BITS, []
    for level in range(levels):
        rows, bits = dealt(rows, bits, k)
        large = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell)).withColumn("key", F.col("key").bitwiseXOR(F.lit(0).cast("long")))
        if not large.take(1):
            done.append(rows.select("key", "fp"))
            break
        done.append(rows.join(large, "key", "left_anti").select("key", "fp"))
        rows = rows.join(large, "key")
        if level < levels - 1:
            rows = cut(rows.drop("n"))
        else:
            done.append(in_cells(rows, cell).select("key", "fp"))
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def groups_of(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Starts of runs of at most FAN rows that don't cross the given groups."""
    per = -(-counts // FAN)
    first = np.repeat(starts, per)
    nth = np.arange(len(first)) - np.repeat(np.cumsum(per) - per, per)
    return first + nth * FAN


def index_links(fps: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of the same group within k bits: the hierarchical index of Gray-sorted groups, joined with itself.

    `fps` has a row a code and a column for each 64 bits.
    """
    counts = np.diff(np.append(starts, len(fps)))
    levels = [(fps, np.full(fps.shape, ~np.uint64(0)), None, None)]  # value, mask of shared bits, children's start and end
    s, c = starts, counts
    while c.max(initial=0) > 1:
        value, mask = levels[-1][:2]
        run = groups_of(s, c)
        size = np.diff(np.append(run, len(value)))
        first = value[run]
        shared = np.bitwise_and.reduceat(mask & ~(value ^ np.repeat(first, size, axis=0)), run, axis=0)
        levels.append((first & shared, shared, run, run + size))
        per = -(-c // FAN)
        s, c = np.cumsum(per) - per, per
    top = np.arange(len(levels[-1][0]))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    stack = [(len(levels) - 1, top, top)]
    while stack:
        level, i, j = stack.pop()
        if level == 0:
            found.append((i, j))
            continue
        if len(i) > 1 << 14:
            half = len(i) // 2
            stack += [(level, i[:half], j[:half]), (level, i[half:], j[half:])]
            continue
        begin, end = levels[level][2], levels[level][3]
        ni, nj = end[i] - begin[i], end[j] - begin[j]
        pair = np.repeat(np.arange(len(i)), ni * nj)
        nth = np.arange(len(pair)) - np.repeat(np.cumsum(ni * nj) - ni * nj, ni * nj)
        a, b = begin[i][pair] + nth // nj[pair], begin[j][pair] + nth % nj[pair]
        keep = (a < b) if level == 1 else (i[pair] != j[pair]) | (a <= b)
        a, b = a[keep], b[keep]
        value, mask = levels[level - 1][:2]
        near = np.bitwise_count((value[a] ^ value[b]) & mask[a] & mask[b]).sum(axis=1, dtype=np.int64) <= k
        stack.append((level - 1, a[near], b[near]))
    return (np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row linked with each row."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def links(codes: DataFrame, k: int = K, cell: int = CELL) -> DataFrame:
    """(src, dst): a spanning forest, bucket by bucket, of the codes at k bits or fewer."""
    spark = codes.sparkSession
    rows = buckets(codes, k, cell).withColumn("rank", gray_rank(F.col("fp")))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "key").sortWithinPartitions("key", "rank").select("key", "fp")

    def solve(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        a, b = index_links(fps[:, None], starts, k)
        label = forest(len(fps), a, b)
        moved = np.flatnonzero(label != np.arange(len(fps)))
        signed = fps.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(signed[moved]), pa.array(signed[label[moved]])], ["src", "dst"])

    return rows.mapInArrow(lambda batches: whole_groups(batches, lambda column: column.to_numpy(zero_copy_only=False).view(np.uint64), solve), "src long, dst long")


def whole_groups(batches: Iterator[pa.RecordBatch], read, solve) -> Iterator[pa.RecordBatch]:
    """Runs `solve(keys, codes)` on stretches of sorted batches that end with a group; `read` makes codes of the second column."""
    keys, codes = np.zeros(0, np.int64), None
    for batch in batches:
        keys = np.concatenate([keys, batch.column(0).to_numpy(zero_copy_only=False)])
        more = read(batch.column(1))
        codes = more if codes is None else np.concatenate([codes, more])
        if len(keys) >= TREE_ROWS and keys[0] != keys[-1]:
            at = int(np.searchsorted(keys == keys[-1], True))  # the last group may go on
            yield solve(keys[:at], codes[:at])
            keys, codes = keys[at:], codes[at:]
    if len(keys):
        yield solve(keys, codes)


def near_duplicates(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", shingle: int = SHINGLE, k: int = K, seed: int = SEED, cell: int = CELL) -> DataFrame:
    """(id, fp, component_id): each row's fingerprint and the smallest id that links lead to."""
    fps = cut(fingerprints(docs, doc, text, shingle, seed))
    codes = cut(fps.groupBy("fp").agg(F.min("id").alias("smallest")))
    parts = cut(connected_components(cut(links(codes, k, cell))))
    classes = codes.join(parts, codes.fp == parts.node, "left").select("fp", "smallest", F.coalesce("component", "fp").alias("root"))
    smallest = classes.groupBy("root").agg(F.min("smallest").alias("component_id")).select(F.col("root").bitwiseXOR(F.lit(0).cast("long")).alias("root"), "component_id")
    classes = cut(classes.join(smallest, "root").select(F.col("fp").bitwiseXOR(F.lit(0).cast("long")).alias("code"), "component_id"))
    return fps.join(classes, F.col("fp") == F.col("code")).select("id", "fp", "component_id")


MIN_ROWS, MIN_BANDS = 5, 24
#: Rows with a text or a shingle set that a Python worker gets at once.
ROWS_AT_ONCE = 2000


def shingles_of(text: str | None, shingle: int, seed: int) -> np.ndarray:
    """The set of hashes of a text's word shingles, sorted; a text of fewer words is one shingle, a blank one has none."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first, last = np.concatenate(([0], ends[:-1] + 1)), ends[min(shingle, len(words)) - 1 :]
    return np.unique(np.fromiter((digest(line[a:b], seed) for a, b in zip(first.tolist(), last.tolist(), strict=False)), np.uint64, len(last)))


def min_bands(hashes: np.ndarray, factors: np.ndarray) -> list[int]:
    """A key for each band of MIN_ROWS minima; two sets share a band with their Jaccard similarity to the power MIN_ROWS."""
    import xxhash

    if not len(hashes):
        return []
    n = factors.shape[1] // MIN_ROWS
    least = np.full(MIN_ROWS * n, ~np.uint64(0))
    for at in range(0, len(hashes), 256):
        np.minimum(least, (hashes[at : at + 256, None] * factors[0] + factors[1]).min(axis=0), out=least)
    keys = [xxhash.xxh64_intdigest(least[j * MIN_ROWS : (j + 1) * MIN_ROWS].tobytes(), j) for j in range(n)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def alike(common: np.ndarray | int, one: np.ndarray | int, other: np.ndarray | int, similarity: float):
    """Whether sets of these sizes that share so many elements have the similarity."""
    return common + 1e-9 >= similarity * (one + other - common)


def band_recall(similarity: float) -> float:
    """The probability that two sets of this similarity share a band and so are compared."""
    return 1 - (1 - similarity**MIN_ROWS) ** MIN_BANDS


def similar_in_group(loose: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """Links (row, row) of alike sets that join each loose row to every row it is alike to, directly or by others; the other rows are joined already."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, term = np.unique(np.concatenate(sets), return_inverse=True)
    by_term = np.argsort(term, kind="stable")
    docs, ends = owner[by_term], np.cumsum(np.bincount(term))
    begins, at = np.append(0, ends[:-1]), np.append(0, np.cumsum(sizes))
    label = np.where(loose, np.arange(1, len(sets) + 1), 0)
    a, b = [], []
    for i in np.flatnonzero(loose).tolist():
        own, common = term[at[i] : at[i + 1]], np.zeros(len(sets), np.int64)
        for some in np.array_split(own, 1 + (int((ends[own] - begins[own]).sum()) >> 20)):  # about a million postings at once
            counts = ends[some] - begins[some]
            post = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(begins[some], counts)
            common += np.bincount(docs[post], minlength=len(sets))
        for j in np.flatnonzero(alike(common, sizes[i], sizes, similarity) & (label != label[i])).tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                a.append(i)
                b.append(j)
    return a, b


def indexed_pairs(codes: DataFrame, k: int, cell: int = CELL) -> DataFrame:
    """(src, dst): of (code, fp), the pairs that the Gray-order index links at k bits, forests as `links`, and every code with the smallest one of its fingerprint."""
    same = F.lit(0).cast("long")
    heads = cut(codes.groupBy("fp").agg(F.min("code").alias("head")))
    head = lambda of, name: heads.select(F.col("fp").bitwiseXOR(same).alias(of), F.col("head").alias(name))
    equal = codes.join(head("_fp", "src"), F.col("fp") == F.col("_fp")).where("code <> src").select("src", F.col("code").alias("dst"))
    found = cut(links(heads.select("fp"), k, cell))
    apart = found.select(F.col("src").alias("_a"), F.col("dst").alias("_b")).join(head("_x", "src"), F.col("_a") == F.col("_x")).join(head("_y", "dst"), F.col("_b") == F.col("_y"))
    return equal.unionByName(apart.select("src", "dst")).distinct()


def alike_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (src, dst) whose shingle sets have the similarity."""
    code = F.col("code").bitwiseXOR(F.lit(0).cast("long"))
    both = pairs.join(sets.select(code.alias("src"), F.col("shingles").alias("a")), "src").join(sets.select(code.alias("dst"), F.col("shingles").alias("b")), "dst")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                most = min(len(x), len(y))
                keep.append(bool(alike(most, len(x), len(y), similarity) and alike(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), similarity)))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.select("src", "dst", "a", "b").mapInArrow(run, "src long, dst long")


def similar_classes(docs: DataFrame, first: list[Column], *, text: str = "text", similarity: float = 0.8, shingle: int = 5, seed: int = SEED, k: int = K, bands: int = MIN_BANDS, cell: int = CELL) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): `docs` as written, a `row` number and the columns as `doc`; and for each row its `key`, its order (`first`, then its number), and `least`, the smallest key of its class.

    Rows are linked when their sets of word shingles have the Jaccard similarity, by exact comparison; classes are what links lead to. Equal
    sets are one code. Codes are compared when the Gray-order index links their fingerprints at k bits, or share one, and, as 64 bits tell only
    near copies, when they share one of `bands` bands of MIN_ROWS minima of permuted hashes: `band_recall` is 0.9999 at 0.8. A bucket's codes are compared with its smallest code first, which joins groups of near copies by rows in proportion to
    their size; codes that aren't alike to it are then compared with every code of the bucket, large buckets in cells.

    Texts move once, those that are compared with another, to be cut into shingles; Python workers get `ROWS_AT_ONCE` rows at a time.
    """
    spark = docs.sparkSession
    rng = np.random.default_rng(seed)
    factors = rng.integers(0, 1 << 63, (2, MIN_ROWS * bands), np.uint64) * np.uint64(2) + np.uint64(1)
    same = F.lit(0).cast("long")
    # written once, so a row's number is fixed
    rows = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*first).alias("first"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")))
    plain = rows.select("row", "first", F.col("doc").getField(text).alias("text"))

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            codes, fps, keys = [], [], []
            for t in batch.column(2):
                own = shingles_of(t.as_py(), shingle, seed)
                codes.append(xxhash.xxh64_intdigest(own.tobytes()))
                fps.append(majority(own))
                keys.append(min_bands(own, factors))
            signed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (codes, fps)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *signed, pa.array(keys, pa.list_(pa.int64()))], ["row", "first", "code", "fp", "bands"])
        trimmed()

    kind = StructType([*plain.drop("text").schema.fields, StructField("code", LongType()), StructField("fp", LongType()), StructField("bands", ArrayType(LongType()))])

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles_of(t.as_py(), shingle, seed).tobytes() for t in batch.column(1)], pa.binary())], ["code", "shingles"])
        trimmed()

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(group: list) -> pa.RecordBatch:
            unique = list({fp: (loose, own) for fp, loose, own in group}.items())  # a cell may hold a code twice
            fps = [fp for fp, _ in unique]
            a, b = similar_in_group(np.array([x[0] for _, x in unique]), [np.frombuffer(x[1], "<u8") for _, x in unique], similarity)
            return pa.RecordBatch.from_arrays([pa.array([fps[i] for i in a], pa.int64()), pa.array([fps[i] for i in b], pa.int64())], ["src", "dst"])

        now, group = None, []
        for batch in batches:
            for key, fp, loose, own in zip(*batch.columns, strict=True):
                key = key.as_py()
                if group and key != now:
                    yield solve(group)
                    group = []
                now = key
                group.append((fp.as_py(), loose.as_py(), own.as_py()))
        if group:
            yield solve(group)
        trimmed()

    with arrow_rows(spark, ROWS_AT_ONCE):
        keyed = cut(plain.mapInArrow(prints, kind).withColumn("key", F.struct("first", "row")).drop("first"))
        codes = cut(keyed.groupBy("code").agg(F.min("row").alias("row"), F.min("key").alias("key"), F.any_value("fp").alias("fp"), F.any_value("bands").alias("bands")))
        near = cut(indexed_pairs(codes.select("code", "fp"), k, cell))
        banded = codes.select("code", F.posexplode("bands").alias("j", "v")).select("code", F.xxhash64("j", "v").alias("band"))
        shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("code").alias("centre")).where("n > 1")
        met = cut(banded.join(shared.withColumn("band", F.col("band").bitwiseXOR(same)), "band"))

        used = cut(met.select("code").union(near.select("src")).union(near.select("dst")).distinct().join(codes.select("code", "row"), "code").select(F.col("row").alias("_used"), "code"))
        texts = plain.select("row", "text").join(bounded(used), F.col("row") == F.col("_used")).select("code", "text")
        sets = stored(texts.mapInArrow(cut_up, "code long, shingles binary"))
        stars = cut(alike_pairs(met.where("code <> centre").select(F.col("centre").alias("src"), F.col("code").alias("dst")).distinct(), sets, similarity))
        copies = cut(alike_pairs(near, sets, similarity))
        linked = stars.select(F.col("src").alias("centre"), F.col("dst").alias("code"), F.lit(True).alias("linked"))
        parts = cut(met.join(linked, ["centre", "code"], "left").select("band", "code", "n", (F.col("linked").isNull() & (F.col("code") != F.col("centre"))).alias("loose")))
        # of buckets with the same codes one is enough, and in a bucket of two the centre's pair is all
        digest = [F.sum(F.xxhash64("code").cast("decimal(38,0)")).alias("total"), F.bit_xor(F.xxhash64("code", F.lit(1))).alias("mix")]
        open_ = parts.where("n > 2").groupBy("band").agg(F.first("n").alias("m"), F.max("loose").alias("any"), *digest).where("any")
        open_ = open_.groupBy("m", "total", "mix").agg(F.min("band").alias("band")).select(F.col("band").bitwiseXOR(same).alias("band"))
        left = parts.join(open_, "band").select(F.col("band").alias("key"), F.col("code").alias("fp"), "n", "loose")
        small = left.where(F.col("n") <= cell).select("key", "fp", "loose")
        left = small.unionByName(in_cells(left.where(F.col("n") > cell), cell).select("key", "fp", "loose"))
        left = left.join(sets.select(F.col("code").bitwiseXOR(same).alias("fp"), "shingles"), "fp")
        left = left.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key").select("key", "fp", "loose", "shingles")
        linked = cut(copies.unionByName(stars).unionByName(left.mapInArrow(compared, "src long, dst long")))
    parts = cut(connected_components(linked))
    classes = codes.join(parts, codes.code == parts.node, "left").select("code", "key", F.coalesce("component", "code").alias("root"))
    least = classes.groupBy("root").agg(F.min("key").alias("least")).withColumn("root", F.col("root").bitwiseXOR(same))
    classes = cut(classes.join(least, "root").select(F.col("code").bitwiseXOR(same).alias("_of"), "least"))
    return rows, keyed.join(classes, F.col("code") == F.col("_of")).select("row", "key", "least")


def deduplicated(docs: DataFrame, first: list[Column], **how) -> DataFrame:
    """The row of `docs` with the smallest key of each class, with all its columns."""
    rows, classes = similar_classes(docs, first, **how)
    kept = cut(classes.where("key = least").select(F.col("row").alias("_kept")))
    return rows.join(bounded(kept), F.col("row") == F.col("_kept")).select("doc.*")


def similar_documents(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", similarity: float = 0.8, shingle: int = 5, seed: int = SEED, k: int = K, bands: int = MIN_BANDS, cell: int = CELL) -> DataFrame:
    """(id, component_id) at a Jaccard similarity of word shingles that 64 bits can't tell apart: a row a row, the smallest id of its class."""
    order = [F.col(doc).isNull().alias("none"), F.col(doc).alias("id")]
    _, classes = similar_classes(docs.select(doc, text), order, text=text, similarity=similarity, shingle=shingle, seed=seed, k=k, bands=bands, cell=cell)
    return classes.select(F.col("key.first.id").alias("id"), F.col("least.first.id").alias("component_id"))
