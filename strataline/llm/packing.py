"""Packing token sequences into windows by minimum bin slack.

Each document is cut into full windows and one tail. Tails enter the plan only as a histogram of lengths, which has at most window - 1
entries at any scale: around the longest length left, a bitset subset-sum picks the multiset of lengths that fills a window closest to
capacity, the counts are backtracked, and the pattern is used as often as the histogram allows. Where the closest fill leaves more than
`max_slack`, the rest of the window is cut from the front of the longest tail that is longer than that, and what remains of this tail is a
tail of the shorter length, so every window goes through the same choice and only the last ones, with nothing left to cut, are
padded by more. Tails are ranked within their length and find their pieces' bins and offsets from the pattern table by arithmetic.

Defined results: null and empty texts are the single end token; repeated rows are packed one by one; very long texts give many full
windows; an empty table gives an empty result; a text that holds a special token's string gets that token, as the tokenizer does by
default. Tails rank by a hash of doc_id and their checksum, and rows equal in both are interchangeable.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.plans.ordering import even_buckets, running, unit_hash
from strataline.session import arrow_rows, cut, trimmed

WINDOW, MAX_SLACK = 1024, 8
END_ID = 0
#: Texts that a Python worker gets at once.
ROWS_AT_ONCE = 500


def default_tokenizer() -> tuple[str, str]:
    """(tokenizers file, the same vocabulary as ranks) of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(json_path: str, ranks_path: str | None = None):
    """text -> uint32 ids, those of the tokenizers file without special tokens added.

    With a ranks file of the same vocabulary, texts of Latin-1 characters take the faster library, whose ids are the same; texts with other
    characters, whose classes may differ between the libraries' Unicode versions, or with a special token's string, take the file's own.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(json_path)
    if slow.to_str().find('"ByteLevel"') < 0 or ranks_path is None:
        return lambda text: np.asarray(slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
    import base64

    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    import public_tokenizers

    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    special = [t.content for t in slow.get_added_tokens_decoder().values()]

    def encode(text: str) -> np.ndarray:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            plain = False
        else:
            plain = not any(s in text for s in special)
        return fast.encode_to_numpy(text) if plain else np.asarray(slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    return encode


def tokenised(docs: DataFrame, doc: str, text: str, window: int, paths: tuple[str, str | None]) -> DataFrame:
    """(doc_id, doc_tokens, full_crcs, tail): checksums of the full windows and the ids of the tail as bytes."""
    kind = docs.schema[doc].dataType.simpleString()

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trimmed()
        encode = encoder(*paths)
        end = np.array([END_ID], dtype=np.uint32)
        for batch in batches:
            n, crcs, tails = [], [], []
            for value in batch.column(1):
                ids = np.concatenate([encode(value.as_py() or ""), end]).astype("<u4")
                raw, full = ids.tobytes(), len(ids) // window
                n.append(len(ids))
                crcs.append([zlib.crc32(raw[4 * window * k : 4 * window * (k + 1)]) for k in range(full)])
                tails.append(ids[full * window :].astype("<u2" if len(ids) and ids.max() < 65536 else "<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(tails, pa.binary())], ["doc_id", "doc_tokens", "full_crcs", "tail"])
        del encode
        trimmed()

    return docs.select(doc, text).mapInArrow(cut_up, f"doc_id {kind}, doc_tokens long, full_crcs array<long>, tail binary")


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of at most counts[length] of each length whose sum comes closest to `room` from below."""
    parts, reach = [], [1]
    mask = (1 << (room + 1)) - 1
    for length in sorted(counts, reverse=True):
        left, step = min(counts[length], room // length), 1
        while left > 0:
            take = min(step, left)
            parts.append((length, take))
            reach.append(reach[-1] | (reach[-1] << (length * take)) & mask)
            left, step = left - take, step * 2
        if reach[-1] >> room & 1:
            break
    at, used = reach[-1].bit_length() - 1, {}
    for k in range(len(parts), 0, -1):
        if not reach[k - 1] >> at & 1:
            length, take = parts[k - 1]
            used[length] = used.get(length, 0) + take
            at -= length * take
    return used


class Uses(list):
    """Rows (tail, rank_from, rank_to, start, length, copies, nth, offset, first_bin): of the tails `tail` long, each of these ranks has the
    ids from `start` on, `length` of them, in bin first_bin + j // copies at offset + (j % copies) x length, where j is nth + rank - rank_from."""


def plan_bins(histogram: dict[int, int], window: int = WINDOW, max_slack: int = MAX_SLACK) -> tuple[Uses, int]:
    """(uses, bins). A pattern holds the longest length left; each pattern is used until one of its lengths can't serve it again."""
    left: dict[int, int] = {k: v for k, v in histogram.items() if v > 0 and 0 < k < window}
    lines: dict[int, deque] = {k: deque([(k, 0, v, 0)]) for k, v in left.items()}  # runs of tails of a length: tail, rank, how many, start
    uses, bins = Uses(), 0

    def give(length: int, copies: int, times: int, offset: int, taken: int) -> None:
        """Put the next copies x times tails of a length into `times` bins, `taken` ids of each; what is left of them is a shorter tail."""
        nth, need = 0, copies * times
        left[length] -= need
        while nth < need:
            tail, rank, n, start = lines[length].popleft()
            if n > need - nth:
                lines[length].appendleft((tail, rank + need - nth, n - (need - nth), start))
                n = need - nth
            uses.append((tail, rank, rank + n, start, taken, copies, nth, offset, bins))
            if taken < length:
                lines.setdefault(length - taken, deque()).append((tail, rank, n, start + taken))
                left[length - taken] = left.get(length - taken, 0) + n
            nth += n
        if not left[length]:
            del left[length]

    while left:
        longest = max(left)
        pool = {k: v - (k == longest) for k, v in left.items() if k <= window - longest and v > (k == longest)}
        fill = best_fill(pool, window - longest)
        fill[longest] = fill.get(longest, 0) + 1
        times, offset = min(left[k] // v for k, v in fill.items()), 0
        slack = window - sum(k * v for k, v in fill.items())
        donor = 0
        if slack > max_slack:
            donor = max((k for k, v in left.items() if k > slack and v > fill.get(k, 0)), default=0)
            if donor:
                times = min(left[k] // (fill.get(k, 0) + (k == donor)) for k in {*fill, donor})
        for length in sorted(fill, reverse=True):
            give(length, fill[length], times, offset, length)
            offset += length * fill[length]
        if donor:
            give(donor, 1, times, offset, slack)
        bins += times
    return uses, bins


def packed(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", window: int = WINDOW, max_slack: int = MAX_SLACK, tokenizer: tuple[str, str | None] | None = None, with_ids: bool = False) -> DataFrame:
    """A row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with `with_ids` the tails' ids too."""
    spark = docs.sparkSession
    with arrow_rows(spark, ROWS_AT_ONCE):
        rows = cut(tokenised(docs, doc, text, window, tokenizer or default_tokenizer()))
    n = rows.count()
    slim = rows.withColumns({"tail_length": F.col("doc_tokens") % window, "n_full": F.size("full_crcs").cast("long"), "unit": unit_hash(F.col("doc_id"), F.lit("pack"))})
    slim = slim.withColumn("bucket", even_buckets(F.col("unit"), n)).withColumn("tail_crc", F.crc32("tail"))
    order = [F.col("unit"), F.col("doc_id"), F.col("tail_crc")]

    histogram = {r["tail_length"]: r["n"] for r in slim.where("tail_length > 0").groupBy("tail_length").agg(F.count(F.lit(1)).alias("n")).collect()}
    uses, bins = plan_bins(histogram, window, max_slack)

    # at most window - 1 lengths, each with the few patterns that hold it: bounded by the plan, not by the rows
    table = spark.createDataFrame(list(uses) or [(0,) * 9], "tail long, rank_from long, rank_to long, start long, length long, copies long, nth long, use_offset long, first_bin long")
    by_length = table.groupBy(F.col("tail").alias("use_length")).agg(F.collect_list(F.struct("rank_from", "rank_to", "start", "length", "copies", "nth", "use_offset", "first_bin")).alias("uses"))
    tails = running(slim.where("tail_length > 0").select("doc_id", "doc_tokens", "tail", "tail_length", "unit", "bucket", "tail_crc"), ["tail_length"], "bucket", order, rank="r")
    tails = tails.join(F.broadcast(by_length), F.col("tail_length") == F.col("use_length"))
    width = F.floor(F.length("tail") / F.col("tail_length")).cast("int")
    tails = tails.select("doc_id", "doc_tokens", "tail_length", "tail", "r", width.alias("width"), F.explode(F.filter("uses", lambda u: (u["rank_from"] <= F.col("r")) & (F.col("r") < u["rank_to"]))).alias("p"))
    j = F.col("p.nth") + F.col("r") - F.col("p.rank_from")
    ids = F.substring(F.col("tail"), (F.col("p.start") * F.col("width") + 1).cast("int"), (F.col("p.length") * F.col("width")).cast("int"))
    tails = tails.withColumns({"sequence_id": (F.col("p.first_bin") + F.floor(j / F.col("p.copies"))).cast("long"), "offset": (F.col("p.use_offset") + (j % F.col("p.copies")) * F.col("p.length")).cast("long"), "piece": ids})
    wide = F.when(F.col("width") == 4, F.col("piece")).otherwise(F.unhex(F.regexp_replace(F.hex("piece"), "(....)", "$10000")))
    tails = tails.select("doc_id", (F.col("doc_tokens") - F.col("tail_length") + F.col("p.start")).alias("start"), F.col("p.length").alias("length"), F.crc32(wide).alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", *([wide.alias("ids")] if with_ids else []))

    full = slim.where("n_full > 0").select("doc_id", "doc_tokens", "full_crcs", "n_full", "unit", "bucket", "tail_crc")
    full = running(full, [], "bucket", order, F.col("n_full"), rank="r").select("doc_id", "doc_tokens", "before", F.posexplode("full_crcs").alias("k", "ids_crc32"))
    full = full.select("doc_id", (F.col("k") * window).cast("long").alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.lit(bins) + F.col("before") + F.col("k")).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *([F.lit(None).cast("binary").alias("ids")] if with_ids else []))
    return full.unionByName(tails)
