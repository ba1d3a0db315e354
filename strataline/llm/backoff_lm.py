"""Stupid-backoff scores of every document from n-gram counts over the whole corpus.

S(w | u) is c(u w) / c(u) if c(u w) >= `MIN_PAIR`, else `BACKOFF` x c(w) / N; the first word of a text has c(w) / N. A document's score is
the sum of natural logarithms over its words.

The counts are a table partitioned by n-gram hash. Documents are read once, in chunks of `CHUNK_WORDS` words; a chunk's exploded n-grams are
aggregated before they move and travel as packed columns, one row a chunk, order and hash bucket, sorted by hash. In a bucket the rows of all
chunks are merged into the count table and joined back with each chunk's n-grams; the counts return to the chunk, where its words are scored
and summed by document. So no n-gram, however frequent, is more than one entry a chunk, and what is gathered grows with the input. There are as
many buckets as keep one to about `BUCKET_CHARS` characters of text, and a text longer than a chunk goes on in the next, with the last word before it
as context, so a task's share grows with neither the corpus nor a text.

Words are runs of characters other than ASCII white space. N-grams are told apart by 64-bit hashes. Defined results: null and empty texts
have 0 words, score 0 and a null mean; repeated rows are scored alike and count each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.session import cut

BACKOFF, MIN_PAIR, CHUNK_WORDS = 0.4, 2, 500_000
#: Characters of text whose n-grams make one hash bucket: some 8 MB as they travel.
BUCKET_CHARS = 8_000_000
WORDS, PAIRS, LAYOUT = 0, 1, 2


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    h = first * np.uint64(0x9E3779B97F4A7C15) + (second ^ (second >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def squeezed(a: np.ndarray) -> bytes:
    """Whole numbers as planes of equal byte places, compressed; for sorted ones take differences first."""
    planes = np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return len(a).to_bytes(4, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def widened(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:4], "little")
    planes = np.frombuffer(pa.decompress(b[4:], 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def differences(a: np.ndarray) -> np.ndarray:
    return np.diff(a, prepend=np.uint64(0))


def pairs_of(words: np.ndarray, lengths: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, places): first x kinds + second for every two neighbours of one document, and the place of the second."""
    inner = np.ones(len(words), bool)
    starts = np.cumsum(lengths) - lengths
    inner[starts[lengths > 0]] = False
    places = np.flatnonzero(inner)
    return words[places - 1].astype(np.uint64) * np.uint64(kinds) + words[places], places


def message_schema(kind: str) -> str:
    return f"key long, kind int, chunk long, bucket int, hashes binary, counts binary, ids array<{kind}>, parts array<long>"


def contexts(lengths: np.ndarray, goes_on: np.ndarray) -> np.ndarray:
    """The places of first words that only give context: those of pieces that go on with a text."""
    return (np.cumsum(lengths) - lengths)[goes_on.astype(bool)]


def chunked(docs: DataFrame, doc: str, text: str, bits: int, chunk_words: int) -> DataFrame:
    """A chunk's messages: its distinct words and pairs by hash bucket, and its layout (documents, lengths, words as numbers).

    `parts` numbers the text that a piece is of, null for whole texts; twice a length, plus one where the piece goes on with a text, is in the layout.
    """
    import xxhash

    kind = docs.schema[doc].dataType.simpleString()
    schema = pa.schema([("key", pa.int64()), ("kind", pa.int32()), ("chunk", pa.int64()), ("bucket", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])
    shift = np.uint64(64 - bits)

    def messages(chunk: int, ids: list, parts: list, goes_on: list[bool], words: list[bytes], lengths: list[int]) -> pa.RecordBatch:
        vocabulary: dict[bytes, int] = {}
        at = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words), np.int64, len(words))
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in vocabulary), np.uint64, len(vocabulary))
        order = np.argsort(hashes, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        hashes, at = hashes[order], place[at]
        lengths_ = np.array(lengths, np.int64)
        codes, _ = pairs_of(at, lengths_, max(1, len(hashes)))
        codes, pair_counts = np.unique(codes, return_counts=True)
        kinds = np.uint64(max(1, len(hashes)))
        pair_hashes = pair_hash(hashes[(codes // kinds).astype(np.int64)], hashes[(codes % kinds).astype(np.int64)])
        by_hash = np.argsort(pair_hashes, kind="stable")
        rows: dict[str, list] = {n: [] for n in schema.names}
        goes_on_ = np.array(goes_on, np.int64)
        word_counts = np.bincount(at, minlength=len(hashes)) - np.bincount(at[contexts(lengths_, goes_on_)], minlength=len(hashes))
        for what, h, c in ((WORDS, hashes, word_counts), (PAIRS, pair_hashes[by_hash], pair_counts[by_hash])):
            buckets = (h >> shift).astype(np.int64)
            cuts = np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1])) if len(h) else np.zeros(0, np.int64)
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(h)], strict=False):
                for name, value in zip(schema.names, (int(buckets[a]), what, chunk, int(buckets[a]), squeezed(differences(h[a:b])), squeezed(c[a:b])), strict=True):
                    rows[name].append(value)
        for name, value in zip(schema.names, (~chunk, LAYOUT, chunk, 0, squeezed(at), squeezed(2 * lengths_ + goes_on_)), strict=True):
            rows[name].append(value)
        n = len(rows["key"])
        offsets = pa.array([0] * n + [len(ids)], pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.concat_arrays(ids)), pa.ListArray.from_arrays(offsets, pa.array(parts, pa.int64()))]
        return pa.RecordBatch.from_arrays([*[pa.array(rows[f.name], f.type) for f in schema], *lists], [*schema.names, "ids", "parts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, serial = TaskContext.get().partitionId() << 32, 0, 0
        ids, parts, goes_on, words, lengths = [], [], [], [], []
        for batch in batches:
            for row, t in enumerate(batch.column(1)):
                own, at = (t.as_py() or "").encode("utf-8", "surrogatepass").split(), 0
                part = None if len(own) <= chunk_words else task + serial
                serial += 1
                while at < len(own) or at == 0:
                    begin = at - (at > 0)
                    piece = own[begin : at + chunk_words]
                    ids.append(batch.column(0).slice(row, 1))
                    parts.append(part)
                    goes_on.append(at > 0)
                    words += piece
                    lengths.append(len(piece))
                    at += chunk_words
                    if len(words) >= chunk_words:
                        yield messages(task + n, ids, parts, goes_on, words, lengths)
                        ids, parts, goes_on, words, lengths, n = [], [], [], [], [], n + 1
        if lengths:
            yield messages(task + n, ids, parts, goes_on, words, lengths)

    return docs.select(doc, text).mapInArrow(run, message_schema(kind))


def joined(bucket: pa.Table) -> pa.Table:
    """One hash bucket: the rows of all chunks become counts over the corpus and go back to their chunks. Layouts pass."""
    if bucket.num_rows and bucket["kind"][0].as_py() == LAYOUT:
        return bucket.set_column(0, "key", bucket["chunk"])
    counts: list[bytes] = [b""] * bucket.num_rows
    kinds = bucket["kind"].to_numpy()
    for what in (WORDS, PAIRS):
        rows = np.flatnonzero(kinds == what)
        if len(rows):
            hashes = [np.cumsum(widened(bucket["hashes"][int(r)].as_py()), dtype=np.uint64) for r in rows]
            own = np.concatenate([widened(bucket["counts"][int(r)].as_py()) for r in rows])
            _, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
            total = np.bincount(inverse, weights=own)[inverse]
            at = 0
            for r, h in zip(rows, hashes, strict=True):
                counts[r] = squeezed(total[at : at + len(h)])
                at += len(h)
    echoed = [bucket["hashes"][i].as_py() if kinds[i] == WORDS else None for i in range(bucket.num_rows)]
    out = bucket.set_column(0, "key", bucket["chunk"]).set_column(4, "hashes", pa.array(echoed, pa.binary()))
    return out.set_column(5, "counts", pa.array(counts, pa.binary()))


def scores_of(min_pair: int, backoff: float):
    def run(chunk: pa.Table) -> pa.Table:
        kinds, buckets = chunk["kind"].to_numpy(), chunk["bucket"].to_numpy()
        rows = lambda what: [int(r) for r in np.lexsort((buckets, kinds != what))[: int((kinds == what).sum())]]
        read = {"hashes": lambda b: np.cumsum(widened(b), dtype=np.uint64), "counts": widened}
        gathered = lambda what, name: np.concatenate([read[name](chunk[name][r].as_py()) for r in rows(what)] or [np.zeros(0, np.uint64)])
        layout = rows(LAYOUT)[0]
        at = widened(chunk["hashes"][layout].as_py()).astype(np.int64)
        lengths = widened(chunk["counts"][layout].as_py()).astype(np.int64)
        lengths, goes_on = lengths // 2, lengths % 2
        hashes, word_counts = gathered(WORDS, "hashes"), gathered(WORDS, "counts").astype(np.float64)
        kinds_n = np.uint64(max(1, len(hashes)))
        codes, places = pairs_of(at, lengths, int(kinds_n))
        distinct, inverse = np.unique(codes, return_inverse=True)
        order = np.argsort(pair_hash(hashes[(distinct // kinds_n).astype(np.int64)], hashes[(distinct % kinds_n).astype(np.int64)]), kind="stable")
        pair_counts = np.empty(len(distinct))
        pair_counts[order] = gathered(PAIRS, "counts")
        context = contexts(lengths, goes_on)
        value = np.log(np.maximum(word_counts[at], 1))
        alone = np.ones(len(at), bool)  # words scored without context: they still lack log N
        seen = pair_counts[inverse]
        known = seen >= min_pair
        value[places] += np.log(backoff)
        value[places[known]] = np.log(seen[known]) - np.log(word_counts[at[places[known] - 1]])
        alone[places[known]] = False
        value[context], alone[context] = 0.0, False
        filled = lengths > 0
        starts = (np.cumsum(lengths) - lengths)[filled]

        def sums(v: np.ndarray) -> np.ndarray:
            out = np.zeros(len(lengths))
            if len(starts):
                out[filled] = np.add.reduceat(v, starts)
            return out

        def held(name: str) -> pa.Array:
            column = chunk[name].combine_chunks()
            return (column.chunk(0) if isinstance(column, pa.ChunkedArray) else column)[layout].values

        return pa.table({"doc_id": held("ids"), "part": held("parts"), "n_words": pa.array(lengths - goes_on), "raw": pa.array(sums(value)), "n_alone": pa.array(sums(alone.astype(float)).astype(np.int64))})

    return run


def scored(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", min_pair: int = MIN_PAIR, backoff: float = BACKOFF, chunk_words: int = CHUNK_WORDS, bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """doc_id, n_words, n_backoff (words scored by their own count), log_score and mean_log for every row."""
    spark = docs.sparkSession
    kind = docs.schema[doc].dataType.simpleString()
    chars = docs.agg(F.sum(F.length(text).cast("long"))).first()[0] or 0
    bits = min(24, max(4, (chars // bucket_chars).bit_length()))
    messages = chunked(docs, doc, text, bits, chunk_words)
    counted = messages.groupBy("key").applyInArrow(joined, message_schema(kind))
    rows = cut(counted.groupBy("chunk").applyInArrow(scores_of(min_pair, backoff), f"doc_id {kind}, part long, n_words long, raw double, n_alone long"))
    sums = [F.sum(c).alias(c) for c in ("n_words", "raw", "n_alone")]
    pieces = rows.where(F.col("part").isNotNull()).groupBy("part").agg(F.first("doc_id").alias("doc_id"), *sums).drop("part")
    rows = rows.where(F.col("part").isNull()).drop("part").unionByName(pieces)
    total = rows.agg(F.sum("n_words")).first()[0] or 1
    score = F.col("raw") - F.col("n_alone") * F.log(F.lit(float(total)))
    return rows.select("doc_id", "n_words", F.col("n_alone").alias("n_backoff"), score.alias("log_score"), F.when(F.col("n_words") > 0, score / F.col("n_words")).alias("mean_log"))
