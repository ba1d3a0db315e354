"""Quality by nearest-neighbour voting in a latent-semantic space.

A text's terms are its hashed words, trigrams of character classes (runs of small letters count once, so the layout of any language looks alike)
and a few measures of repetition. Latent vectors come from a truncated SVD of the labelled sample's weighted terms. The sample's vectors
and labels, at most `SAMPLE` rows of `RANK` numbers, are broadcast; every document is compared with all of them by blocked cosine products, and
the labels of its `NEIGHBOURS` nearest are averaged by similarity.

The sample is the `SAMPLE` labelled documents outside the held-out fold whose hashed ids come first; it is the only bound, every document is
scored. Of rows of one id the sample has one, the text of smallest hash, and of an id's labels the smallest. Defined results: null and empty texts
are scored like any text, from no terms; without labelled rows every score is 0.5; null labels are left out; labelled documents as near as
the last of the nearest all vote; repeated rows are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.llm.vectors import dense, fold, one_text, sample_order, sparse_features, unit_rows

SAMPLE, RANK, NEIGHBOURS, SHARPNESS = 6000, 48, 24, 24.0
FOLDS, THRESHOLD = 5, 0.3
HASHED, CLASS_TERMS, BLOCK = 2048, 4096, 256
WIDTH = CLASS_TERMS + 8 + HASHED
#: Weight of a text's words beside its layout.
WORD_WEIGHT = 0.5


def _classes() -> np.ndarray:
    table = np.full(256, 15, np.uint16)
    for k, chars in enumerate((" \t\r\x0b\x0c", "\n", "", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,", "!", "?", "|", "#*$%&", "<>", "-_", "@/:", "'\"()[]{}")):
        for ch in chars:
            table[ord(ch)] = k
    table[128:] = 3
    return table


CLASSES = _classes()


def terms(text: str | None) -> np.ndarray:
    """The text's weighted terms, before the corpus weights: root shares of class trigrams, of repetition and of hashed words."""
    raw = (text or "").encode("utf-8", "replace")
    out = np.zeros(WIDTH, np.float32)
    words = raw.split()
    if not words:
        return out
    c = CLASSES[np.frombuffer(raw, np.uint8)]
    c = c[np.append(True, (c[1:] != c[:-1]) | (c[1:] != 3))].astype(np.uint32)
    if len(c) > 2:
        counts = np.bincount((c[:-2] << 8) | (c[1:-1] << 4) | c[2:], minlength=CLASS_TERMS)
        out[:CLASS_TERMS] = np.sqrt(counts / (len(c) - 2))
    n, lines = len(words), [x for x in raw.split(b"\n") if x.strip()]
    kinds = Counter(words)
    shares = (
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        1 - len(kinds) / n,
        max(kinds.values()) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        1 - len(set(zip(words, words[1:], words[2:], strict=False))) / max(1, n - 2),
        sum(w.isupper() for w in words) / n,
        1 / n,
        min(1.0, sum(map(len, words)) / n / 20),
    )
    out[CLASS_TERMS : CLASS_TERMS + 8] = np.sqrt(np.clip(shares, 0, 1))
    places = np.fromiter(map(crc32, kinds), np.uint32, len(kinds)) % HASHED
    out[CLASS_TERMS + 8 :] = WORD_WEIGHT * np.sqrt(np.bincount(places, np.fromiter(kinds.values(), np.float64, len(kinds)), HASHED) / n)
    return out


class Voter:
    """What is broadcast: term weights folded into the projection, the labelled vectors and their labels."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, rank: int = RANK, seed: int = 7):
        n = len(x)
        self.labels = labels.astype(np.float32)
        if not n:
            self.projection = self.vectors = np.zeros((0, 0), np.float32)
            return
        df = (x > 0).sum(axis=0)
        weight = np.where(df >= min(3, n), np.log((1 + n) / (1 + df)) + 1, 0).astype(np.float32)
        x = np.multiply(x, weight, out=x)  # in place: the sample is the largest thing on the driver
        rank = min(rank, n, WIDTH)
        q = np.random.default_rng(seed).standard_normal((WIDTH, rank + 8)).astype(np.float32)
        for _ in range(6):
            q, _ = np.linalg.qr(x.T @ (x @ q))
        _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
        axes = (q @ vt.T[:, :rank]).astype(np.float32)
        self.vectors = unit_rows(x @ axes).astype(np.float32)
        self.projection = weight[:, None] * axes

    def score(self, x: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        if not len(self.vectors):
            return np.full(len(x), 0.5)
        near = unit_rows(x @ self.projection) @ self.vectors.T
        k = min(neighbours, near.shape[1])
        last = np.partition(near, -k, axis=1)[:, -k]
        row, at = np.nonzero(near >= last[:, None])  # more than k where the last is tied
        sims = near[row, at].astype(np.float64)
        votes = np.exp(SHARPNESS * (sims - near.max(axis=1)[row]))
        return np.clip(np.bincount(row, votes * self.labels[at], len(x)) / np.bincount(row, votes, len(x)), 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, *, doc: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Voter:
    chosen = labels.where(F.col(label).isNotNull() & F.col(doc).isNotNull() & (fold(F.col(doc), FOLDS) != 0)).select(F.col(doc).alias("_id"), F.col(label).alias("_label"))
    chosen = chosen.groupBy("_id").agg(F.min("_label").alias("_label")).orderBy(*sample_order(F.col("_id"))).limit(sample)
    rows = one_text(docs.select(F.col(doc).alias("_doc"), F.col(text).alias(text)).join(F.broadcast(chosen), F.col("_doc") == F.col("_id")), ["_id", "_label"], text)  # at most `sample` rows
    at, values, y = sparse_features(rows, text, "_label", terms)
    return Voter(dense(at, values, WIDTH), np.array(y, np.float32))


def scored(docs: DataFrame, labels: DataFrame, *, doc: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, threshold: float = THRESHOLD, keep: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; with `keep` every column of `docs` and `score`, named `_score`."""
    voter = docs.sparkSession.sparkContext.broadcast(vars(fit(docs, labels, doc=doc, text=text, label=label, sample=sample)))  # plain arrays
    columns = docs.columns if keep else [doc, text]
    place = columns.index(text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema if keep or f.name == doc)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Voter.__new__(Voter)
        vars(model).update(voter.value)
        for batch in batches:
            column, scores = batch.column(place), np.zeros(batch.num_rows)
            for at in range(0, batch.num_rows, BLOCK):
                part = column.slice(at, BLOCK)
                scores[at : at + len(part)] = model.score(np.stack([terms(t.as_py()) for t in part]))
            kept = [batch.column(i) for i in range(batch.num_columns) if keep or i != place]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(scores)], [*[c for c in columns if keep or c != text], "_score"])

    out = docs.select(*columns).mapInArrow(run, f"{schema}, _score double")
    if keep:
        return out
    return out.select(F.col(doc).alias("doc_id"), (fold(F.col(doc), FOLDS) == 0).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))
