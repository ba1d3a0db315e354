"""Language by hierarchical discrimination: first the family, then one-versus-one linear SVMs within it.

Texts are hashed trigrams of their lower-cased letters. Families are a fixed table of language codes; codes outside it join the family whose
mean vector is closest. Families are told apart one versus one as well, and so are a family's languages. All machines are squared-hinge
linear SVMs fitted here on a bounded sample: at most `PER_LANGUAGE` documents a language, those whose hashed ids come first, and `SAMPLE` in all, every
language's first before any's second. Of rows of one id and language the sample has one. Between equal shares the family, then the language,
that comes first in sorted order is predicted.

Defined results: null texts and texts without a letter are `und` with score 0; with nothing to learn from, every text is; one learned
language is predicted with score 1; repeated rows get the same prediction; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataline.llm.vectors import dense, fold, one_text, sample_order, sparse_features, unit_rows

PER_LANGUAGE, SAMPLE, WIDTH, BLOCK = 1000, 12000, 4096, 256  # up to 1000, Spark ranks a language's rows before they move
FOLDS, HELD_OUT = 4, 2
# fixed values: ISO 639-1 codes by family
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
}

_KEEP = np.full(256, 32, np.uint8)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def grams(text: str | None) -> np.ndarray:
    """Root counts of hashed letter trigrams, as a unit vector; runs of other characters are one blank."""
    out = np.zeros(WIDTH, np.float32)
    b = _KEEP[np.frombuffer((" " + (text or "").lower() + " ").encode("utf-8", "replace"), np.uint8)]
    b = b[np.append(True, (b[1:] != 32) | (b[:-1] != 32))].astype(np.uint32)
    if len(b) < 3:
        return out
    h = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)
    counts = np.sqrt(np.bincount((h ^ (h >> np.uint32(15))) & np.uint32(WIDTH - 1), minlength=WIDTH))
    return (counts / np.linalg.norm(counts)).astype(np.float32)


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 30.0, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Weights and bias for labels -1 and 1: squared hinge with both classes weighted alike, by accelerated gradient steps."""
    n = len(x)
    weight = np.where(y > 0, n / (2 * max(1, (y > 0).sum())), n / (2 * max(1, (y < 0).sum()))) / n
    weight, y = weight.astype(np.float32), y.astype(np.float32)
    xb = np.hstack([x, np.ones((n, 1), np.float32)])
    step = np.float32(1.0 / (1.0 + 2 * c * float((weight * np.einsum("ij,ij->i", xb, xb)).sum())))
    w, v = np.zeros(xb.shape[1], np.float32), np.zeros(xb.shape[1], np.float32)
    for k in range(rounds):
        gap = np.maximum(0, 1 - y * (xb @ v))
        grad = v - 2 * np.float32(c) * ((weight * y * gap) @ xb)
        grad[-1] -= v[-1]
        new = v - step * grad
        v, w = new + np.float32(k / (k + 3)) * (new - w), new
    return w[:-1].astype(np.float32), float(w[-1])


class Tree:
    """Families, their languages and the machines between each two."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        y = np.array(langs)
        known = {code: family for family, codes in FAMILIES.items() for code in codes}
        means = {g: unit_rows(x[y == g].mean(axis=0, keepdims=True))[0] for g in self.langs}
        families: dict[str, list[str]] = {}
        for g in self.langs:
            if g in known:
                families.setdefault(known[g], []).append(g)
        for g in self.langs:
            if g not in known:
                near = max(families, key=lambda f: max(float(means[g] @ means[m]) for m in families[f] if m in known), default="other")
                families.setdefault(near, []).append(g)
        self.families = [families[f] for f in sorted(families)]
        groups = [np.isin(y, f) for f in self.families]
        self.machines: list[tuple[int, int, int]] = []  # (-1 or the family, first, second)
        weights, biases = [], []

        def add(level: int, i: int, j: int, first: np.ndarray, second: np.ndarray) -> None:
            rows = first | second
            w, b = linear_svm(x[rows], np.where(first[rows], 1.0, -1.0))
            self.machines.append((level, i, j))
            weights.append(w)
            biases.append(b)

        for i, j in combinations(range(len(self.families)), 2):
            add(-1, i, j, groups[i], groups[j])
        for f, members in enumerate(self.families):
            for i, j in combinations(range(len(members)), 2):
                add(f, i, j, y == members[i], y == members[j])
        self.weights = np.stack(weights, axis=1) if weights else np.zeros((WIDTH, 0), np.float32)
        self.biases = np.array(biases, np.float32)

    def _coupled(self, margins: np.ndarray, level: int, n: int) -> np.ndarray:
        """Shares of n classes from their pairwise margins."""
        p = np.ones((len(margins), n))
        for k, (at, i, j) in enumerate(self.machines):
            if at == level:
                win = 1 / (1 + np.exp(-np.clip(4 * margins[:, k], -30, 30)))
                p[:, i] *= win
                p[:, j] *= 1 - win
        return p / np.maximum(p.sum(axis=1, keepdims=True), 1e-300)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        margins = (x @ self.weights + self.biases).astype(np.float64)
        by_family = self._coupled(margins, -1, len(self.families))
        family = by_family.argmax(axis=1)
        names, scores = [""] * len(x), np.zeros(len(x))
        for f, members in enumerate(self.families):
            rows = np.flatnonzero(family == f)
            if len(rows):
                p = self._coupled(margins[rows], f, len(members))
                best = p.argmax(axis=1)
                for r, b in zip(rows, best, strict=True):
                    names[r] = members[b]
                scores[rows] = by_family[rows, f] * p[np.arange(len(rows)), best]
        return names, np.clip(scores, 0.0, 1.0)


def fit(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, sample: int = SAMPLE) -> Tree | None:
    rows = docs.select(F.col(doc).alias("_id"), F.col(text).alias("_text"), F.col(lang).alias("_lang"))
    rows = rows.where(F.col("_lang").isNotNull() & F.col("_text").isNotNull() & (fold(F.col("_id"), FOLDS) != HELD_OUT))
    first = Window.partitionBy("_lang").orderBy(*sample_order(F.col("_id")))
    # only about three times as many ids of a language as are needed go to its task: those of smallest hash
    counts = rows.groupBy("_lang").agg(F.approx_count_distinct("_id").alias("_n")).select(F.col("_lang").alias("_of"), ((3.0 * per_language + 50) / F.col("_n")).alias("_share"))
    hashed = F.shiftrightunsigned(sample_order(F.col("_id"))[0].bitwiseXOR(F.lit(-(1 << 63)).cast("long")), 11) / F.lit(float(1 << 53))
    few = rows.select("_id", "_lang").join(counts, F.col("_lang") == F.col("_of")).where(hashed < F.col("_share")).select("_id", "_lang").distinct()
    ids = few.withColumn("_nth", F.row_number().over(first)).where(F.col("_nth") <= per_language)
    ids = ids.orderBy("_nth", *sample_order(F.col("_id")), "_lang").limit(sample).select(F.col("_id").alias("_chosen"), F.col("_lang").alias("_as"))
    chosen = rows.join(F.broadcast(ids), (F.col("_id") == F.col("_chosen")) & (F.col("_lang") == F.col("_as")))  # at most `sample` pairs of id and language
    at, values, langs = sparse_features(one_text(chosen, ["_id", "_lang"], "_text"), "_text", "_lang", grams)
    return Tree(dense(at, values, WIDTH), langs) if langs else None


def predicted(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    fitted = fit(docs, doc=doc, text=text, lang=lang, per_language=per_language, sample=sample)
    tree = docs.sparkSession.sparkContext.broadcast(vars(fitted) if fitted else None)  # plain arrays and lists
    kind = docs.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        if tree.value is not None:
            model = Tree.__new__(Tree)
            vars(model).update(tree.value)
        for batch in batches:
            names, scores = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            for at in range(0, batch.num_rows, BLOCK):
                texts = [t.as_py() for t in batch.column(1).slice(at, BLOCK)]
                rows = [i for i, t in enumerate(texts) if has_letter(t)]
                if rows and model is not None:
                    got, p = model.predict(np.stack([grams(texts[i]) for i in rows]))
                    for i, g, s in zip(rows, got, p, strict=True):
                        names[at + i], scores[at + i] = g, s
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    out = docs.select(doc, text).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return out.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
