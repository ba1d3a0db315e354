"""Sparse feature rows between executors and the driver, and what the classifiers share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as 0."""
    return F.coalesce(F.crc32(doc.cast("string").cast("binary")), F.lit(0)) % n


def sample_order(doc: Column) -> list[Column]:
    return [F.xxhash64(doc), doc]


def one_text(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row for each key: of the texts that rows of one id have, that of smallest hash."""
    return rows.groupBy(*keys).agg(F.min_by(text, F.struct(F.xxhash64(text), F.length(text))).alias(text))


def sparse_features(rows: DataFrame, text: str, label: str, features: Callable[[str | None], np.ndarray]) -> tuple[np.ndarray, np.ndarray, list]:
    """(indptr-free) row numbers, places, values and labels of a bounded sample's features, brought to the driver."""
    kind = rows.schema[label].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, values = [], []
            for t in batch.column(0):
                x = features(t.as_py())
                nz = np.flatnonzero(x)
                at.append(nz.astype("<u2").tobytes())
                values.append(x[nz].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(at, pa.binary()), pa.array(values, pa.binary())], ["label", "at", "val"])

    got = rows.select(text, label).mapInArrow(run, f"label {kind}, at binary, val binary").toArrow()
    order = sorted(range(got.num_rows), key=lambda i: (got["at"][i].as_py(), got["val"][i].as_py(), str(got["label"][i].as_py())))  # the same model whatever order rows arrive in
    return [np.frombuffer(got["at"][i].as_py(), "<u2") for i in order], [np.frombuffer(got["val"][i].as_py(), "<f4") for i in order], [got["label"][i].as_py() for i in order]


def dense(at: list[np.ndarray], values: list[np.ndarray], width: int) -> np.ndarray:
    x = np.zeros((len(at), width), np.float32)
    for i, (a, v) in enumerate(zip(at, values, strict=True)):
        x[i, a] = v
    return x


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
