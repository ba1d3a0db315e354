"""The pipeline's pack stage: small batches and memory given back."""

import ctypes

import pytest

from strataline.llm import packing
from strataline.session import trimmed


def test_tokens_do_not_depend_on_batches(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"some words {k} " * (k % 40)) for k in range(60)], "doc_id long, text string").coalesce(1)
    key = lambda r: (r.doc_id, r.start)
    some = sorted(packing.packed(docs).collect(), key=key)
    monkeypatch.setattr(packing, "ROWS_AT_ONCE", 7)
    assert some == sorted(packing.packed(docs).collect(), key=key)


def test_freed_memory_is_given_back():
    if not hasattr(ctypes.CDLL(None), "malloc_trim"):
        pytest.skip("not glibc")
    import re

    held = lambda: int(re.search(r"Pss_Anon:\s+(\d+)", open("/proc/self/smaps_rollup").read())[1])  # noqa: E731, SIM115
    blocks = [bytes(2000) for _ in range(100_000)]
    last = bytes(2000)  # keeps the heap's end
    most = held()
    blocks.clear()
    trimmed()
    assert last and most - held() > 100_000
