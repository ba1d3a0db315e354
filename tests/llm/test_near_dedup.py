"""The pipeline's near-duplicate stage goes through the Gray-order index, then the exact check."""

import random

from strataline.llm import simhash


def _texts():
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(600)]
    other = [f"v{rng.randrange(10**6)}" for _ in range(600)]
    return [(1, " ".join(base)), (2, " ".join([*base[:300], "changed", *base[301:]])), (3, " ".join(other)), (4, ""), (5, None), (6, " ".join([*other, "more"]))]


def _classes(df):
    return {r.id: r.component_id for r in df.collect()}


def test_index_links_near_copies(spark):
    docs = spark.createDataFrame(_texts(), "doc_id long, text string")
    assert _classes(simhash.similar_documents(docs, bands=0)) == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 3}  # without bands, all that links is the index


def test_links_of_the_index_are_checked(spark):
    docs = spark.createDataFrame(_texts(), "doc_id long, text string")
    assert _classes(simhash.similar_documents(docs, bands=0, k=20)) == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 3}  # 20 bits link more, the sets say no
    assert set(_classes(simhash.similar_documents(docs, bands=0, similarity=0.9999))) == {1, 2, 3, 4, 5, 6}
    assert _classes(simhash.similar_documents(docs, bands=0, similarity=0.9999))[2] == 2


def test_pairs_of_the_index(spark):
    codes = spark.createDataFrame([(10, 0), (11, 0), (12, 0), (20, 0b111), (30, -1)], "code long, fp long")
    assert {(min(r), max(r)) for r in simhash.indexed_pairs(codes, 4).collect()} == {(10, 11), (10, 12), (10, 20)}
