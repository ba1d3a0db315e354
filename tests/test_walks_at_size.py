"""Walks of groups in many batches and clusters by rounds, against plain versions; what one task holds for a component."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from strataline.operators import network as N


def plain_walk(edges, most):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    seen = {min(near): 0}

    def go(x):
        for y in sorted(near[x]):
            if y not in seen and seen[x] < most:
                seen[y] = seen[x] + 1
                go(y)

    go(min(near))
    return seen


@pytest.mark.parametrize("most", [0, 1, 2, 3, 5])
def test_walks_of_groups(spark, most):
    rng = random.Random(most)
    groups = {g: [(rng.randrange(40), rng.randrange(40)) for _ in range(n)] for g, n in ((1, 150), (2, 40), (None, 60), (3, 1))}
    groups[4] = [(k, k + 1) for k in range(30)] + [(0, 0)]  # a chain
    df = spark.createDataFrame([(g, *e) for g, own in groups.items() for e in own] + [(1, None, 3)], "g long, a long, b long").repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = N.level_capped_walk(df, "g", most).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for g, own in groups.items():
        assert {r.node: r.level for r in got if r.g == g} == plain_walk(own, most)
        assert {r.root for r in got if r.g == g} == {min(min(e) for e in own)}
    assert len(got) == sum(len(plain_walk(own, most)) for own in groups.values())


def test_walks_of_names(spark):
    df = spark.createDataFrame([("x", "b", "c"), ("x", "a", "c"), ("y", "q", "p")], "g string, a string, b string")
    assert {tuple(r) for r in N.level_capped_walk(df, "g", 2).collect()} == {("x", "a", "a", 0), ("x", "a", "c", 1), ("x", "a", "b", 2), ("y", "p", "p", 0), ("y", "p", "q", 1)}


def test_only_edges_near_the_root_reach_a_task(spark):
    rows = [(1, k, k + 1) for k in range(200)]
    seen = spark.sparkContext.accumulator(0)
    whole = N._capped_walks

    def counted(batches, group, most):
        def passing():
            for b in batches:
                seen.add(b.num_rows)
                yield b

        return whole(passing(), group, most)

    N._capped_walks = counted
    try:
        assert N.level_capped_walk(spark.createDataFrame(rows, "g long, a long, b long"), "g", 3).count() == 4
    finally:
        N._capped_walks = whole
    assert seen.value == 5  # 0, 1 and 2 have one, two and two neighbours; it was all 200 edges


def test_a_walk_takes_little_memory():
    n, each = 1_500, 2_000
    src, dst = np.repeat(np.arange(n), each), np.tile(np.arange(n, n + each), n)
    batches = [pa.RecordBatch.from_arrays([pa.array(np.zeros(each, np.int64)), pa.array(src[k : k + each]), pa.array(dst[k : k + each])], names=["g", "src", "dst"]) for k in range(0, len(src), each)]
    tracemalloc.start()
    list(N._capped_walks(iter(batches), "g", 3))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 16 * len(src)  # as whole tables and sorted pairs it was over 60
