"""Clusters by rounds, against a plain version."""

import random

import pytest

from strataline.operators import network as N


@pytest.mark.parametrize("group_edges", [0, 20, 1_000_000])
def test_clusters_by_rounds(spark, group_edges):
    rng = random.Random(group_edges)
    edges = [(rng.randrange(70), rng.randrange(70), rng.choice([0.0, 1.0, 2.0, None])) for _ in range(300)]
    edges += [(k, k + 1, 1.0) for k in range(100, 120)]  # a chain in the order of the nodes
    nodes = [(n, rng.choice(["x", "y", "other", None]), rng.choice([1, 2, 3, None])) for n in range(75)] + [(n, "x", 1) for n in range(100, 121)] + [(5, "x", 9), (5, "y", 9)]
    near = {}
    for a, b, w in edges:
        near.setdefault(a, []).append((float("inf") if w is None else w, b))
        near.setdefault(b, []).append((float("inf") if w is None else w, a))
    heads = {}
    for _, _, _, n in sorted((["x", "y"].index(c), length is None, -(length or 0), n) for n, c, length in nodes if c in ("x", "y")):
        if n not in heads:
            heads[n] = max(((w, b) for w, b in near.get(n, []) if b != n and heads.get(b) == b), default=(0, n))[1]
    df = spark.createDataFrame(edges, "a long, b long, weight double")
    got = N.priority_clusters(df, spark.createDataFrame(nodes, "node long, class string, length long"), ["x", "y"], group_edges).collect()
    assert {r.node: r.representative for r in got} == heads and len(got) == len(heads)
