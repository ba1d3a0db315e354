"""The walks and clusters that one task does for a component, against plain versions and in their memory."""

import random
import tracemalloc

import numpy as np

from strataline.operators import network as N


def test_neighbours():
    names, begins, near = N._neighbours(np.array([5, 5, 9, 5]), np.array([9, 2, 5, 2]))
    assert names.tolist() == [2, 5, 9] and [near[i:j].tolist() for i, j in zip(begins, begins[1:])] == [[1], [0, 2], [1]]


def test_neighbours_take_little_memory():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 5000, (2, 300_000))
    tracemalloc.start()
    N._neighbours(a, b)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100 * len(a)  # as sets of ids it was over 200 bytes an edge


def test_walk_and_clusters_are_the_plain_ones(spark):
    for seed in range(3):
        rng = random.Random(seed)
        edges = [(a, b, float(rng.randrange(4))) for a, b in {tuple(sorted(rng.sample(range(60), 2))) for _ in range(150)}]
        near = {}
        for a, b, w in edges:
            near.setdefault(a, {})[b] = w
            near.setdefault(b, {})[a] = w
        seen = {min(near): 0}

        def go(x):
            for y in sorted(near[x]):
                if y not in seen and seen[x] < 3:
                    seen[y] = seen[x] + 1
                    go(y)

        go(min(near))
        df = spark.createDataFrame([(7, *e) for e in edges], "component long, a long, b long, weight double")
        assert {r.node: r.level for r in N.level_capped_walk(df, "component", 3).collect()} == seen

        nodes = [(n, rng.choice(["x", "y", "other"]), rng.randrange(3)) for n in range(62)]  # two have no edge
        heads = {}
        for _, _, n in sorted((["x", "y"].index(c), -length, n) for n, c, length in nodes if c != "other"):
            heads[n] = max(((w, b) for b, w in near.get(n, {}).items() if heads.get(b) == b), default=(0, n))[1]
        got = N.priority_clusters(df.select("a", "b", "weight"), spark.createDataFrame(nodes, "node long, class string, length long"), ["x", "y"]).collect()
        assert {r.node: r.representative for r in got} == heads and len(got) == len(heads)
