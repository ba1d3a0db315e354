import itertools
import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataline.operators import kernels as K
from strataline.operators import network as N
from strataline.operators import windows as W
from strataline.plans.components import connected_components
from strataline.plans.ordering import even_buckets, running, unit_hash


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 400)] + [(5000, 5000)] + [(rng.randrange(6000, 6100), rng.randrange(6000, 6100)) for _ in range(60)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    up = {n: n for e in edges for n in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    assert got == {n: find(n) for n in up}


def test_running_ranks_like_one_window(spark):
    rows = [(k % 3 or None, k, k * 7 % 11) for k in range(200)]
    df = spark.createDataFrame(rows, "g int, id long, v long").withColumn("u", unit_hash(F.col("id")))
    got = running(df.withColumn("b", even_buckets(F.col("u"), 200)), ["g"], "b", [F.col("u")], F.col("v")).collect()
    for g in (None, 1, 2):
        own = sorted((r for r in got if r.g == g), key=lambda r: r.u)
        assert [r.rank0 for r in own] == list(range(len(own)))
        assert [r.before for r in own] == [sum(x.v for x in own[:k]) for k in range(len(own))]


def _reference_walk(edges, root):
    near = {}
    for a, b, w, ev in edges:
        near.setdefault(a, []).append((-w, ev if ev is not None else math.inf, b))
        near.setdefault(b, []).append((-w, ev if ev is not None else math.inf, a))
    seen, queue, out = {root}, [root], {}
    while queue:
        at = queue.pop(0)
        for _, _, n in sorted(near.get(at, [])):
            if n not in seen:
                seen.add(n)
                queue.append(n)
                out[n] = at
    return out


def test_bfs_walk_is_the_fifo_walk(spark):
    for seed in range(2):
        rng = random.Random(seed)
        edges = [(rng.randrange(25), rng.randrange(25), float(rng.randrange(4)), rng.choice([0.1, 0.2, None])) for _ in range(40)]
        edges = [e for e in edges if e[0] != e[1]]
        got = {r.node: r.parent for r in N.bfs_walk(spark.createDataFrame(edges, "a long, b long, weight double, evalue double"), edges[0][0]).collect() if r.parent is not None}
        assert got == _reference_walk(edges, edges[0][0])


def test_forests_agree_and_pruning_keeps_leaves_out(spark):
    rng = random.Random(3)
    edges = {tuple(sorted(rng.sample(range(30), 2))): float(rng.randrange(10)) for _ in range(60)}
    df = spark.createDataFrame([(1, a, b, w) for (a, b), w in edges.items()], "component long, a long, b long, weight double")
    one = {(r.a, r.b) for r in N.maximum_spanning_forest(df).collect()}
    assert one == {(r.a, r.b) for r in N.spanning_forest_by_rounds(df.select("a", "b", "weight")).collect()}
    pruned = N.prune_to_cap(N.maximum_spanning_forest(df), N.node_scores(df), spark.createDataFrame([(1, 6)], "component long, cap long")).collect()
    assert {(r.a, r.b) for r in pruned} <= one and len({x for r in pruned for x in (r.a, r.b)}) == 6


def test_reduced_network_and_clusters(spark):
    edges = spark.createDataFrame([(i, i + 1, float(10 + i), 0.1, 5.0) for i in range(10)] + [(0, 5, 99.0, float("inf"), 7.0)], "a long, b long, weight double, evalue double, bitscore double")
    out = N.reduce_network(edges, budget=20, cap=5).collect()
    assert sum(r.is_backbone for r in out) == 4
    nodes = spark.createDataFrame([(i, "x" if i % 2 else "y", 100 - i) for i in range(11)], "node long, class string, length long")
    heads = {r.node: r.representative for r in N.priority_clusters(edges.select("a", "b", "weight"), nodes, ["x", "y"]).collect()}
    assert len(heads) == 11 and all(heads[h] == h for h in heads.values())
    assert heads[1] == 1 and heads[10] == 9  # x heads come first, y joins them


def test_minimised_network_is_a_minimum_forest(spark):
    e = spark.createDataFrame([(1, 1, 2, 1.0), (1, 2, 3, 2.0), (1, 1, 3, 2.5), (1, 3, 4, 9.0)], "component long, a long, b long, distance double")
    assert {(r.a, r.b) for r in N.minimised(e, 5.0).collect()} == {(1, 2), (2, 3)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.booleans(), min_size=5, max_size=40), st.booleans())
def test_revision_is_a_fixpoint(flags, fill):
    once = W._revise(flags, fill)
    assert W._revise(once, fill) == once
    assert all(x or not y for x, y in zip(flags, once, strict=True)) or fill
    assert all(y or not x for x, y in zip(flags, once, strict=True)) or not fill


def test_delaunay_has_empty_spheres():
    rng = np.random.default_rng(0)
    for dim in (2, 3):
        p = rng.random((40, dim))
        s = K.delaunay(p)
        c, r = K._spheres(p, s)
        assert all(((p - c[k]) ** 2).sum(axis=1).min() > r[k] * (1 - 1e-9) for k in range(len(s)))
    volume = abs(np.linalg.det(p[s[:, 1:]] - p[s[:, :1]])).sum() / 6
    f = K.surface_facets(p, s)
    v = {x for row in f.tolist() for x in row}
    assert len(v) - len(K.simplex_edges(f)) + len(f) == 2  # Euler
    hull = sum(np.dot(p[a], np.cross(p[b], p[c])) for a, b, c in f) / 6
    assert abs(volume - hull) < 1e-9
    assert len(K.delaunay(np.zeros((5, 3)))) == 0


def test_labels_match_flood_fill():
    rng = np.random.default_rng(1)
    m = rng.random((23, 31)) > 0.55
    for diagonal in (True, False):
        label, seen = K.labelled(m, diagonal), {}
        for y, x in zip(*np.nonzero(m), strict=True):
            if (y, x) in seen:
                continue
            stack, k = [(y, x)], len(set(seen.values())) + 1
            while stack:
                a, b = stack.pop()
                if (a, b) in seen or not (0 <= a < 23 and 0 <= b < 31) or not m[a, b]:
                    continue
                seen[a, b] = k
                stack += [(a + i, b + j) for i, j in itertools.product((-1, 0, 1), repeat=2) if (diagonal or not (i and j))]
        pairs = {(label[p], k) for p, k in seen.items()}
        assert len(pairs) == label.max() == len({k for _, k in pairs})


def test_rasters():
    m = np.zeros((9, 9), bool)
    m[2:7, 2:7] = True
    m[4, 4] = False
    assert K.filled_holes(m, 2).sum() == 25 and K.filled_holes(m, 1).sum() == 24
    assert K.eroded(K.filled_holes(m), K.square(1)).sum() == 9 and K.dilated(m, K.square(1)).sum() == 49
    assert K.distance_transform(K.filled_holes(m))[4, 4] == 3
    assert K.components_of(m)["filled"].tolist() == [25]
    assert 0 < K.skeleton(K.filled_holes(m)).sum() < 9
    assert abs(K.gaussian(np.ones((9, 9)), 1.5) - 1).max() < 1e-12
    assert K.ray_hits(m, np.array([[4, 4], [0, 0]]), 8, 5).tolist() == [True, False]
    assert K.disc_density(m, 1)[0, 0] == 0


@settings(max_examples=40, deadline=None)
@given(st.text("ACG", max_size=8), st.text("ACG", max_size=8))
def test_global_alignment_is_best(a, b):
    x, y, score = K.global_alignment(a, b)
    assert x.replace("-", "") == a and y.replace("-", "") == b
    assert score == sum(-1 if "-" in (p, q) else 1 if p == q else -1 for p, q in zip(x, y, strict=True))

    def best(i, j):
        if i == len(a) or j == len(b):
            return -(len(a) - i) - (len(b) - j)
        return max(best(i + 1, j + 1) + (1 if a[i] == b[j] else -1), best(i + 1, j) - 1, best(i, j + 1) - 1)

    assert score == best(0, 0)


def test_external_tool_hook(spark):
    got = K.external(spark.range(3), "id long, twice long", lambda pdf: pdf.assign(twice=pdf["id"] * 2)).collect()
    assert [r.twice for r in got] == [0, 2, 4]


def test_kernel_density_of_many_points(spark):
    import numpy as np

    from strataline.operators import relational

    n = 100_001
    df = spark.range(n).selectExpr("sin(id) / 4 as x", "cos(id * 1.7) / 5 as y")
    got = {(r.ix, r.iy): r.density for r in relational.kernel_density(df, "x", "y", -0.5, 0.5, 4).collect()}
    points = np.stack([np.sin(np.arange(n)) / 4, np.cos(np.arange(n) * 1.7) / 5])
    cov = np.cov(points) * n ** (-1 / 3)
    assert len(got) == 16
    for (ix, iy), density in got.items():
        d = np.array([[-0.5 + (ix + 0.5) / 4], [-0.5 + (iy + 0.5) / 4]]) - points
        want = np.exp(-(d * (np.linalg.inv(cov) @ d)).sum(axis=0) / 2).sum() / (2 * np.pi * np.sqrt(np.linalg.det(cov)) * n)
        assert abs(density - want) < 1e-9
