"""Structure, hull, raster and graph operators against plain versions on small fixtures."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from strataline.functions import text as T
from strataline.operators import kernels as K
from strataline.operators import network as N
from strataline.operators import raster as R
from strataline.operators import relational as O
from strataline.operators import spatial as S
from strataline.operators import structures as P
from strataline.queries import structures as Q
from strataline.sources import records


def components(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


# ---- secondary structure and topology -----------------------------------------------------------------------------------------------


def plain_runs(numbers, tolerance, longer_than):
    runs, now = [], []
    for n in sorted(numbers):
        if now and n - now[-1] > tolerance:
            runs.append(now)
            now = []
        now.append(n)
    return [r for r in [*runs, now] if len(r) > max(1, longer_than)]


def plain_core(ca):
    """ca: resnum -> point."""
    order = sorted(ca)
    helix = set()
    for w in zip(order, order[1:], order[2:], order[3:], strict=False):
        p = np.array([ca[k] for k in w])
        m = 2 * (p[1:] - p[0])
        if abs(np.linalg.det(m)) < 1e-9:
            continue
        if 2.75 < np.linalg.norm(np.linalg.solve(m, ((p[1:] - p[0]) ** 2).sum(axis=1))) < 3.25:
            helix |= set(w)
    helix = {k for r in plain_runs(helix, 2, 8) for k in r}
    rest = [k for k in order if k not in helix]
    d = lambda a, b: math.dist(ca[a], ca[b])
    strand = set()
    for i in range(2, len(rest) - 3):
        others = [rest[j] for j in range(len(rest)) if abs(i - j) > 2]
        if any(d(rest[i], o) < 8 for o in others) and d(rest[i], rest[i + 3]) > 6:
            strand.add(rest[i])
    runs = plain_runs(strand, 1, 4)
    runs = [r for r in runs if any(d(a, b) < 5 for q in runs if q is not r for a in r for b in q)]
    sheet, every = set(), [k for r in runs for k in r]
    for r in runs:
        held = [k for k in r if any(abs(k - o) > 4 and d(k, o) < 6 for o in every)]
        sheet |= {k for k in r if held and held[0] <= k <= held[-1]}
    return helix, sheet


def test_secondary_core(spark):
    rows = Q.c_alphas(spark, "/root/testdata/sf0.01").collect()
    by = defaultdict(dict)
    for r in rows:
        by[r.structure][r.resnum] = (r.x, r.y, r.z)
    got = defaultdict(set)
    for r in P.secondary_core(Q.c_alphas(spark, "/root/testdata/sf0.01")).collect():
        got[r.structure, r.kind].add(r.resnum)
    for s, ca in by.items():
        helix, sheet = plain_core(ca)
        assert got[s, "helix"] == helix and got[s, "sheet"] == sheet
    assert any(k == "helix" and v for (_, k), v in got.items()) and any(k == "sheet" and v for (_, k), v in got.items())


def plain_topology(query, hit):
    """query, hit: resnum -> point; scores as a tuple and the covered residues of both."""
    q, h = sorted(query), sorted(hit)
    target = {a: max((b for b in h if math.dist(query[a], hit[b]) < 6), default=None) for a in q}
    met = {b: False for b in h} | {b: True for b in target.values() if b is not None}

    def revise(on, keys, value):
        # a stretch of one to three equal to `value` inside five in a row whose outer ones aren't flips, in place, until nothing does
        moved = True
        while moved:
            moved = False
            for i in range(2, len(keys) - 2):
                a, b, c, d, e = (on[keys[j]] == value for j in range(i - 2, i + 3))
                if not c:
                    continue
                flips = [0] if not b and not d else [-1, 0] if not a and b and not d else [0, 1] if not b and d and not e else [-1, 0, 1] if b and d and not a and not e else []
                for j in flips:
                    on[keys[i + j]] = not value
                moved |= bool(flips)

    covered = {a: target[a] is not None for a in q}
    revise(covered, q, True)
    now = []
    for a in [*q, None]:
        if a is not None and covered[a]:
            now.append(a)
        elif now:
            kinds = {target[x] for x in now}
            if len(kinds) <= 5:
                for x in now:
                    covered[x] = False
            else:
                for b in h:
                    met[b] |= min(kinds) <= b <= max(kinds)
            now = []
    revise(met, h, False)
    n, on = len(q), [a for a in q if covered[a]]
    gaps, now = [], []
    for a in [*q, None]:
        if a is not None and not covered[a]:
            now.append(a)
        elif now:
            gaps.append(now[-1] - now[0] + 1)
            now = []
    gaps = [g for g in gaps if g > 0.1 * n]
    return (n, len(on), len(on) / n, on[14] / n if len(on) > 14 else 0.0, (n - on[-15]) / n if len(on) > 14 else 0.0, len(gaps), sum(gaps) / n), {a for a in q if covered[a]}, {b for b in h if met[b]}


def test_difference_topology(spark):
    rng = random.Random(4)
    query, hit, want = [], [], {}
    for pair in range(6):
        line = [(3.0 * k, rng.uniform(-1, 1), 0.0) for k in range(1, 61)]
        q = {k: p for k, p in enumerate(line, 1)}
        lost = set(rng.sample(range(1, 61), 14)) | set(range(10 + pair, 14 + 3 * pair))
        h = {k: (x, y + rng.choice([0.0, 0.0, 9.0]) * (pair > 3), z + 3) for k, (x, y, z) in q.items() if k not in lost}
        want[pair] = plain_topology(q, h)
        query += [(pair, k, *p) for k, p in q.items()]
        hit += [(pair, k, *p) for k, p in h.items()]
    schema = "pair long, resnum int, x double, y double, z double"
    scores, flags = P.difference_topology(spark.createDataFrame(query, schema), spark.createDataFrame(hit, schema))
    got = {r.pair: (r.n, r.covered, r.coverage, r.n_truncation, r.c_truncation, r.gaps, r.gap_share) for r in scores.collect()}
    sides = defaultdict(set)
    for r in flags.where("covered").collect():
        sides[r.pair, r.side].add(r.resnum)
    for pair, (score, q, h) in want.items():
        assert all(abs(a - b) < 1e-9 for a, b in zip(got[pair], score, strict=True)) and sides[pair, "query"] == q and sides[pair, "hit"] == h


def test_void_networks(spark):
    rng = random.Random(7)
    points = [(1, k, rng.uniform(0, 30), rng.uniform(0, 30), rng.uniform(0, 30)) for k in range(120)]
    atoms = [(rng.uniform(0, 30), rng.uniform(0, 30), rng.uniform(0, 30)) for _ in range(25)]
    df, at = spark.createDataFrame(points, "g long, id long, x double, y double, z double"), spark.createDataFrame(atoms, "x double, y double, z double")
    nets, edges = P.void_networks(df, at, "g", clash=5.0, max_edge=5.5, min_size=2)
    clear = [p for p in points if min(math.dist(p[2:], a) for a in atoms) >= 5.0]
    xyz = np.array([p[2:] for p in clear])
    pairs = [(clear[a][1], clear[b][1]) for a, b in K.simplex_edges(K.delaunay(xyz)) if math.dist(xyz[a], xyz[b]) < 5.5]
    of = components([x for p in pairs for x in p], pairs)
    sizes = {c: n for c, n in Counter(of.values()).items() if n > 2}
    got = nets.collect()
    assert {r.component: r["size"] for r in got} == sizes and sizes
    assert [r.component for r in sorted(got, key=lambda r: r.place)] == sorted(sizes, key=lambda c: (-sizes[c], c))
    kept = edges.collect()
    assert len(kept) == sum(n - 1 for n in sizes.values()) and {tuple(sorted((r.a, r.b))) for r in kept} <= {tuple(sorted(p)) for p in pairs}


# ---- hulls, neighbours, burial -------------------------------------------------------------------------------------------------------


def test_inside_hull_by_structure(spark):
    rng = np.random.default_rng(2)
    cloud = [(c, 100 * c + k, *(rng.normal(size=3) + 3 * c)) for c in range(3) for k in range(30)]
    df = spark.createDataFrame([(int(c), int(k), float(x), float(y), float(z)) for c, k, x, y, z in cloud], "chain long, id long, x double, y double, z double")
    at = {k: np.array(p) for _, k, *p in cloud}
    planes, rows = defaultdict(list), []
    for r in K.surfaces(df, "chain").collect():
        a, b, c = at[r.a], at[r.b], at[r.c]
        n = np.cross(b - a, c - a)
        planes[r.chain].append((n, n @ a))
        rows.append((r.chain, (tuple(map(float, n)), float(n @ a))))
    facets = spark.createDataFrame(rows, "chain long, plane struct<n:struct<x:double,y:double,z:double>,d:double>")
    probes = [(int(c), k, *map(float, 3 * c + 2.5 * rng.normal(size=3))) for c in range(3) for k in range(60)]
    want = {(c, k) for c, k, *p in probes if all(n @ np.array(p) - d <= 1e-9 for n, d in planes[c])}
    got = S.inside_hull(spark.createDataFrame(probes, "chain long, id long, x double, y double, z double"), facets, "chain")
    assert {(r.chain, r.id) for r in got.collect()} == want and 0 < len(want) < len(probes)


def test_nearest_finds_far_rows(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 1e6, 0.0, 0.0), (3, 5.0, 5.0, 5.0)], "id long, x double, y double, z double")
    right = spark.createDataFrame([(9, -1e6, 0.0, 0.0), (8, 5.0, 5.0, 6.0), (7, 5.0, 5.0, 4.0)], "id long, x double, y double, z double")
    assert {r.id: r.nearest for r in S.nearest(left, right, 0.5).collect()} == {1: 7, 2: 7, 3: 7}
    assert S.nearest(left, right.limit(0), 0.5).count() == 0


def test_burial_takes_the_least_distance_without_signs(spark):
    rows = [(1, -5.0), (1, -4.0), (2, -2.5), (2, -2.5), (3, -2.5), (3, 4.0), (4, 1.0), (5, -9.0), (5, -8.0), (5, 7.0)]
    got = {r.v: r.burial for r in O.burial(spark.createDataFrame(rows, "v long, d double"), "v", "d").collect()}
    assert got == {1: -1, 2: 0, 3: 1, 4: 1, 5: -1}
    wide = {r.v: (r.burial, r.mean) for r in O.burial(spark.createDataFrame([(1, 9.0), (1, 1.0)], "v long, d double"), "v", "d", -3.0, 2.0).collect()}
    assert wide == {1: (0, 1.0)}


# ---- text and records ----------------------------------------------------------------------------------------------------------------


def test_domains_families_and_fields(spark):
    heads = {">Archaeota_x|1": "other", "archaeon sp|x": "archaea", "q|some eukaryote": "eukaryota", "x|Eukarya thing": "eukaryota", "y|archaeota group": "archaea", "Bacterial|z": "bacteria", "virus": "other", "": "other"}
    heads[">Archaeota_x|1"] = "archaea"  # named anywhere
    df = spark.createDataFrame([(h,) for h in heads], "h string")
    assert {r.h: r.d for r in df.select("h", T.domain_of(F.col("h")).alias("d")).collect()} == heads
    said = {"a 7TM-GPCR serpentine": True, "7TM domain protein": False, "a 7tm domain": False, "GCR-12 like": True, "AB_C of": True, "XAB_CX": False}
    got = spark.createDataFrame([(k,) for k in said], "h string").select("h", T.in_family(F.col("h"), ["7tm_gpcr_serpentine", "GCR", "ab_c", " "]).alias("m")).collect()
    assert {r.h: r.m for r in got} == said
    assert spark.createDataFrame([("7TM REGION",)], "h string").select(T.in_family(F.col("h"), ["7TM region"]).alias("m")).first().m
    text = "ID   A_B Reviewed; 3 AA.\nAC   P12345; NOTONE; A0A123BCD4;\nGN   Name=ABC1,ABC2; Synonyms=X;\nDE   RecName: Full=Thing;\n"
    e = records.entry_fields(spark.createDataFrame([("f", 0, text), ("f", 1, text.replace("ABC1,ABC2", "abc def"))], "file string, block long, text string")).collect()
    assert e[0].accessions == ["P12345", "A0A123BCD4"] and e[0].primary_accession == "P12345" and [r.gene for r in e] == ["ABC1", "abc"]


def test_files_by_record(spark, tmp_path):
    (tmp_path / "a.dat").write_text("ID   X Reviewed; 1 AA.\nAC   P12345;\n//\nID   Y Reviewed; 1 AA.\nAC   Q12345;\n//\n")
    (tmp_path / "b.fa").write_text("lost line\n>one a\nACG\nTT\n>two\n>three\nGG\n")
    (tmp_path / "c.fa").write_text(">four\nA C\n")
    entries = records.entry_fields(records.read_entries(spark, str(tmp_path / "a.dat"))).collect()
    assert sorted(r.primary_accession for r in entries) == ["P12345", "Q12345"]
    seqs = records.read_fasta(spark, str(tmp_path / "*.fa")).collect()
    assert {(r.header, r.seq) for r in seqs} == {("one a", "ACGTT"), ("two", ""), ("three", "GG"), ("four", "A C")}


# ---- graphs --------------------------------------------------------------------------------------------------------------------------


def plain_prune(edges, score, cap):
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    kept = set(near)
    while len(kept) > cap:
        kept.discard(min((n for n in kept if len(near[n] & kept) <= 1), key=lambda n: (score[n], n)))
    return {(a, b) for a, b in edges if a in kept and b in kept}


def test_pruning_several_trees_of_a_component(spark):
    two = spark.createDataFrame([(1, 1, 2, 5.0), (1, 3, 4, 6.0)], "component long, a long, b long, weight double")
    cap = lambda n: spark.createDataFrame([(1, n)], "component long, cap long")
    assert N.prune_to_cap(two, N.node_scores(two), cap(1)).count() == 0
    rng = random.Random(5)
    edges = [(rng.randrange(k), k) for k in range(1, 40)]
    df = spark.createDataFrame([(1, a, b, float(rng.randrange(100))) for a, b in edges], "component long, a long, b long, weight double")
    scores = {r.node: r.score for r in N.node_scores(df).collect()}
    for n in (3, 20):
        got = {(r.a, r.b) for r in N.prune_to_cap(df, N.node_scores(df), cap(n)).collect()}
        assert got == plain_prune(edges, scores, n)


def test_large_components_are_solved_by_rounds(spark):
    rng = random.Random(8)
    edges = {tuple(sorted(rng.sample(range(25), 2))): float(rng.randrange(6)) for _ in range(70)}
    rows = [(1, a, b, w) for (a, b), w in edges.items()] + [(100, 100, 101, 1.0)]
    df = spark.createDataFrame(rows, "component long, a long, b long, weight double")
    one = {tuple(r) for r in N.maximum_spanning_forest(df).collect()}
    assert one == {tuple(r) for r in N.maximum_spanning_forest(df, group_edges=5).collect()}
    chain = spark.createDataFrame([(k, k + 1, 1.0, 0.1) for k in range(45)], "a long, b long, weight double, evalue double")
    assert {r.node: r.depth for r in N.bfs_walk(chain, 0).collect()} == {k: k for k in range(46)}  # more levels than are kept apart


def test_ranked(spark):
    rows = [(k, v) for k, v in enumerate([5, 3, 5, 9, 3, 3])]
    got = {r.k: r.place for r in N.ranked(spark.createDataFrame(rows, "k long, v long"), "v", "k").collect()}
    assert got == {3: 1, 0: 2, 2: 3, 1: 4, 4: 5, 5: 6}


# ---- rasters -------------------------------------------------------------------------------------------------------------------------


def test_interfaces_and_classes(spark):
    rng = np.random.default_rng(3)
    a = np.zeros((24, 24))
    a[2:8, 2:8], a[2:8, 14:20] = 200, 200
    a[4, 8:14] = 100  # between two large blobs
    a[15:17, 4:9], a[17, 4:6] = 100, 200  # on a small one
    a[20, 20] = 100
    a += rng.random(a.shape)
    pix = spark.createDataFrame([(1, y, x, float(a[y, x])) for y in range(24) for x in range(24)], "image_id long, y int, x int, v double")
    solid, thin = R.label_table(pix, 150), R.label_table(pix, 50, 150)
    got = {r.area: (r.attached, r.attached_large, r.kept) for r in R.attached_interfaces(thin, solid, large=30, min_attached=2, max_ratio=4.0).collect()}
    assert got == {6: (72, 72, True), 10: (2, 0, False), 1: (0, 0, False)}
    got = {r.area: (r.reachable, round(r.distance, 6), r.kind) for r in R.classified_components(thin, solid, reach=3, large=30, bridge_area=5, projection_mm=8.0).collect()}
    assert got == {6: (2, 3.0, "bridge"), 10: (0, 0.0, "protrusion"), 1: (0, 0.0, "protrusion")}
    radius = R.closing_radii(pix, 150, least=1).first().radius
    inside = [min(min(y, 7 - y), min(x, 7 - x)) for y in range(1, 7) for x in range(1, 7)] * 2 + [1, 1]
    assert radius == max(1, round(0.4 * float(np.median(inside))))
