"""Similarity networks: hits to edges, degrees, walks, forests and reduced graphs.

Edge tables are plain DataFrames. Everything that is order-free is relational; the greedy steps run once a connected component.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataline.plans.components import connected_components
from strataline.plans.ordering import numbered
from strataline.session import bounded, cut, stored

INFINITE = float("inf")
#: Edges of a component that one task solves alone.
GROUP_EDGES = 1_000_000


# ---- edges -----------------------------------------------------------------------------------------------------------------------


def canonical_edges(hits: DataFrame, query: str, subject: str) -> DataFrame:
    """Hits as undirected edges: the smaller end first; hits of a node with itself are dropped."""
    rest = [c for c in hits.columns if c not in (query, subject)]
    return hits.where(F.col(query) != F.col(subject)).select(F.least(query, subject).alias("a"), F.greatest(query, subject).alias("b"), *rest)


def unique_edges(edges: DataFrame) -> DataFrame:
    """One row an edge: best identity, evalue, bitscore and length, each on its own."""
    return edges.groupBy("a", "b").agg(F.max("pident").alias("pident"), F.min("evalue").alias("evalue"), F.max("bitscore").alias("bitscore"), F.max("length").alias("length"))


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, degree) over unique edges; with `nodes`, those without edges have degree 0."""
    counted = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    return counted if nodes is None else nodes.join(counted, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))


def first_attributes(rows: DataFrame, key: str, attributes: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row a key: the attributes of its first row by an explicit order."""
    first = F.min_by(F.struct(*attributes), F.struct(*order)).alias("first")
    return rows.groupBy(key).agg(first).select(key, *[F.col(f"first.{c}").alias(c) for c in attributes])


def build_network(hits: DataFrame, query: str, subject: str, min_identity: float = 0.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(unique edges, nodes with degrees, counts): nodes of hits with themselves stay, their edges don't."""
    kept = hits.where(F.col("pident") >= min_identity)
    nodes = kept.select(F.explode(F.array(query, subject)).alias("node")).distinct()
    unique = unique_edges(canonical_edges(kept, query, subject))
    summary = hits.agg(F.count(F.lit(1)).alias("hits"), F.count_if(F.col("pident") >= min_identity).alias("kept"), F.count_if(F.col(query) == F.col(subject)).alias("self_hits"))
    return unique, degrees(unique, nodes), summary


def significant(edges: DataFrame, min_identity: float = 30.0, mode: str = "bitscore", max_evalue: float = 0.1, min_bitscore: float = 30.0) -> DataFrame:
    """Edges of enough identity and, by mode, an evalue under the cap (any, if the cap is infinite) or a finite bitscore of at least the bound."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != F.lit(INFINITE))
    if mode == "evalue":
        rule = F.lit(True) if max_evalue == INFINITE else finite("evalue") & (F.col("evalue") <= max_evalue)
    elif mode == "bitscore":
        rule = finite("bitscore") & (F.col("bitscore") >= min_bitscore)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return edges.where((F.col("pident") >= min_identity) & rule)


def both_ways(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("a", "b")]
    return edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), *rest).union(edges.select(F.col("b").alias("src"), F.col("a").alias("dst"), *rest))


def min_degree_filter(edges: DataFrame, k: int) -> DataFrame:
    """Edges whose ends both have degree k or more, counted once and not again."""
    enough = degrees(edges).where(F.col("degree") >= k).select("node")
    return edges.join(enough.withColumnRenamed("node", "a"), "a", "left_semi").join(enough.withColumnRenamed("node", "b"), "b", "left_semi").select(*edges.columns)


def start_node(nodes: DataFrame, preferred: Column, allowed: Column) -> DataFrame:
    """The node of greatest (degree, id) of the preferred class, else of the allowed ones: a table of one row."""
    ranked = nodes.withColumn("_first", F.when(preferred, 0).when(allowed, 1)).where(F.col("_first").isNotNull())
    return ranked.orderBy("_first", F.desc("degree"), F.desc("node")).drop("_first").limit(1)


# ---- walks -----------------------------------------------------------------------------------------------------------------------


def bfs_walk(edges: DataFrame, root, max_depth: int | None = None) -> DataFrame:
    """(node, parent, weight, depth): the breadth-first tree of a first-in-first-out walk from `root`.

    A node's parent is the earliest queued neighbour of the level before; children queue by weight falling, finite evalue rising (others last)
    and id. `edges` has a, b, weight, evalue. A level is one join, one pre-aggregated minimum and a range-partitioned sort; its rows are materialised before the next.
    """
    spark = edges.sparkSession
    kind = edges.schema["a"].dataType.simpleString()
    out = cut(both_ways(edges.select("a", "b", "weight", "evalue")))
    finite = F.when(F.col("evalue").isNull() | F.isnan("evalue"), F.lit(INFINITE)).otherwise(F.col("evalue"))
    level = spark.createDataFrame([(root, None, None, 0, 0)], f"node {kind}, parent {kind}, weight double, depth int, ord long")
    levels, before = [level], level.limit(0)
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        # edges go both ways, so a level's neighbours are new or in one of the last two levels
        near = level.select(F.col("node").alias("dst")).union(before.select("node"))
        reach = out.join(level.select(F.col("node").alias("src"), "ord"), "src").join(near, "dst", "left_anti")
        best = F.min(F.struct(F.col("ord").alias("parent_ord"), (-F.col("weight")).alias("minus"), finite.alias("ev"), F.col("src").alias("parent"))).alias("best")
        found = reach.groupBy(F.col("dst").alias("node")).agg(best)
        keys = ["best.parent_ord", "best.minus", "best.ev", "node"]
        ordered = found.repartitionByRange(*keys).sortWithinPartitions(*keys)  # ids that ascend with the partitions keep the queue's order
        before, level = level, cut(ordered.select("node", F.col("best.parent").alias("parent"), (-F.col("best.minus")).alias("weight"), F.lit(depth).alias("depth"), F.monotonically_increasing_id().alias("ord")))
        if not level.take(1):
            break
        levels.append(level)
        if len(levels) > 32:  # a long chain of levels: written together once in a while
            levels = [cut(reduce(DataFrame.union, levels))]
    return reduce(DataFrame.union, levels).drop("ord")


def reachable(edges: DataFrame, predicate: Column | None = None) -> DataFrame:
    """(node, component) over the edges that satisfy the predicate: what a recursive walk from any node of a component visits."""
    kept = edges if predicate is None else edges.where(predicate)
    return connected_components(kept, "a", "b")


def _neighbours(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names, begins, near): the nodes in id order, and node k's neighbours near[begins[k]:begins[k + 1]], as places in `names`, ascending and once each.

    Some twenty bytes an edge, where sets of ids would take two hundred.
    """
    names = np.unique(np.append(a, b))
    n = len(names)
    x, y = np.searchsorted(names, a), np.searchsorted(names, b)
    ways = np.append(x * n + y, y * n + x)  # below 2 ** 63 for three thousand million nodes
    ways.sort()
    ways = ways[np.append(True, ways[1:] != ways[:-1])]
    return names, np.append(0, np.cumsum(np.bincount(ways // n, minlength=n))), (ways % n).astype(np.int32)


class _Ways:
    """The edges out of some nodes of one group, added in the order of (node, neighbour); a node is kept once, a neighbour in as few bytes as it needs."""

    BLOCK = 250_000

    def __init__(self) -> None:
        self.src: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.dst: list[np.ndarray] = []
        self.fresh: list[np.ndarray] = []  # of the last block, not yet one

    def add(self, src: np.ndarray, dst: np.ndarray) -> None:
        starts = np.flatnonzero(np.append(True, src[1:] != src[:-1]))
        self.src.append(src[starts])
        self.counts.append(np.diff(np.append(starts, len(src))))
        self.fresh.append(dst.copy())  # not a view of the batch
        if sum(map(len, self.fresh)) >= self.BLOCK:
            self.close()

    def close(self) -> None:
        if self.fresh:
            self.dst.append(np.concatenate(self.fresh))
            self.fresh = []

    def packed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(names, begins, ends, near) as in `_neighbours`; nodes without edges here have none. The blocks go on the way."""
        self.close()
        src, counts = np.concatenate(self.src), np.concatenate(self.counts)
        names = np.unique(src)
        for block in self.dst:
            names = np.union1d(names, block)
        places = np.searchsorted(names, src)
        total = np.bincount(places, weights=counts, minlength=len(names)).astype(np.int64)  # a node's edges may be in several batches
        ends = np.cumsum(total)
        near, at = np.empty(int(ends[-1]), np.int32), int(ends[-1])
        while self.dst:
            block = self.dst.pop()
            near[at - len(block) : at] = np.searchsorted(names, block)
            at -= len(block)
        return names, ends - total, ends, near


def _capped_walk(ways: _Ways, max_level: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, levels) in the order of the visits, the smallest node first."""
    names, at, ends, near = ways.packed()
    root = int(np.argmax(ends > at))  # the first with edges out
    level, order, stack = np.full(len(names), -1, np.int32), [np.array([root])], [root]
    level[root] = 0
    while stack and max_level:
        node = stack[-1]
        below = level[node] + 1
        if below == max_level:  # these are not left again: all at once
            found = near[at[node] : ends[node]]
            found = np.unique(found[level[found] < 0])
            level[found] = below
            order.append(found)
            stack.pop()
            continue
        while at[node] < ends[node] and level[near[at[node]]] >= 0:
            at[node] += 1
        if at[node] == ends[node]:
            stack.pop()
            continue
        found = int(near[at[node]])
        level[found] = below
        order.append(np.array([found]))
        stack.append(found)
    places = np.concatenate(order)
    return names[places], level[places]


def _capped_walks(batches: Iterator[pa.RecordBatch], group: str, max_level: int) -> Iterator[pa.RecordBatch]:
    """The walks of the groups of (group, src, dst) rows in this order; a group may go over many batches."""
    ways, key, kinds = None, None, None

    def done() -> pa.RecordBatch:
        nodes, levels = _capped_walk(ways, max_level)
        kind, of = kinds
        columns = [pa.array([key], of).take(pa.array(np.zeros(len(nodes), np.int32))), pa.array(nodes[:1].repeat(len(nodes)), kind), pa.array(nodes, kind), pa.array(levels)]
        return pa.RecordBatch.from_arrays(columns, names=[group, "root", "node", "level"])

    for batch in batches:
        if not batch.num_rows:
            continue
        groups, src, dst = batch.columns
        kinds = (src.type, groups.type)
        codes = groups.dictionary_encode(null_encoding="encode").indices.to_numpy()
        edges = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)]
        src, dst = src.to_numpy(zero_copy_only=False), dst.to_numpy(zero_copy_only=False)
        for i, j in zip(edges, edges[1:], strict=False):
            own = groups[i].as_py()
            if ways is not None and own != key:
                yield done()
                ways = None
            ways, key = ways or _Ways(), own
            ways.add(src[i:j], dst[i:j])
    if ways is not None:
        yield done()


def level_capped_walk(edges: DataFrame, group: str, max_level: int) -> DataFrame:
    """(group, root, node, level): depth-first visits from each group's smallest node, neighbours in id order, down to `max_level`.

    Only nodes less than `max_level` edges from the root can be left again, so a group's task gets the edges out of these alone, sorted,
    a batch at a time; it holds four to eight bytes for each of them.
    """
    rows = stored(edges.select(F.col(group).alias("g"), "a", "b").where(F.col("a").isNotNull() & F.col("b").isNotNull()))

    def out_of(inner: DataFrame) -> DataFrame:
        known = bounded(inner.select(F.col("g").alias("_g"), F.col("node").alias("_node")))
        one, two = (rows.join(known, F.col("g").eqNullSafe(F.col("_g")) & (F.col(x) == F.col("_node"))).select("g", F.col(x).alias("src"), F.col(y).alias("dst")) for x, y in ("ab", "ba"))
        return one.union(two)

    level = stored(rows.groupBy("g").agg(F.min(F.least("a", "b")).alias("node")))
    inner = level
    for _ in range(max_level - 1):
        seen = inner.select(F.col("g").alias("_g"), F.col("node").alias("_node"))
        near = out_of(level).select("g", F.col("dst").alias("node")).distinct()
        level = stored(near.join(seen, F.col("g").eqNullSafe(F.col("_g")) & (F.col("node") == F.col("_node")), "left_anti"))
        if not level.take(1):
            break
        inner = stored(inner.union(level))

    kinds = {f.name: f.dataType.simpleString() for f in edges.schema}
    ways = out_of(inner).repartition("g").sortWithinPartitions("g", "src", "dst")
    return ways.mapInArrow(lambda batches: _capped_walks(batches, group, max_level), f"{group} {kinds[group]}, root {kinds['a']}, node {kinds['a']}, level int")


def level_layout(tree: DataFrame, node: str = "node", parent: str = "parent", depth: str = "depth", gap_x: float = 80.0, gap_y: float = 120.0) -> DataFrame:
    """Adds x and y: the nodes of a level in (parent, node) order, centred on zero; y falls with depth."""
    own = Window.partitionBy(depth)
    place = F.row_number().over(own.orderBy(parent, node)) - 1
    width = F.count(F.lit(1)).over(own)
    return tree.withColumns({"x": (place - (width - 1) / 2) * gap_x, "y": -F.col(depth) * gap_y})


def layered_layout(nodes: DataFrame, depth: str = "depth", degree: str = "degree", node: str = "node", gap_x: float = 120.0, gap_y: float = 18.0) -> DataFrame:
    """Adds x and y: levels side by side, the nodes of a level by degree falling and id, centred on zero."""
    own = Window.partitionBy(depth)
    place = F.row_number().over(own.orderBy(F.desc(degree), node)) - 1
    height = F.count(F.lit(1)).over(own)
    return nodes.withColumns({"x": F.col(depth) * gap_x, "y": (place - (height - 1) / 2) * gap_y})


# ---- reduction -------------------------------------------------------------------------------------------------------------------


def select_components(sizes: DataFrame, budget: int, cap: int) -> DataFrame:
    """The largest components until the budget is met, each with its proportional share of it, held to 1..cap.

    `sizes` has component and size. A component is taken while those before it have not met the budget, so at most `budget` of the largest can be.
    """
    sizes = sizes.orderBy(F.desc("size"), "component").limit(budget)
    order = Window.orderBy(F.desc("size"), "component").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = sizes.withColumn("_ahead", F.sum("size").over(order) - F.col("size")).where(F.col("_ahead") < budget).drop("_ahead")
    total = F.sum("size").over(Window.partitionBy(F.lit(1)))
    return kept.withColumn("cap", F.least(F.lit(cap), F.greatest(F.lit(1), F.floor(budget * F.col("size") / total))).cast("long"))


def within_components(edges: DataFrame, parts: DataFrame, kept: DataFrame, min_weight: float = 0.0) -> DataFrame:
    """Edges inside one kept component and of enough weight, with their component; null weights are dropped."""
    inside = parts.join(kept.select("component"), "component", "left_semi")
    ends = edges.where(F.col("weight") >= min_weight).join(inside.select(F.col("node").alias("a"), "component"), "a")
    return ends.join(inside.select(F.col("node").alias("b"), F.col("component").alias("_other")), "b").where("component = _other").drop("_other")


def _roots(names: list) -> tuple[dict, callable]:
    up = {n: n for n in names}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    return up, find


def _forest(pdf: pd.DataFrame) -> pd.DataFrame:
    """Kruskal's maximum spanning forest; ties in weight by ends."""
    rows = pdf.sort_values(["weight", "a", "b"], ascending=[False, True, True], kind="stable")
    up, find = _roots(pd.unique(pd.concat([rows["a"], rows["b"]])).tolist())
    keep = []
    for a, b in zip(rows["a"].tolist(), rows["b"].tolist(), strict=True):
        x, y = find(a), find(b)
        keep.append(x != y)
        if x != y:
            up[x] = y
    return rows[keep]


def maximum_spanning_forest(edges: DataFrame, group_edges: int = GROUP_EDGES) -> DataFrame:
    """The edges (component, a, b, weight) of every component's maximum spanning tree, ties in weight by ends.

    Components of at most `group_edges` edges are solved one a group; larger ones together, by rounds.
    """
    columns = edges.select("component", "a", "b", "weight")
    sizes = cut(columns.groupBy("component").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > group_edges))
    small = columns.join(sizes, "component", "left_anti").groupBy("component").applyInPandas(_forest, columns.schema)
    if not sizes.take(1):
        return small
    large = columns.join(sizes.select("component"), "component")
    ends = large.select("component", F.col("a").alias("_node")).distinct()  # every edge has its first end here
    rounds = spanning_forest_by_rounds(large).join(ends, F.col("a") == F.col("_node")).select("component", "a", "b", "weight")
    return small.unionByName(rounds)


def spanning_forest_by_rounds(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(a, b, weight): the same forest without grouping: every part takes its best edge, parts merge, and so on (for components beyond one task).

    Edges are ordered by (weight falling, a, b), so no two are equal and the forest is that of Kruskal's order.
    """
    live = stored(edges.select("a", "b", "weight", F.col("a").alias("pa"), F.col("b").alias("pb")))
    chosen = None
    for _ in range(max_rounds):
        ends = live.select(F.explode(F.array("pa", "pb")).alias("part"), "a", "b", "weight", "pa", "pb")
        best = ends.groupBy("part").agg(F.min(F.struct((-F.col("weight")).alias("w"), F.col("a").alias("a"), F.col("b").alias("b"), F.col("pa").alias("pa"), F.col("pb").alias("pb"))).alias("e"))
        picked = stored(best.select("e.a", "e.b", (-F.col("e.w")).alias("weight"), "e.pa", "e.pb").distinct())
        chosen = picked.select("a", "b", "weight") if chosen is None else stored(chosen.union(picked.select("a", "b", "weight")).distinct())
        if not picked.take(1):
            return chosen
        merged = connected_components(picked, "pa", "pb")
        to = lambda c: merged.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))  # noqa: E731, B023
        live = live.join(to("pa"), "pa", "left").join(to("pb"), "pb", "left")
        live = stored(live.select("a", "b", "weight", F.coalesce("_pa", "pa").alias("pa"), F.coalesce("_pb", "pb").alias("pb")).where("pa <> pb"))
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")


def node_scores(edges: DataFrame, top: int = 3) -> DataFrame:
    """(node, score, degree): the sum of a node's `top` heaviest edges, and how many edges it has."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("node"), "weight", "a", "b")
    ranked = ends.withColumn("_n", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("weight"), "a", "b")))
    return ranked.groupBy("node").agg(F.sum(F.when(F.col("_n") <= top, F.col("weight"))).alias("score"), F.count(F.lit(1)).alias("degree"))


def prune_to_cap(forest: DataFrame, scores: DataFrame, caps: DataFrame) -> DataFrame:
    """Forest edges left after the lowest-scored leaves (ties by id) go, one by one, until a component is at its cap; a component may hold several trees.

    The order of removal is a component's own, so its forest, one row a node at most, is what one task holds.
    """
    rows = forest.join(caps.select("component", "cap"), "component")
    for end in ("a", "b"):
        rows = rows.join(scores.select(F.col("node").alias(end), F.col("score").alias(f"score_{end}")), end, "left")

    def prune(pdf: pd.DataFrame) -> pd.DataFrame:
        import heapq

        near: dict = {}
        score: dict = {}
        for a, b, sa, sb in zip(pdf["a"].tolist(), pdf["b"].tolist(), pdf["score_a"].tolist(), pdf["score_b"].tolist(), strict=True):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
            score[a], score[b] = sa, sb
        heap = [(score[n], n) for n, k in near.items() if len(k) <= 1]
        heapq.heapify(heap)
        cap = int(pdf["cap"].iloc[0])
        while len(near) > cap and heap:
            _, n = heapq.heappop(heap)
            for other in near.pop(n, ()):  # the last two nodes of a tree stand in the heap twice
                near[other].discard(n)
                if len(near[other]) == 1:
                    heapq.heappush(heap, (score[other], other))
        return pdf[pdf["a"].isin(near.keys()) & pdf["b"].isin(near.keys())][["component", "a", "b", "weight"]]

    return rows.groupBy("component").applyInPandas(prune, forest.select("component", "a", "b", "weight").schema)


def extra_edges(edges: DataFrame, backbone: DataFrame, per_node: int = 1) -> DataFrame:
    """Backbone edges and, node by node in id order, up to `per_node` more of its heaviest ones between nodes of the backbone.

    Edges with an end outside the backbone go before components are grouped, so a group is bounded by the component's cap.
    """
    inside = backbone.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    for end in ("a", "b"):
        edges = edges.join(inside.withColumnRenamed("node", end), end, "left_semi")
    marked = edges.select("component", "a", "b", "weight").join(backbone.select("a", "b", F.lit(1).alias("is_backbone")), ["a", "b"], "left").withColumn("is_backbone", F.coalesce("is_backbone", F.lit(0)))

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        spine = pdf[pdf["is_backbone"] == 1]
        inside = set(spine["a"]) | set(spine["b"])
        rest = pdf[(pdf["is_backbone"] == 0) & pdf["a"].isin(inside) & pdf["b"].isin(inside)].sort_values(["weight", "a", "b"], ascending=[False, True, True], kind="stable")
        by_node: dict = {}
        for at, a, b in zip(rest.index.tolist(), rest["a"].tolist(), rest["b"].tolist(), strict=True):
            by_node.setdefault(a, []).append(at)
            by_node.setdefault(b, []).append(at)
        taken: dict = {}
        for node in sorted(by_node):
            left = per_node
            for at in by_node[node]:
                if left and at not in taken:
                    taken[at] = True
                    left -= 1
        return pd.concat([spine, rest[rest.index.isin(taken.keys())]])[["component", "a", "b", "weight", "is_backbone"]]

    schema = marked.select("component", "a", "b", "weight", F.col("is_backbone").cast("int").alias("is_backbone")).schema
    return marked.groupBy("component").applyInPandas(pick, schema)


def reduce_network(edges: DataFrame, budget: int = 12_000, cap: int = 2_000, per_node: int = 1, min_weight: float = 0.0, min_degree: int = 0) -> DataFrame:
    """(component, a, b, weight, evalue, bitscore, is_backbone): the reduced graph, with the best statistics of parallel edges."""
    pairs = edges.where(F.col("a") != F.col("b")).groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("weight").alias("weight"), F.min("evalue").alias("evalue"), F.max("bitscore").alias("bitscore"))
    pairs = cut(pairs)
    parts = cut(connected_components(pairs, "a", "b"))
    kept = select_components(parts.groupBy("component").agg(F.count(F.lit(1)).alias("size")), budget, cap)
    inside = cut(within_components(pairs, parts, kept, min_weight))
    forest = cut(maximum_spanning_forest(inside))
    spine = cut(prune_to_cap(forest, node_scores(inside), kept))
    chosen = extra_edges(inside, spine, per_node)
    if min_degree > 0:
        chosen = min_degree_filter(chosen, min_degree)
    return chosen.join(pairs.select("a", "b", "evalue", "bitscore"), ["a", "b"]).select("component", "a", "b", "weight", "evalue", "bitscore", "is_backbone")


def _covered(links: pd.DataFrame) -> pd.DataFrame:
    """The places of `links` that are linked with a representative before them, taken in turn: a place that isn't becomes one."""
    names, begins, near = _neighbours(links["src"].to_numpy(), links["dst"].to_numpy())
    covered = np.zeros(len(names), bool)
    for node in range(len(names)):
        if not covered[node]:
            covered[near[begins[node] : begins[node + 1]]] = True  # those before it are covered already
    return pd.DataFrame({"src": names[covered]})


def priority_clusters(edges: DataFrame, nodes: DataFrame, classes: Sequence[str], group_edges: int = GROUP_EDGES) -> DataFrame:
    """(node, representative): classes in turn, so earlier classes keep their representatives when later ones are added.

    Within a class the longest node comes first (ties by id). A node joins the representative it is linked with most heavily, of equal ones
    the greatest id, else it becomes one. `nodes` has node, class, length (a repeated node counts by its first row in that order); `edges`
    has a, b, weight above the clustering thresholds.

    Who is a representative is settled in rounds over all nodes: of the open links, ends that no link goes on from to an earlier node are
    representatives, what is linked with them is covered, and its links go. The last `group_edges` links are settled by one task.
    """
    rank = F.create_map(*[F.lit(x) for kv in {c: k for k, c in enumerate(classes)}.items() for x in kv])
    first = F.min(F.struct(rank[F.col("class")].alias("rank"), F.col("length").isNull().alias("none"), (-F.col("length")).alias("minus"))).alias("first")
    people = numbered(nodes.where(F.col("class").isin(*classes)).groupBy("node").agg(first), ["first.rank", "first.none", "first.minus", "node"], "place")
    people = stored(people.select("node", "place"))
    known = bounded(people)
    one, two = (known.select(F.col("node").alias(x), F.col("place").alias(f"p_{x}")) for x in ("a", "b"))
    weight = F.coalesce(F.col("weight"), F.lit(float("nan")))  # a missing weight is the heaviest
    links = stored(edges.where(F.col("a") != F.col("b")).join(one, "a").join(two, "b").select(F.greatest("p_a", "p_b").alias("src"), F.least("p_a", "p_b").alias("dst"), weight.alias("weight")))
    open_, covered = links.select("src", "dst"), None
    while (rest := open_.limit(group_edges + 1).count()) > group_edges:
        heads = open_.select("dst").distinct().join(open_.select(F.col("src").alias("dst")).distinct(), "dst", "left_anti")
        hit = stored(open_.join(heads, "dst", "left_semi").select("src").distinct())
        covered = hit if covered is None else stored(covered.union(hit))
        open_ = stored(open_.join(hit, "src", "left_anti").join(hit.withColumnRenamed("src", "dst"), "dst", "left_anti"))
    if rest:
        last = open_.select("src", "dst").groupBy().applyInPandas(_covered, "src long")
        covered = stored(last if covered is None else covered.union(last))
    if covered is None:
        return people.select("node", F.col("node").alias("representative"))
    heads = people.join(covered.withColumnRenamed("src", "place"), "place", "left_anti").select(F.col("node").alias("head"), F.col("place").alias("dst"))
    best = links.join(bounded(stored(heads)), "dst").groupBy("src").agg(F.max(F.struct("weight", "head")).alias("best"))
    return people.join(best.withColumnRenamed("src", "place"), "place", "left").select("node", F.coalesce("best.head", "node").alias("representative"))


# ---- charges and classes ---------------------------------------------------------------------------------------------------------


def neighbour_parity(edges: DataFrame, charges: DataFrame) -> DataFrame:
    """(node, parity, degree): the sum over a node's neighbours of its charge times theirs."""
    own, other = charges.select(F.col("node").alias("src"), F.col("charge").alias("c1")), charges.select(F.col("node").alias("dst"), F.col("charge").alias("c2"))
    return both_ways(edges.select("a", "b")).join(own, "src").join(other, "dst").groupBy(F.col("src").alias("node")).agg(F.sum(F.col("c1") * F.col("c2")).alias("parity"), F.count(F.lit(1)).alias("degree"))


def tight_bonds(edges: DataFrame, nodes: DataFrame, max_distance: float = 4.0) -> DataFrame:
    """(a, b, kind, distance): ion pairs and disulfides among neighbours closer than `max_distance`, each pair once. `nodes` has node, residue, charge."""
    one, two = (nodes.select(F.col("node").alias(e), F.col("residue").alias(f"res_{e}"), F.col("charge").alias(f"q_{e}")) for e in ("a", "b"))
    rows = edges.where(F.col("distance") < max_distance).join(one, "a").join(two, "b")
    kind = F.when((F.col("res_a") == "CYS") & (F.col("res_b") == "CYS"), "disulfide").when(F.col("q_a") * F.col("q_b") < 0, "ion_pair")
    pairs = rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), kind.alias("kind"), "distance").where(F.col("kind").isNotNull())
    return pairs.groupBy("a", "b", "kind").agg(F.min("distance").alias("distance"))


def parity_networks(edges: DataFrame, charges: DataFrame, same: bool = True, lost: DataFrame | None = None, max_length: float | None = None) -> DataFrame:
    """(node, component) of networks larger than one node whose edges join equal (or opposite) charges; `lost` edges up to a length come back first."""
    if lost is not None:
        back = lost if max_length is None else lost.where(F.col("distance") <= max_length)
        edges = edges.select("a", "b").union(back.join(edges.select("a", "b"), ["a", "b"], "left_anti").select("a", "b"))
    one, two = charges.select(F.col("node").alias("a"), F.col("charge").alias("q_a")), charges.select(F.col("node").alias("b"), F.col("charge").alias("q_b"))
    product = F.col("q_a") * F.col("q_b")
    return connected_components(edges.join(one, "a").join(two, "b").where(product > 0 if same else product < 0), "a", "b")


def class_networks(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, node, component): networks within one class; a node without such an edge is a network of its own."""
    one, two = classes.select(F.col("node").alias("a"), F.col("class").alias("class")), classes.select(F.col("node").alias("b"), F.col("class").alias("_other"))
    inside = edges.join(one, "a").join(two, "b").where("class = _other")
    parts = connected_components(inside, "a", "b")
    return classes.join(parts, "node", "left").select("class", "node", F.coalesce("component", "node").alias("component"))


def vertex_mixing(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, label, same_edges, mixed_edges): every undirected edge counts for both its ends; a vertex may have edges of both kinds."""
    one, two = labels.select(F.col("node").alias("src"), F.col("label").alias("label")), labels.select(F.col("node").alias("dst"), F.col("label").alias("_other"))
    rows = both_ways(edges.select("a", "b")).join(one, "src").join(two, "dst")
    return rows.groupBy(F.col("src").alias("node"), "label").agg(F.count_if(F.col("label") == F.col("_other")).alias("same_edges"), F.count_if(F.col("label") != F.col("_other")).alias("mixed_edges"))


def mixing_summary(mixed: DataFrame) -> DataFrame:
    """Per label: vertices, those with mixed and with same edges, and their shares."""
    out = mixed.groupBy("label").agg(F.count(F.lit(1)).alias("vertices"), F.count_if(F.col("mixed_edges") > 0).alias("mixed_vertices"), F.count_if(F.col("same_edges") > 0).alias("same_vertices"))
    return out.withColumns({"mixed_fraction": F.col("mixed_vertices") / F.col("vertices"), "same_fraction": F.col("same_vertices") / F.col("vertices")})


def ranked(rows: DataFrame, value: str, key: str) -> DataFrame:
    """Adds place, 1 for the largest value, ties by key: rows of one value are ranked together and the values' counts summed ahead of them."""
    counts = rows.groupBy(F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))  # a row a distinct value
    ahead = Window.orderBy(F.desc("_v")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = counts.select("_v", (F.sum("_c").over(ahead) - F.col("_c")).alias("_before"))
    place = F.row_number().over(Window.partitionBy(value).orderBy(key)) + F.col("_before")
    return rows.join(before, F.col(value) == F.col("_v")).withColumn("place", place.cast("int")).drop("_v", "_before")


def clustered(edges: DataFrame, max_distance: float, min_size: int) -> DataFrame:
    """(node, component, size): components over edges shorter than the cutoff with at least `min_size` nodes."""
    parts = cut(connected_components(edges.where(F.col("distance") < max_distance), "a", "b"))
    sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= min_size)
    return parts.join(sizes, "component").select("node", "component", "size")


def minimised(edges: DataFrame, max_distance: float = INFINITE) -> DataFrame:
    """(component, a, b, distance): each network without loops, joined up by shortest edges.

    Every part takes its shortest edge out and parts merge, round by round; with edges ordered by (distance, a, b) the result is the
    minimum spanning forest over edges up to `max_distance`.
    """
    kept = edges.where(F.col("distance") <= max_distance).select(F.col("component"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (-F.col("distance")).alias("weight")).distinct()
    return maximum_spanning_forest(kept).select("component", "a", "b", (-F.col("weight")).alias("distance"))
