"""Spatial joins on grid cells, and what is built from them.

Points within r of each other lie in the same or neighbouring cells of size r: the right side is copied to its 27 neighbour cells, the sides meet
in an equi-join on the cell, and the exact predicate follows; callers put the smaller side on the right. No pair of far points is formed, and a dense cell is a join key that adaptive
execution can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataline.functions import geometry as G
from strataline.session import cut


def cell(c: str, size: float) -> Column:
    return F.floor(F.col(c) / size).cast("long")


def within(left: DataFrame, right: DataFrame, radius: float, on: tuple[str, ...] = (), coords: tuple[str, ...] = ("x", "y", "z"), closed: bool = False) -> DataFrame:
    """Pairs of rows nearer than `radius` (or as near, if closed), with `distance`; right's columns get the prefix r_. `on` names equal columns."""
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    near = r
    for c in coords:
        near = near.withColumn(f"_{c}", F.explode(F.array(*[cell(f"r_{c}", radius) + k for k in (-1, 0, 1)])))
    own = left.withColumns({f"_{c}": cell(c, radius) for c in coords})
    rule = [F.col(f"l.{k}") == F.col(f"r.r_{k}") for k in on] + [F.col(f"l._{c}") == F.col(f"r._{c}") for c in coords]
    squared = sum(((F.col(c) - F.col(f"r_{c}")) * (F.col(c) - F.col(f"r_{c}")) for c in coords), F.lit(0.0))
    out = own.alias("l").join(near.alias("r"), rule).select(*[F.col(f"l.{c}") for c in left.columns], *[F.col(f"r.{c}") for c in r.columns]).withColumn("distance", F.sqrt(squared))
    return out.where(F.col("distance") <= radius if closed else F.col("distance") < radius)


def last_contacts(query: DataFrame, hits: DataFrame, radius: float = 6.0) -> DataFrame:
    """Each query residue with the last (by number) hit residue within the radius."""
    pairs = within(query, hits, radius)
    return pairs.groupBy("id").agg(F.max("r_id").alias("hit"))


def clear_of(points: DataFrame, atoms: DataFrame, radius: float) -> DataFrame:
    """Points without any atom nearer than the radius."""
    clash = within(points, atoms.select("x", "y", "z"), radius).select("id").distinct()
    return points.join(clash, "id", "left_anti")


def interfaces(residues: DataFrame, radius: float = 8.0, classes: tuple[int, ...] = (0, 1)) -> DataFrame:
    """(chain, other, residues): residues of one chain near another's, exposed or margin only, each pair of chains once."""
    rows = residues.where(F.col("burial").isin(*classes)) if "burial" in residues.columns else residues
    pairs = within(rows, rows, radius).where(F.col("chain") < F.col("r_chain"))
    return pairs.groupBy("chain", F.col("r_chain").alias("other")).agg(F.count(F.lit(1)).alias("contacts"), F.countDistinct("id").alias("residues"), F.min("distance").alias("nearest"))


def nearest(left: DataFrame, right: DataFrame, radius: float, key: str = "id", coords: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """(key, nearest, distance): the nearest right row of each left row, ties by id; rows without one within the radius are looked for within twice that, and so on.

    The radius ends beyond the diagonal of what both sides span, where every row has found its own; an empty right side gives an empty result.
    """
    best = lambda pairs: pairs.groupBy(key).agg(F.min(F.struct("distance", F.col(f"r_{key}").alias("nearest"))).alias("b")).select(key, "b.nearest", "b.distance")
    ends = left.select(*coords).union(right.select(*coords)).agg(*[F.max(c) - F.min(c) for c in coords]).first()
    reach, done, rest = sum(float(e or 0) ** 2 for e in ends) ** 0.5, None, left
    while True:
        found = cut(best(within(rest, right, radius)))
        done = found if done is None else cut(done.union(found))
        rest = cut(rest.join(found.select(key), key, "left_anti"))
        if radius > reach or not rest.take(1):
            return done
        radius *= 2


def contact_counts(points: DataFrame, radius: float = 8.0, apart: int = 2) -> DataFrame:
    """(id, contacts) within the radius, the `apart` neighbours on either side left out; points without contacts have 0."""
    pairs = within(points, points, radius).where(F.abs(F.col("id") - F.col("r_id")) > apart)
    n = pairs.groupBy("id").agg(F.count(F.lit(1)).alias("contacts"))
    return points.select("id").join(n, "id", "left").withColumn("contacts", F.coalesce("contacts", F.lit(0).cast("long")))


def run_contacts(runs: DataFrame, points: DataFrame, radius: float = 5.0) -> DataFrame:
    """(run, other): pairs of runs with some pair of points nearer than the radius. `points` has id, run, x, y, z."""
    rows = points.join(runs.select("run"), "run", "left_semi").select("id", "run", "x", "y", "z")
    return within(rows, rows, radius).where(F.col("run") < F.col("r_run")).select("run", F.col("r_run").alias("other")).distinct()


def chain_distances(edges: DataFrame, atoms: DataFrame, fuzzy: tuple[str, ...] = ("HOH", "ARG", "LYS", "CYS")) -> DataFrame:
    """(a, b, distance): the least distance between the atoms of two nodes, half a unit less for each fuzzy residue. `atoms` has node, residue, x, y, z."""
    one, two = (atoms.select(F.col("node").alias(e), F.col("residue").alias(f"res_{e}"), F.struct("x", "y", "z").alias(f"p_{e}")) for e in ("a", "b"))
    j = edges.select("a", "b").join(one, "a").join(two, "b")
    fuzz = sum((F.when(F.col(f"res_{e}").isin(*fuzzy), 0.5).otherwise(0.0) for e in ("a", "b")), F.lit(0.0))
    return j.groupBy("a", "b").agg(F.min(G.distance(F.col("p_a"), F.col("p_b")) - fuzz).alias("distance"))


def hull_distances(points: DataFrame, facets: DataFrame, on: str) -> DataFrame:
    """(points' columns, plane, distance): every point with the facets of its own hull (equal `on`), and its signed distance to their planes; outside is positive."""
    planes = facets.select(on, "plane")
    return points.join(planes, on).withColumn("distance", G.plane_distance(F.struct("x", "y", "z"), F.col("plane")))


def inside_hull(points: DataFrame, facets: DataFrame, on: str, swell: float = 0.0) -> DataFrame:
    """Points beneath every facet of their hull (equal `on`), moved out by `swell`. `facets` has an outward plane; a point without a hull is in none."""
    held = hull_distances(points, facets, on).groupBy(on, "id").agg(F.max("distance").alias("_d"))
    return points.join(held.where(F.col("_d") <= swell + G.TOLERANCE).select(on, "id"), [on, "id"], "left_semi")


def terminal_atoms(atoms: DataFrame, wanted: DataFrame) -> DataFrame:
    """(structure, chain, resnum, x, y, z): the mean of a residue's terminal atoms; none if any of them is missing. `wanted` has resname, atom_name."""
    need = wanted.groupBy("resname").agg(F.count(F.lit(1)).alias("_need"))
    last = Window.partitionBy("structure", "chain", "resnum", "atom_name").orderBy(F.desc("line_no"))
    own = atoms.withColumn("_n", F.row_number().over(last)).where("_n = 1").join(wanted, ["resname", "atom_name"]).join(need, "resname")
    return own.groupBy("structure", "chain", "resnum", "_need").agg(F.count(F.lit(1)).alias("_have"), *[F.avg(c).alias(c) for c in "xyz"]).where("_have = _need").drop("_have", "_need")


def sampling_grid(facets: DataFrame, step: float, steps: int) -> DataFrame:
    """(facet, k, x, y, z): points along each facet's normal from its centre, `steps` inwards and outwards. `facets` has facet, centre, normal."""
    rows = facets.withColumn("k", F.explode(F.sequence(F.lit(-steps), F.lit(steps))))
    return rows.withColumn("p", G.offset(F.col("centre"), F.col("normal"), F.col("k") * step)).select("facet", "k", "p.x", "p.y", "p.z")


def divided_facets(facets: DataFrame, max_area: float, corners: tuple[str, str, str] = ("pa", "pb", "pc")) -> DataFrame:
    """Facets as parts of at most `max_area`: each side is cut into equal steps, which gives steps^2 triangles of equal area. Adds part, q1, q2, q3 and area."""
    a, b, c = (F.col(k) for k in corners)
    whole = G.triangle_area(a, b, c)
    steps = F.greatest(F.lit(1), F.ceil(F.sqrt(whole / max_area))).cast("int")
    rows = facets.withColumns({"_n": steps, "_area": whole}).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).withColumn("_j", F.explode(F.sequence(F.lit(0), 2 * (F.col("_n") - F.col("_i")) - 2)))
    at = lambda i, j: G.point(*[a[k] + (b[k] - a[k]) * i / F.col("_n") + (c[k] - a[k]) * j / F.col("_n") for k in "xyz"])
    i, j, odd = F.col("_i"), F.floor(F.col("_j") / 2), F.col("_j") % 2
    up = F.struct(at(i, j).alias("q1"), at(i + 1, j).alias("q2"), at(i, j + 1).alias("q3"))
    down = F.struct(at(i + 1, j).alias("q1"), at(i + 1, j + 1).alias("q2"), at(i, j + 1).alias("q3"))
    rows = rows.withColumn("_q", F.when(odd == 0, up).otherwise(down))
    part = (F.col("_i") * (2 * F.col("_n") - F.col("_i")) + F.col("_j")).cast("int").alias("part")
    return rows.select(*facets.columns, part, "_q.q1", "_q.q2", "_q.q3", (F.col("_area") / (F.col("_n") * F.col("_n"))).alias("area"))
