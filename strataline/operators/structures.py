"""Structures: selections of a residue's atoms, secondary-structure cores, difference topologies, and networks of side chains and voids.

Atom tables are those of the structure scans: structure, chain, resnum, resname, atom_name, altloc, line_no, x, y, z. Everything is keyed by
structure, so any number of them is one plan; only triangulations and the in-place revision of flags run once a structure.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataline.functions import geometry as G
from strataline.functions import text as T
from strataline.operators import kernels as K
from strataline.operators import network as N
from strataline.operators import spatial as S
from strataline.operators import windows as W
from strataline.plans.components import connected_components
from strataline.session import cut

# fixed values: backbone names, residues by kind, the atom before a side chain's last one, residues whose reach is taken from one atom
BACKBONE = ("N", "CA", "C", "O", "D", "H", "DA")
ACTIVE = ("GLY", "ARG", "ASP", "GLU", "HIS", "LYS", "CYS", "SER", "TYR", "THR", "PHE", "TRP")
PRETERMINAL = {
    "ALA": "CA", "ARG": "CZ", "ASN": "CG", "ASP": "CG", "CYS": "CB", "GLN": "CD", "GLU": "CD", "HIS": "CG", "ILE": "CG1", "LEU": "CG",
    "LYS": "CE", "MET": "SD", "PHE": "CB", "PRO": "CA", "SER": "CB", "THR": "CB", "TRP": "CB", "TYR": "CZ", "VAL": "CB",
}
KINDS = {
    "nonpolar": T.APOLAR, "polar": T.POLAR, "ionizable": T.IONIZABLE, "nonpolar-polar": T.APOLAR + T.POLAR, "nonpolar-ionizable": T.APOLAR + T.IONIZABLE,
    "polar-ionizable": T.POLAR + T.IONIZABLE, "active": ACTIVE,
}
RESIDUE = ("structure", "chain", "resnum", "resname")


# ---- selections ------------------------------------------------------------------------------------------------------------------


def latest(atoms: DataFrame) -> DataFrame:
    """One row an atom name of a residue: of repeated ones and alternate places the last in the file."""
    last = Window.partitionBy(*RESIDUE, "atom_name").orderBy(F.desc("line_no"))
    return atoms.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def of_kind(atoms: DataFrame, kind: str = "all") -> DataFrame:
    """Atoms of residues of a kind: all, nonpolar, polar, ionizable, two of them joined by a hyphen, or active."""
    return atoms if kind == "all" else atoms.where(F.col("resname").isin(*KINDS[kind]))


def c_alphas(atoms: DataFrame, kind: str = "all") -> DataFrame:
    return of_kind(latest(atoms).where(F.col("atom_name") == "CA"), kind)


def backbone_atoms(atoms: DataFrame, kind: str = "all") -> DataFrame:
    return of_kind(latest(atoms).where(F.col("atom_name").isin(*BACKBONE)), kind)


def polar_atoms(atoms: DataFrame, kind: str = "all") -> DataFrame:
    """Oxygen, nitrogen and sulphur, by the first letter of the name."""
    return of_kind(latest(atoms).where(F.substring("atom_name", 1, 1).isin("O", "N", "S")), kind)


def sidechain_atoms(atoms: DataFrame, kind: str = "all") -> DataFrame:
    """Atoms outside the backbone; a glycine is its CA."""
    own = ~F.col("atom_name").isin(*BACKBONE) | ((F.col("resname") == "GLY") & (F.col("atom_name") == "CA"))
    return of_kind(latest(atoms).where(own), kind)


def preterminal_atoms(atoms: DataFrame, kind: str = "all") -> DataFrame:
    """The atom before the last of each side chain; the CA of a residue with alternate places."""
    name = F.create_map(*[F.lit(x) for kv in PRETERMINAL.items() for x in kv])[F.col("resname")]
    several = F.max(F.coalesce(F.col("altloc"), F.lit("")) != "").over(Window.partitionBy(*RESIDUE))
    rows = latest(atoms.withColumn("_alt", several))
    return of_kind(rows.where(F.col("atom_name") == F.when(F.col("_alt"), "CA").otherwise(name)).drop("_alt"), kind)


def centres(atoms: DataFrame) -> DataFrame:
    """(structure, chain, resnum, resname, x, y, z): the mean of each residue's atoms of a selection."""
    return atoms.groupBy(*RESIDUE).agg(*[F.avg(c).alias(c) for c in "xyz"])


def largest_gaps(atoms: DataFrame) -> DataFrame:
    """(structure, chain, max_gap): the largest step between a chain's neighbouring residue numbers, 1 at least."""
    rows = atoms.select("structure", "chain", "resnum").distinct()
    step = F.col("resnum") - F.lag("resnum").over(Window.partitionBy("structure", "chain").orderBy("resnum"))
    return rows.withColumn("_step", step).groupBy("structure", "chain").agg(F.greatest(F.lit(1), F.max("_step")).alias("max_gap"))


def ligand_atoms(atoms: DataFrame, water: Sequence[str] = ("HOH",), hydrogens: bool = False) -> DataFrame:
    """Atoms of hetero groups but water, each group named in `ligand`; hydrogens only if asked for."""
    rows = latest(atoms.where((F.col("record") == "HETATM") & ~F.col("resname").isin(*water)))
    if not hydrogens:
        rows = rows.where(F.upper(F.regexp_replace("atom_name", "^[0-9]+", "")).substr(1, 1) != "H")
    return rows.withColumn("ligand", F.concat_ws(":", "structure", "chain", "resnum", "resname"))


# ---- secondary-structure core ----------------------------------------------------------------------------------------------------


def in_runs(df: DataFrame, group: Sequence[str], position: str, tolerance: int, longer_than: int) -> DataFrame:
    """Rows in runs of positions at most `tolerance` apart, of more than `longer_than` and at least two rows, with `run`."""
    order = Window.partitionBy(*group).orderBy(position)
    new = F.when(F.col(position) - F.lag(position).over(order) <= tolerance, 0).otherwise(1)
    rows = df.withColumn("_new", new).withColumn("run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    size = F.count(F.lit(1)).over(Window.partitionBy(*group, "run"))
    return rows.withColumn("_n", size).where((F.col("_n") > longer_than) & (F.col("_n") > 1)).drop("_new", "_n")


def secondary_core(ca: DataFrame, *, helix: tuple[float, float] = (2.75, 3.25), contact: float = 8.0, stretch: float = 6.0, apart: float = 5.0, near: float = 6.0, helix_run: int = 8, sheet_run: int = 4) -> DataFrame:
    """(structure, resnum, kind): residues in helices and sheets. `ca` has structure, resnum, x, y, z, one row a residue.

    Helices: windows of four whose circumsphere's radius lies in `helix`, in runs of more than `helix_run` with gaps of two. Sheets, among the rest in
    order: residues with some other, not among the two before or after, within `contact`, and farther than `stretch` from the third after; in
    runs of more than `sheet_run` without gaps; that come within `apart` of another run; without the ends that no residue more than four numbers
    off, of these runs, comes within `near` of.
    """
    point = lambda s: G.point(s["x"], s["y"], s["z"])
    group = ["structure"]
    rows = ca.select("structure", "resnum", "x", "y", "z")

    def tight(at) -> Column:
        return F.exists(F.array(G.circumsphere(*[point(at(k)) for k in range(4)])["radius"]), lambda r: (r > helix[0]) & (r < helix[1]))

    helices = cut(in_runs(W.marked_windows(rows, group, "resnum", 4, tight), group, "resnum", 2, helix_run).drop("run"))
    order = Window.partitionBy("structure").orderBy("resnum")
    rest = rows.join(helices.select("structure", "resnum"), ["structure", "resnum"], "left_anti")
    rest = rest.withColumns({"nth": F.row_number().over(order) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy("structure")), "_third": F.lead(F.struct("x", "y", "z"), 3).over(order)})
    rest = cut(rest.withColumn("far", G.distance(G.point(F.col("x"), F.col("y"), F.col("z")), point(F.col("_third"))) > stretch).drop("_third"))
    touching = S.within(rest.select("structure", "nth", "x", "y", "z"), rest.select("structure", "nth", "x", "y", "z"), contact, ("structure",)).where(F.abs(F.col("nth") - F.col("r_nth")) > 2).select("structure", "nth").distinct()
    strands = rest.where((F.col("nth") >= 2) & (F.col("nth") < F.col("n") - 3) & F.col("far")).join(touching, ["structure", "nth"], "left_semi")
    strands = cut(in_runs(strands.select("structure", "resnum", "x", "y", "z"), group, "resnum", 1, sheet_run))
    kept = S.within(strands, strands, apart, ("structure",)).where(F.col("run") != F.col("r_run")).select("structure", "run").distinct()
    strands = cut(strands.join(kept, ["structure", "run"], "left_semi"))
    held = S.within(strands, strands, near, ("structure",)).where(F.abs(F.col("resnum") - F.col("r_resnum")) > 4).select("structure", "resnum").distinct().withColumn("held", F.lit(True))
    sheets = W.trimmed_runs(strands.join(held, ["structure", "resnum"], "left").withColumn("held", F.coalesce("held", F.lit(False))), ["structure", "run"], "resnum", "held")
    return helices.select("structure", "resnum", F.lit("helix").alias("kind")).union(sheets.select("structure", "resnum", F.lit("sheet")))


def core_scores(ca: DataFrame, core: DataFrame) -> DataFrame:
    """(structure, n, helix, sheet, score): the share of residues in the core; without any residue there is no row."""
    parts = core.groupBy("structure").agg(F.count_if(F.col("kind") == "helix").alias("helix"), F.count_if(F.col("kind") == "sheet").alias("sheet"))
    out = ca.groupBy("structure").agg(F.count(F.lit(1)).alias("n")).join(parts, "structure", "left").na.fill(0, ["helix", "sheet"])
    return out.withColumn("score", (F.col("helix") + F.col("sheet")) / F.col("n"))


# ---- difference topology ---------------------------------------------------------------------------------------------------------


def difference_topology(query: DataFrame, hit: DataFrame, *, radius: float = 6.0, mark: int = 15, at_most: int = 5, gap_share: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """(scores, flags): how a hit's fold covers a query's, pair by pair. Both sides have pair, resnum, x, y, z.

    Every query residue takes the last hit residue within `radius`. Short covered stretches go, covered runs of at most `at_most` distinct hit
    residues go, the hit residues between a kept run's first and last count as covered, and short uncovered stretches of the hit are
    filled. scores: pair, n, covered, coverage, n_truncation, c_truncation, gaps and gap_share (of gaps above `gap_share` of the query).
    flags: pair, side (query or hit), resnum, covered.
    """
    key = ["pair"]
    near = S.within(query, hit, radius, ("pair",)).groupBy("pair", "resnum").agg(F.max("r_resnum").alias("target"))
    rows = cut(query.select("pair", "resnum").join(near, ["pair", "resnum"], "left"))
    first = rows.select("pair", F.col("target").alias("resnum")).where("resnum is not null").distinct()
    flags = W.revised_flags(rows.withColumn("covered", F.col("target").isNotNull()), key, "resnum", "covered", False)
    rows = cut(rows.join(flags, ["pair", "resnum"]).withColumn("target", F.when(F.col("covered"), F.col("target"))).drop("covered"))
    runs = cut(W.run_diversity(rows, key, "resnum", "target", at_most))
    dropped = runs.where(~F.col("kept")).select(F.col("pair").alias("_p"), "first", "last")
    inside = (F.col("pair") == F.col("_p")) & F.col("resnum").between(F.col("first"), F.col("last"))
    out = rows.join(dropped, inside, "left").select("pair", "resnum", (F.col("target").isNotNull() & F.col("_p").isNull()).alias("covered"))
    out = cut(out)
    more = W.filled_targets(runs, key).select("pair", F.col("target").alias("resnum"))
    met = first.union(more).distinct().withColumn("covered", F.lit(True))
    hits = hit.select("pair", "resnum").join(met, ["pair", "resnum"], "left").withColumn("covered", F.coalesce("covered", F.lit(False)))
    hits = W.revised_flags(hits, key, "resnum", "covered", True)
    scores = W.running_coverage(out, key, "resnum", "covered", mark)
    gaps = W.coverage_gaps(out, key, "resnum", "covered", gap_share).groupBy("pair").agg(F.count(F.lit(1)).alias("gaps"), F.sum("gap").alias("_gap"))
    scores = scores.join(gaps, "pair", "left").withColumns({"gaps": F.coalesce("gaps", F.lit(0).cast("long")), "gap_share": F.coalesce(F.col("_gap") / F.col("n"), F.lit(0.0))}).drop("_gap")
    sides = out.select("pair", F.lit("query").alias("side"), "resnum", "covered").union(hits.select("pair", F.lit("hit"), "resnum", "covered"))
    return scores, sides


# ---- networks --------------------------------------------------------------------------------------------------------------------


def pruned_networks(edges: DataFrame, nodes: DataFrame, distances: DataFrame, max_distance: float, min_distance: float = 0.0) -> DataFrame:
    """(node, component): networks over a triangulation's edges whose side chains come nearer than `max_distance` (and, if a least one is given, not as near as that).

    `distances` has a, b, distance; a node without such an edge is a network of its own.
    """
    kept = F.col("distance") < max_distance
    if min_distance:
        kept &= F.col("distance") > min_distance
    parts = connected_components(edges.select("a", "b").join(distances.where(kept), ["a", "b"], "left_semi"), "a", "b")
    return nodes.select("node").join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def void_networks(points: DataFrame, atoms: DataFrame, group: str, *, clash: float, max_edge: float, min_edge: float = 0.0, min_size: int = 1) -> tuple[DataFrame, DataFrame]:
    """(networks, edges) of the voids between atoms: sampling points clear of every atom are triangulated, edges outside the lengths go, networks of more than `min_size` points stay, without loops.

    `points` has `group` and id, x, y, z; networks: component, size and place, largest first; edges: component, a, b, distance.
    """
    clear = cut(S.clear_of(points, atoms, clash))
    edges = K.triangulated(clear, group, max_edge=max_edge).where(F.col("distance") > min_edge if min_edge else F.lit(True)).select("a", "b", "distance")
    edges = cut(edges)
    parts = cut(connected_components(edges, "a", "b"))
    sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > min_size)
    inside = edges.join(parts.withColumnRenamed("node", "a"), "a").join(sizes.select("component"), "component", "left_semi")
    return N.ranked(sizes, "size", "component"), N.minimised(inside.select("component", "a", "b", "distance"))
