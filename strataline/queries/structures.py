"""Structure queries: a hundred embeddings are a structure, a helix and five strands bent a little by the vectors' numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataline.operators import kernels as K
from strataline.operators import spatial as S
from strataline.operators import structures as P
from strataline.queries import query
from strataline.queries.geometry import points
from strataline.session import table

CA = """raw AS (SELECT vec_id // 100 AS structure, vec_id % 100 AS i, (vec_id % 100 - 40) // 12 AS j, (vec_id % 100 - 40) % 12 AS k, CAST(embedding[1] AS DOUBLE) AS e1, CAST(embedding[2] AS DOUBLE) AS e2, CAST(embedding[3] AS DOUBLE) AS e3 FROM embeddings),
ca AS (SELECT structure, CASE WHEN i < 40 THEN i ELSE i + 3 * (j + 1) END AS resnum, CASE WHEN i < 40 THEN 2.3 * cos(1.7453 * i) ELSE 20 + 4.8 * j END + 0.3 * e1 AS x,
  CASE WHEN i < 40 THEN 2.3 * sin(1.7453 * i) ELSE 0.9 * (k % 2) END + 0.3 * e2 AS y, CASE WHEN i < 40 THEN 1.5 * i WHEN j % 2 = 0 THEN 3.3 * k ELSE 3.3 * (11 - k) END + 0.3 * e3 AS z FROM raw)"""
NEAR = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"


def c_alphas(spark, d):
    e = table(spark, d, "embeddings")
    at = lambda n: F.col("embedding")[n].cast("double")
    i = (F.col("vec_id") % 100).cast("int")
    rows = e.select(F.floor(F.col("vec_id") / 100).alias("structure"), i.alias("i"), F.floor((i - 40) / 12).cast("int").alias("j"), ((i - 40) % 12).alias("k"), *[at(n).alias(f"e{n + 1}") for n in range(3)])
    helix = F.col("i") < 40
    x = F.when(helix, 2.3 * F.cos(1.7453 * F.col("i"))).otherwise(20 + 4.8 * F.col("j")) + 0.3 * F.col("e1")
    y = F.when(helix, 2.3 * F.sin(1.7453 * F.col("i"))).otherwise(0.9 * (F.col("k") % 2)) + 0.3 * F.col("e2")
    z = F.when(helix, 1.5 * F.col("i")).when(F.col("j") % 2 == 0, 3.3 * F.col("k")).otherwise(3.3 * (11 - F.col("k"))) + 0.3 * F.col("e3")
    return rows.select("structure", F.when(helix, F.col("i")).otherwise(F.col("i") + 3 * (F.col("j") + 1)).alias("resnum"), x.alias("x"), y.alias("y"), z.alias("z"))


CORE = f"""WITH {CA}, q AS (SELECT structure, resnum, x, y, z, lead(x) OVER w - x AS ux, lead(y) OVER w - y AS uy, lead(z) OVER w - z AS uz, lead(x, 2) OVER w - x AS vx, lead(y, 2) OVER w - y AS vy, lead(z, 2) OVER w - z AS vz,
  lead(x, 3) OVER w - x AS wx, lead(y, 3) OVER w - y AS wy, lead(z, 3) OVER w - z AS wz FROM ca WINDOW w AS (PARTITION BY structure ORDER BY resnum)),
m AS (SELECT *, ux*ux+uy*uy+uz*uz AS uu, vx*vx+vy*vy+vz*vz AS vv, wx*wx+wy*wy+wz*wz AS ww, 2 * (ux * (vy * wz - vz * wy) + uy * (vz * wx - vx * wz) + uz * (vx * wy - vy * wx)) AS det FROM q),
o AS (SELECT *, (uu * (vy*wz-vz*wy) + vv * (wy*uz-wz*uy) + ww * (uy*vz-uz*vy)) / det AS ox, (uu * (vz*wx-vx*wz) + vv * (wz*ux-wx*uz) + ww * (uz*vx-ux*vz)) / det AS oy, (uu * (vx*wy-vy*wx) + vv * (wx*uy-wy*ux) + ww * (ux*vy-uy*vx)) / det AS oz FROM m),
t AS (SELECT *, coalesce(sqrt(ox*ox + oy*oy + oz*oz) > 2.75 AND sqrt(ox*ox + oy*oy + oz*oz) < 3.25, false) AS tight FROM o),
h AS (SELECT structure, resnum FROM t QUALIFY bool_or(tight) OVER (PARTITION BY structure ORDER BY resnum ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
h1 AS (SELECT *, sum(new) OVER (PARTITION BY structure ORDER BY resnum) AS run FROM (SELECT *, CASE WHEN resnum - lag(resnum) OVER (PARTITION BY structure ORDER BY resnum) <= 2 THEN 0 ELSE 1 END AS new FROM h)),
helix AS (SELECT structure, resnum FROM h1 QUALIFY count(*) OVER (PARTITION BY structure, run) > 8),
rest AS (SELECT structure, resnum, x, y, z, row_number() OVER w - 1 AS nth, count(*) OVER (PARTITION BY structure) AS n, lead(x, 3) OVER w AS tx, lead(y, 3) OVER w AS ty, lead(z, 3) OVER w AS tz
  FROM ca WHERE (structure, resnum) NOT IN (SELECT (structure, resnum) FROM helix) WINDOW w AS (PARTITION BY structure ORDER BY resnum)),
s0 AS (SELECT a.structure, a.resnum, a.x, a.y, a.z FROM rest a WHERE nth >= 2 AND nth < n - 3 AND sqrt((x-tx)*(x-tx) + (y-ty)*(y-ty) + (z-tz)*(z-tz)) > 6
  AND EXISTS (SELECT 1 FROM rest b WHERE b.structure = a.structure AND abs(a.nth - b.nth) > 2 AND sqrt({NEAR}) < 8)),
s1 AS (SELECT *, sum(new) OVER (PARTITION BY structure ORDER BY resnum) AS run FROM (SELECT *, CASE WHEN resnum - lag(resnum) OVER (PARTITION BY structure ORDER BY resnum) <= 1 THEN 0 ELSE 1 END AS new FROM s0)),
s2 AS (SELECT * FROM s1 QUALIFY count(*) OVER (PARTITION BY structure, run) > 4),
s3 AS (SELECT * FROM s2 WHERE (structure, run) IN (SELECT (a.structure, a.run) FROM s2 a JOIN s2 b ON a.structure = b.structure AND a.run <> b.run AND sqrt({NEAR}) < 5)),
s4 AS (SELECT a.structure, a.resnum, a.run, EXISTS (SELECT 1 FROM s3 b WHERE b.structure = a.structure AND abs(a.resnum - b.resnum) > 4 AND sqrt({NEAR}) < 6) AS held FROM s3 a),
sheet AS (SELECT structure, resnum FROM s4 QUALIFY resnum BETWEEN min(resnum) FILTER (held) OVER (PARTITION BY structure, run) AND max(resnum) FILTER (held) OVER (PARTITION BY structure, run)),
core AS (SELECT structure, resnum, 'helix' AS kind FROM helix UNION ALL SELECT structure, resnum, 'sheet' FROM sheet)"""


@query(f"{CORE} SELECT structure, resnum, kind FROM core")
def geo08_secondary_core(spark, d):
    return P.secondary_core(c_alphas(spark, d))


@query(f"{CORE}, c AS (SELECT structure, count(*) FILTER (kind = 'helix') AS helix, count(*) FILTER (kind = 'sheet') AS sheet FROM core GROUP BY structure), n AS (SELECT structure, count(*) AS n FROM ca GROUP BY structure) SELECT structure, n, coalesce(helix, 0) AS helix, coalesce(sheet, 0) AS sheet, (coalesce(helix, 0) + coalesce(sheet, 0)) / n AS score FROM n LEFT JOIN c USING (structure)")
def geo08_core_scores(spark, d):
    ca = c_alphas(spark, d)
    return P.core_scores(ca, P.secondary_core(ca))


def _pairs(spark, d):
    """Every structure with the one after it: as query, and moved a little as hit."""
    ca = c_alphas(spark, d)
    hit = ca.where("resnum % 17 > 1").withColumn("pair", F.col("structure") - 1)
    return ca.withColumn("pair", F.col("structure")).join(hit.select("pair").distinct(), "pair", "left_semi"), hit.join(ca.select(F.col("structure").alias("pair")).distinct(), "pair", "left_semi")


@query()
def geo09_difference_topology(spark, d):
    q, h = _pairs(spark, d)
    return P.difference_topology(q.select("pair", "resnum", "x", "y", "z"), h.select("pair", "resnum", "x", "y", "z"))[0]


@query()
def geo09_covered_residues(spark, d):
    q, h = _pairs(spark, d)
    return P.difference_topology(q.select("pair", "resnum", "x", "y", "z"), h.select("pair", "resnum", "x", "y", "z"))[1]


NAMES = ("N", "CA", "C", "O", "CB", "CG", "SD", "CE")
RESNAMES = ("ALA", "ARG", "ASP", "GLY", "MET", "SER", "TRP", "HOH")
ATOMS = f"""atoms AS (SELECT 's' || CAST(vec_id // 400 AS VARCHAR) AS structure, chr(CAST(65 + vec_id // 200 % 2 AS INT)) AS chain, vec_id % 200 // 8 * 2 AS resnum, list_extract({list(RESNAMES)}, CAST(vec_id % 200 // 8 % 8 AS INT) + 1) AS resname,
  list_extract({list(NAMES)}, CAST(vec_id % 8 AS INT) + 1) AS atom_name, CASE WHEN vec_id % 200 // 8 = 5 THEN 'A' ELSE '' END AS altloc, vec_id AS line_no, CASE WHEN vec_id % 200 // 8 % 8 = 7 THEN 'HETATM' ELSE 'ATOM' END AS record,
  CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"""


def atoms(spark, d):
    v = F.col("vec_id")
    r = F.floor((v % 200) / 8)
    pick = lambda names, k: F.element_at(F.array(*[F.lit(n) for n in names]), k.cast("int") + 1)
    return table(spark, d, "embeddings").select(
        F.concat(F.lit("s"), F.floor(v / 400).cast("string")).alias("structure"), F.chr(65 + F.floor(v / 200) % 2).alias("chain"), (r * 2).alias("resnum"), pick(RESNAMES, r % 8).alias("resname"), pick(NAMES, v % 8).alias("atom_name"),
        F.when(r == 5, "A").otherwise("").alias("altloc"), v.alias("line_no"), F.when(r % 8 == 7, "HETATM").otherwise("ATOM").alias("record"), *[F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xyz")],
    )


PRE = ", ".join(f"'{k}': '{v}'" for k, v in P.PRETERMINAL.items())


@query(f"""WITH {ATOMS}, s AS (
SELECT 'ca' AS selection, line_no FROM atoms WHERE atom_name = 'CA' UNION ALL SELECT 'backbone', line_no FROM atoms WHERE atom_name IN {P.BACKBONE}
UNION ALL SELECT 'polar', line_no FROM atoms WHERE atom_name[1] IN ('O', 'N', 'S') UNION ALL SELECT 'sidechain', line_no FROM atoms WHERE atom_name NOT IN {P.BACKBONE} OR (resname = 'GLY' AND atom_name = 'CA')
UNION ALL SELECT 'preterminal', line_no FROM atoms WHERE atom_name = CASE WHEN altloc <> '' THEN 'CA' ELSE MAP {{{PRE}}}[resname] END
UNION ALL SELECT 'active ca', line_no FROM atoms WHERE atom_name = 'CA' AND resname IN {P.ACTIVE} UNION ALL SELECT 'polar-ionizable sidechain', line_no FROM atoms WHERE atom_name NOT IN {P.BACKBONE} AND resname IN {P.KINDS['polar-ionizable']})
SELECT selection, line_no FROM s""")
def geo13_selectors(spark, d):
    a = atoms(spark, d)
    made = {"ca": P.c_alphas(a), "backbone": P.backbone_atoms(a), "polar": P.polar_atoms(a), "sidechain": P.sidechain_atoms(a), "preterminal": P.preterminal_atoms(a), "active ca": P.c_alphas(a, "active"), "polar-ionizable sidechain": P.sidechain_atoms(a, "polar-ionizable")}
    out = None
    for name, rows in made.items():
        part = rows.select(F.lit(name).alias("selection"), "line_no")
        out = part if out is None else out.union(part)
    return out


@query(f"WITH {ATOMS}, k AS (SELECT * FROM atoms WHERE atom_name NOT IN {P.BACKBONE} OR (resname = 'GLY' AND atom_name = 'CA')) SELECT structure, chain, resnum, resname, round(avg(x), 9) AS x, round(avg(y), 9) AS y, round(avg(z), 9) AS z FROM k GROUP BY ALL")
def geo13_reduced_sidechains(spark, d):
    c = P.centres(P.sidechain_atoms(atoms(spark, d)))
    return c.select("structure", "chain", "resnum", "resname", *[F.round(k, 9).alias(k) for k in "xyz"])


@query(f"WITH {ATOMS}, r AS (SELECT DISTINCT structure, chain, resnum FROM atoms WHERE resname <> 'ASP'), g AS (SELECT *, resnum - lag(resnum) OVER (PARTITION BY structure, chain ORDER BY resnum) AS step FROM r) SELECT structure, chain, greatest(1, max(step)) AS max_gap FROM g GROUP BY 1, 2")
def geo13_largest_gaps(spark, d):
    return P.largest_gaps(atoms(spark, d).where("resname <> 'ASP'"))


@query(f"WITH {ATOMS} SELECT structure || ':' || chain || ':' || resnum || ':' || resname AS ligand, count(*) AS atoms FROM (SELECT * REPLACE (CASE WHEN resnum % 4 = 2 THEN 'LIG' ELSE resname END AS resname) FROM atoms) WHERE record = 'HETATM' AND resname <> 'HOH' GROUP BY 1")
def geo15_ligand_atoms(spark, d):
    a = atoms(spark, d).withColumn("resname", F.when(F.col("resnum") % 4 == 2, "LIG").otherwise(F.col("resname")))
    return P.ligand_atoms(a).groupBy("ligand").agg(F.count(F.lit(1)).alias("atoms"))


@query()
def geo15_ligand_surfaces(spark, d):
    """Hulls of the ligands, here every hetero group of eight atoms."""
    a = atoms(spark, d).withColumns({"record": F.lit("HETATM"), "id": F.col("line_no"), "resname": F.lit("LIG")})
    return K.surfaces(P.ligand_atoms(a), "ligand")


PTS = "pts AS (SELECT vec_id AS id, label AS chain, CAST(embedding[1] AS DOUBLE) * 100 AS x, CAST(embedding[2] AS DOUBLE) * 100 AS y, CAST(embedding[3] AS DOUBLE) * 100 AS z FROM embeddings)"
PRUNED = f"""{PTS}, edges AS (SELECT id AS a, id + 1 AS b FROM pts WHERE id + 1 IN (SELECT id FROM pts)), ways AS (SELECT a, b FROM edges JOIN pts p ON p.id = a JOIN pts q ON q.id = b
  WHERE sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z)) BETWEEN 3.0000001 AND 17.9999999)"""


@query(f"""WITH {PRUNED}, heads AS (SELECT id, CASE WHEN id IN (SELECT b FROM ways) THEN 0 ELSE 1 END AS new FROM pts)
SELECT id AS node, max(CASE WHEN new = 1 THEN id END) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING) AS component FROM heads""")
def gr05_pruned_networks(spark, d):
    p = points(spark, d)
    edges = p.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).join(p.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b")
    at = p.select(F.col("id").alias("node"), F.lit("ALA").alias("residue"), "x", "y", "z")
    return P.pruned_networks(edges, p.select(F.col("id").alias("node")), S.chain_distances(edges, at), 18.0, 3.0)


@query()
def gr16_void_networks(spark, d):
    p = points(spark, d)
    voids = p.withColumn("half", F.col("chain") % 2).where("half = 0")
    return P.void_networks(voids, p.where("chain % 2 = 1"), "half", clash=2.0, max_edge=12.0)[0]


@query()
def gr16_void_edges(spark, d):
    p = points(spark, d)
    voids = p.withColumn("half", F.col("chain") % 2).where("half = 0")
    return P.void_networks(voids, p.where("chain % 2 = 1"), "half", clash=2.0, max_edge=12.0)[1]
