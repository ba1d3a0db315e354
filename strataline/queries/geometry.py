"""Spatial queries: the first three numbers of an embedding, scaled, are a point; its label is a chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataline.functions import geometry as G
from strataline.operators import kernels as K
from strataline.operators import relational as O
from strataline.operators import spatial as S
from strataline.queries import query
from strataline.session import table

PTS = "pts AS (SELECT vec_id AS id, label AS chain, CAST(embedding[1] AS DOUBLE) * 100 AS x, CAST(embedding[2] AS DOUBLE) * 100 AS y, CAST(embedding[3] AS DOUBLE) * 100 AS z FROM embeddings)"
D = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"


def points(spark, d):
    e = table(spark, d, "embeddings")
    at = lambda k: F.col("embedding")[k].cast("double") * 100
    return e.select(F.col("vec_id").alias("id"), F.col("label").alias("chain"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))


@query(f"WITH {PTS} SELECT a.id, b.id AS r_id, round({D}, 6) AS distance FROM pts a, pts b WHERE a.id < b.id AND {D} < 4")
def jn13_range_join(spark, d):
    p = points(spark, d)
    return S.within(p, p, 4.0).where("id < r_id").select("id", "r_id", F.round("distance", 6).alias("distance"))


@query(f"WITH {PTS} SELECT a.id, max(b.id) AS hit FROM pts a, pts b WHERE a.chain = 0 AND b.chain = 1 AND {D} < 6 GROUP BY a.id")
def jn13_last_contact(spark, d):
    p = points(spark, d)
    return S.last_contacts(p.where("chain = 0"), p.where("chain = 1"), 6.0)


@query(f"WITH {PTS} SELECT id FROM pts a WHERE chain = 2 AND NOT EXISTS (SELECT 1 FROM pts b WHERE b.chain = 3 AND {D} < 5)")
def jn14_geo14_clear_points(spark, d):
    p = points(spark, d)
    return S.clear_of(p.where("chain = 2"), p.where("chain = 3"), 5.0).select("id")


@query(f"WITH {PTS} SELECT a.chain, b.chain AS other, count(*) AS contacts, count(DISTINCT a.id) AS residues, round(min({D}), 6) AS nearest FROM pts a, pts b WHERE a.chain < b.chain AND {D} < 5 GROUP BY 1, 2")
def jn15_interfaces(spark, d):
    return S.interfaces(points(spark, d), 5.0).withColumn("nearest", F.round("nearest", 6))


@query(f"WITH {PTS} SELECT a.id, arg_min(b.id, ({D}, b.id)) AS nearest, round(min({D}), 6) AS distance FROM pts a, pts b WHERE a.chain = 4 AND b.chain = 5 GROUP BY a.id")
def jn16_nearest(spark, d):
    p = points(spark, d)
    return S.nearest(p.where("chain = 4"), p.where("chain = 5"), 4.0).withColumn("distance", F.round("distance", 6))


@query(f"""WITH {PTS}, atoms AS (SELECT id % 50 AS node, CASE WHEN id % 3 = 0 THEN 'ARG' ELSE 'ALA' END AS residue, x, y, z FROM pts), e AS (SELECT n AS a, n + 1 AS b FROM (SELECT unnest(range(49)) AS n))
SELECT e.a, e.b, round(min({D.replace('a.', 'p.').replace('b.', 'q.')} - CASE WHEN p.residue = 'ARG' THEN 0.5 ELSE 0 END - CASE WHEN q.residue = 'ARG' THEN 0.5 ELSE 0 END), 6) AS distance FROM e JOIN atoms p ON p.node = e.a JOIN atoms q ON q.node = e.b GROUP BY 1, 2""")
def jn17_chain_distances(spark, d):
    atoms = points(spark, d).select((F.col("id") % 50).alias("node"), F.when(F.col("id") % 3 == 0, "ARG").otherwise("ALA").alias("residue"), "x", "y", "z")
    edges = spark.range(49).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    return S.chain_distances(edges, atoms).withColumn("distance", F.round("distance", 6))


@query(f"WITH {PTS}, c AS (SELECT a.id, count(*) AS n FROM pts a, pts b WHERE abs(a.id - b.id) > 2 AND {D} < 4 GROUP BY a.id) SELECT pts.id, coalesce(n, 0) AS contacts FROM pts LEFT JOIN c USING (id)")
def jn18_geo08_contact_counts(spark, d):
    return S.contact_counts(points(spark, d), 4.0)


@query(f"WITH {PTS} SELECT DISTINCT a.id // 20 AS run, b.id // 20 AS other FROM pts a, pts b WHERE a.id // 20 < b.id // 20 AND {D} < 2")
def jn19_run_contacts(spark, d):
    p = points(spark, d).withColumn("run", F.floor(F.col("id") / 20))
    return S.run_contacts(p.select("run").distinct(), p, 2.0)


@query(f"WITH {PTS} SELECT chain, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, count(*) AS n FROM pts GROUP BY chain")
def agg22_centroids(spark, d):
    return points(spark, d).groupBy("chain").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.avg("z").alias("cz"), F.count(F.lit(1)).alias("n"))


QUAD = f"""{PTS}, q AS (SELECT id, x AS ax, y AS ay, z AS az, lead(x) OVER w AS bx, lead(y) OVER w AS by_, lead(z) OVER w AS bz, lead(x, 2) OVER w AS cx, lead(y, 2) OVER w AS cy, lead(z, 2) OVER w AS cz, lead(x, 3) OVER w AS dx, lead(y, 3) OVER w AS dy, lead(z, 3) OVER w AS dz FROM pts WINDOW w AS (ORDER BY id)),
r AS (SELECT id, bx - ax AS ux, by_ - ay AS uy, bz - az AS uz, cx - ax AS vx, cy - ay AS vy, cz - az AS vz, dx - ax AS wx, dy - ay AS wy, dz - az AS wz FROM q WHERE dx IS NOT NULL)"""


def _quads(spark, d):
    from pyspark.sql import Window

    w = Window.orderBy("id")
    p = points(spark, d).select("id", G.point(F.col("x"), F.col("y"), F.col("z")).alias("a"))
    return p.withColumns({c: F.lead("a", k).over(w) for k, c in ((1, "b"), (2, "c"), (3, "d"))}).where("d is not null")


@query(f"""WITH {QUAD} SELECT id, round(ux * (vy * wz - vz * wy) + uy * (vz * wx - vx * wz) + uz * (vx * wy - vy * wx), 4) AS volume6,
round(sqrt((uy * vz - uz * vy) * (uy * vz - uz * vy) + (uz * vx - ux * vz) * (uz * vx - ux * vz) + (ux * vy - uy * vx) * (ux * vy - uy * vx)) / 2, 5) AS area FROM r""")
def scalar_geometry_determinants(spark, d):
    c = F.col
    q = _quads(spark, d)
    return q.select("id", F.round(G.orientation(c("a"), c("b"), c("c"), c("d")), 4).alias("volume6"), F.round(G.triangle_area(c("a"), c("b"), c("c")), 5).alias("area"))


@query(f"""WITH {QUAD}, m AS (SELECT *, ux*ux+uy*uy+uz*uz AS uu, vx*vx+vy*vy+vz*vz AS vv, wx*wx+wy*wy+wz*wz AS ww, 2 * (ux * (vy * wz - vz * wy) + uy * (vz * wx - vx * wz) + uz * (vx * wy - vy * wx)) AS det FROM r),
o AS (SELECT id, (uu * (vy*wz-vz*wy) + vv * (wy*uz-wz*uy) + ww * (uy*vz-uz*vy)) / det AS x, (uu * (vz*wx-vx*wz) + vv * (wz*ux-wx*uz) + ww * (uz*vx-ux*vz)) / det AS y, (uu * (vx*wy-vy*wx) + vv * (wx*uy-wy*ux) + ww * (ux*vy-uy*vx)) / det AS z FROM m)
SELECT id, round(sqrt(x * x + y * y + z * z), 3) AS radius FROM o WHERE sqrt(x * x + y * y + z * z) < 1000""")
def win03_scalar_circumsphere(spark, d):
    c = F.col
    r = G.circumsphere(c("a"), c("b"), c("c"), c("d"))["radius"]
    return _quads(spark, d).select("id", r.alias("_r")).where("_r < 1000").select("id", F.round("_r", 3).alias("radius"))


@query(f"WITH {PTS} SELECT id, round(1 + 0.6 * x - 0.8 * y, 6) AS x, round(2 + 0.8 * x + 0.6 * y, 6) AS y, round(3 + z, 6) AS z FROM pts")
def geo11_transformed(spark, d):
    array = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    p = points(spark, d).select("id", G.transformed(G.point(F.col("x"), F.col("y"), F.col("z")), array(1, 2, 3), array(0.6, -0.8, 0, 0.8, 0.6, 0, 0, 0, 1)).alias("p"))
    return p.select("id", *[F.round(f"p.{k}", 6).alias(k) for k in "xyz"])


@query(f"""WITH {PTS}, a AS (SELECT chain, id // 10 AS res, id % 10 AS atom, x, y, z FROM pts), k AS (SELECT * FROM a WHERE atom IN (1, 2))
SELECT chain, res, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM k GROUP BY 1, 2 HAVING count(*) = 2""")
def geo12_terminal_atoms(spark, d):
    p = points(spark, d)
    atoms = p.select(F.lit("s").alias("structure"), "chain", F.floor(F.col("id") / 10).alias("resnum"), F.lit("ASP").alias("resname"), (F.col("id") % 10).cast("string").alias("atom_name"), F.col("id").alias("line_no"), "x", "y", "z")
    wanted = spark.createDataFrame([("ASP", "1"), ("ASP", "2")], "resname string, atom_name string")
    return S.terminal_atoms(atoms, wanted).select("chain", F.col("resnum").alias("res"), "x", "y", "z")


@query()
def geo01_geo16_convex_hulls(spark, d):
    return K.surfaces(points(spark, d), "chain")


@query()
def geo03_delaunay_3d(spark, d):
    return K.triangulated(points(spark, d), "chain", max_edge=25.0)


@query()
def geo04_delaunay_2d(spark, d):
    return K.triangulated(points(spark, d), "chain", ("x", "y"), 20.0)


@query()
def geo05_carved_surfaces(spark, d):
    return K.surfaces(points(spark, d), "chain", 14.0)


def facets(spark, d):
    """Every chain's hull: facets with their corners, outward planes and centres."""
    p = points(spark, d)
    at = lambda k: p.select(F.col("id").alias(k), G.point(F.col("x"), F.col("y"), F.col("z")).alias(f"p{k}"))
    f = K.surfaces(p, "chain").join(at("a"), "a").join(at("b"), "b").join(at("c"), "c")
    return f.select("chain", "a", "b", "c", "pa", "pb", "pc", F.struct("a", "b", "c").alias("facet"), G.plane(F.col("pa"), F.col("pb"), F.col("pc")).alias("plane"), *[((F.col(f"pa.{k}") + F.col(f"pb.{k}") + F.col(f"pc.{k}")) / 3).alias(k) for k in "xyz"])


@query("SELECT vec_id AS id FROM embeddings")
def geo02_geo10_inside_own_hull(spark, d):
    return S.inside_hull(points(spark, d), facets(spark, d), "chain", 1e-6).select("id")


@query()
def geo02_geo10_inside_next_hull(spark, d):
    p = points(spark, d)
    return S.inside_hull(p, facets(spark, d).withColumn("chain", F.col("chain") - 1), "chain").select("id", "chain")


@query()
def geo07_hull_burial(spark, d):
    j = S.hull_distances(points(spark, d), facets(spark, d).withColumn("chain", F.col("chain") - 1), "chain")
    return O.burial(j.select("id", "distance"), "id", "distance")


@query()
def geo14_sampling_grid(spark, d):
    f = facets(spark, d).select("facet", G.point(F.col("x"), F.col("y"), F.col("z")).alias("centre"), F.col("plane.n").alias("normal"))
    g = S.sampling_grid(f, 2.0, 2)
    return g.select("facet.a", "facet.b", "facet.c", "k", *[F.round(c, 6).alias(c) for c in "xyz"])


@query()
def ext04_aligned_pairs(spark, d):
    docs = table(spark, d, "benchmark")
    pairs = docs.select("item_id", F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("s1")).join(docs.select((F.col("item_id") - 1).alias("item_id"), F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("s2")), "item_id")
    return O.identity_metrics(K.aligned_pairs(pairs, "s1", "s2")).select("item_id", "score", "identical", "compared", "identity_compared")
