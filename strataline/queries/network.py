"""Network queries: two lines of one order are a hit between their parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.operators import network as N
from strataline.plans.components import components_by_parts, connected_components
from strataline.queries import query
from strataline.session import cut, stored, table

HITS = """hits AS (
  SELECT a.l_partkey AS q, b.l_partkey AS s, a.l_quantity + b.l_quantity AS pident, least(a.l_discount, b.l_discount) AS evalue,
         greatest(a.l_extendedprice, b.l_extendedprice) AS bitscore, b.l_linenumber - a.l_linenumber AS length
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber
)"""
UNIQUE = f"""{HITS}, edges AS (
  SELECT least(q, s) AS a, greatest(q, s) AS b, max(pident) AS pident, min(evalue) AS evalue, max(bitscore) AS bitscore, max(length) AS length
  FROM hits WHERE q <> s GROUP BY 1, 2
)"""
#: The walk's and the reduced graph's own least identity.
STRONG = 30.0
WAYS = f"strong AS MATERIALIZED (SELECT a, b FROM edges WHERE pident >= {STRONG}), ways AS MATERIALIZED (SELECT a, b FROM strong UNION ALL SELECT b, a FROM strong)"
#: Every node of `ways` with the smallest node it is linked with: labels go from neighbour to neighbour until none falls.
SPREAD = """parts(node, component) USING KEY (node) AS (
  SELECT a, least(a, min(b)) FROM ways GROUP BY a
  UNION SELECT ways.b, min(p.component) FROM parts p JOIN ways ON ways.a = p.node JOIN recurring.parts r ON r.node = ways.b WHERE p.component < r.component GROUP BY ways.b)"""
REACH = f"{WAYS}, {SPREAD}"


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_extendedprice")
    a, b = line.alias("a"), line.alias("b")
    return a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_linenumber") < F.col("b.l_linenumber"))).select(
        F.col("a.l_partkey").alias("q"), F.col("b.l_partkey").alias("s"), (F.col("a.l_quantity") + F.col("b.l_quantity")).alias("pident"), F.least("a.l_discount", "b.l_discount").alias("evalue"),
        F.greatest("a.l_extendedprice", "b.l_extendedprice").alias("bitscore"), (F.col("b.l_linenumber") - F.col("a.l_linenumber")).alias("length"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.unique_edges(N.canonical_edges(hits(spark, sf_dir), "q", "s"))


def strong(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).where(F.col("pident") >= STRONG).withColumn("weight", F.col("bitscore"))


@query(f"WITH {UNIQUE} SELECT * FROM edges")
def gr01_agg01_unique_edges(spark, sf_dir):
    return edges(spark, sf_dir)


@query(f"WITH {HITS} SELECT least(q, s) AS a, greatest(q, s) AS b, count(*) AS n FROM hits WHERE q <> s GROUP BY 1, 2")
def prj09_flt07_canonical_edges(spark, sf_dir):
    return N.canonical_edges(hits(spark, sf_dir), "q", "s").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {UNIQUE}, ends AS (SELECT a AS node FROM edges UNION ALL SELECT b FROM edges), d AS (SELECT node, count(*) AS degree FROM ends GROUP BY node)
SELECT p_partkey AS node, coalesce(degree, 0) AS degree FROM part LEFT JOIN d ON p_partkey = node""")
def agg03_degrees(spark, sf_dir):
    return N.degrees(edges(spark, sf_dir), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node")))


@query(f"WITH {HITS} SELECT count(*) AS hits, count(*) FILTER (pident >= 60) AS kept, count(*) FILTER (q = s) AS self_hits FROM hits")
def agg17_build_counts(spark, sf_dir):
    return N.build_network(hits(spark, sf_dir), "q", "s", 60.0)[2]


@query(f"""WITH {HITS}, p AS (SELECT pmod, least(q, s) AS a, greatest(q, s) AS b, max(pident) AS pident, min(evalue) AS evalue FROM (SELECT *, CAST(length % 3 AS INT) AS pmod FROM hits) WHERE q <> s GROUP BY 1, 2, 3)
SELECT a, b, max(pident) AS pident, min(evalue) AS evalue FROM p GROUP BY a, b""")
def agg02_set05_merged_partials(spark, sf_dir):
    rows = N.canonical_edges(hits(spark, sf_dir), "q", "s")
    partial = None
    for k in range(3):  # what separate workers would hand over
        part = rows.where(F.col("length") % 3 == k).groupBy("a", "b").agg(F.max("pident").alias("pident"), F.min("evalue").alias("evalue"))
        partial = part if partial is None else partial.union(part)
    return partial.groupBy("a", "b").agg(F.max("pident").alias("pident"), F.min("evalue").alias("evalue"))


@query(f"WITH {UNIQUE} SELECT * FROM edges WHERE pident >= 90 AND isfinite(bitscore) AND bitscore >= 40000")
def flt05_by_bitscore(spark, sf_dir):
    return N.significant(edges(spark, sf_dir), 90.0, "bitscore", min_bitscore=40000.0)


@query(f"WITH {UNIQUE} SELECT * FROM edges WHERE pident >= 90 AND isfinite(evalue) AND evalue <= 0.02")
def flt05_by_evalue(spark, sf_dir):
    return N.significant(edges(spark, sf_dir), 90.0, "evalue", max_evalue=0.02)


@query(f"WITH {HITS} SELECT q, s, pident FROM hits WHERE pident >= 85")
def flt06_early_identity(spark, sf_dir):
    return hits(spark, sf_dir).where(F.col("pident") >= 85).select("q", "s", "pident")


@query(f"WITH {UNIQUE}, k AS (SELECT a, b FROM edges WHERE pident >= 90) SELECT a AS src, b AS dst FROM k UNION ALL SELECT b, a FROM k")
def gr02_src12_adjacency(spark, sf_dir):
    return N.both_ways(edges(spark, sf_dir).where(F.col("pident") >= 90).select("a", "b"))


@query(f"""WITH {UNIQUE}, k AS (SELECT * FROM edges WHERE pident >= 95), d AS (SELECT node, count(*) AS n FROM (SELECT a AS node FROM k UNION ALL SELECT b FROM k) GROUP BY node HAVING count(*) >= 2)
SELECT k.* FROM k WHERE a IN (SELECT node FROM d) AND b IN (SELECT node FROM d)""")
def flt09_min_degree(spark, sf_dir):
    return N.min_degree_filter(edges(spark, sf_dir).where(F.col("pident") >= 95), 2)


@query(f"""WITH {UNIQUE}, d AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM edges UNION ALL SELECT b FROM edges) GROUP BY node), r AS (
  SELECT node, degree, CASE WHEN p_size <= 10 THEN 0 WHEN p_size <= 40 THEN 1 END AS f FROM d JOIN part ON p_partkey = node)
SELECT node, degree FROM r WHERE f IS NOT NULL ORDER BY f, degree DESC, node DESC LIMIT 1""")
def top01_start_node(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), "p_size")
    nodes = N.degrees(edges(spark, sf_dir)).join(parts, "node")
    return N.start_node(nodes, F.col("p_size") <= 10, F.col("p_size") <= 40).select("node", "degree")


def _root(links):
    best = N.degrees(links).orderBy(F.desc("degree"), F.desc("node")).first()
    return best[0] if best else 0


@query(f"""WITH RECURSIVE {UNIQUE}, {WAYS}, root AS (SELECT a AS node FROM ways GROUP BY a ORDER BY count(*) DESC, a DESC LIMIT 1),
walk(node, depth) USING KEY (node) AS (SELECT node, 0 FROM root UNION SELECT ways.b, min(walk.depth) + 1 FROM walk JOIN ways ON ways.a = walk.node WHERE ways.b NOT IN (SELECT node FROM recurring.walk) GROUP BY ways.b)
SELECT node, depth FROM walk""")
def gr03_bfs_depth(spark, sf_dir):
    links = cut(strong(spark, sf_dir))
    return N.bfs_walk(links, _root(links)).select("node", "depth")


@query()
def gr03_bfs_tree(spark, sf_dir):
    links = cut(strong(spark, sf_dir))
    return N.bfs_walk(links, _root(links))


@query(f"WITH RECURSIVE {UNIQUE}, {REACH} SELECT node, component FROM parts")
def gr04_gr05_components(spark, sf_dir):
    return N.reachable(edges(spark, sf_dir), F.col("pident") >= STRONG)


@query(f"WITH RECURSIVE {UNIQUE}, {REACH} SELECT component, count(*) AS size FROM parts GROUP BY component")
def agg19_component_sizes(spark, sf_dir):
    return connected_components(strong(spark, sf_dir), "a", "b").groupBy("component").agg(F.count(F.lit(1)).alias("size"))


@query()
def gr04_level_capped_walk(spark, sf_dir):
    return N.level_capped_walk(_grouped(spark, sf_dir), "component", 3)


def _grouped(spark, sf_dir):
    s = stored(strong(spark, sf_dir).select("a", "b", "weight"))
    return s.join(components_by_parts(s, "a", "b").withColumnRenamed("node", "a"), "a").select("component", "a", "b", "weight")


@query(f"WITH RECURSIVE {UNIQUE}, {REACH} SELECT component, count(*) - 1 AS edges FROM parts GROUP BY component")
def gr07_forest_sizes(spark, sf_dir):
    return N.maximum_spanning_forest(_grouped(spark, sf_dir)).groupBy("component").agg(F.count(F.lit(1)).alias("edges"))


@query()
def gr07_maximum_spanning_forest(spark, sf_dir):
    return N.maximum_spanning_forest(_grouped(spark, sf_dir))


@query()
def gr07_forest_by_rounds(spark, sf_dir):
    return N.spanning_forest_by_rounds(strong(spark, sf_dir).select("a", "b", "weight"))


SIZES = "sizes AS (SELECT c_nationkey AS component, count(*) AS size FROM customer GROUP BY 1)"


@query(f"""WITH {SIZES}, k AS (SELECT *, sum(size) OVER (ORDER BY size DESC, component ROWS UNBOUNDED PRECEDING) - size AS ahead FROM sizes), f AS (SELECT component, size FROM k WHERE ahead < 500)
SELECT component, size, CAST(least(40, greatest(1, floor(500 * size / sum(size) OVER ()))) AS BIGINT) AS cap FROM f""")
def top03_gr09_component_budget(spark, sf_dir):
    sizes = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("component")).agg(F.count(F.lit(1)).alias("size"))
    return N.select_components(sizes, 500, 40)


@query(f"""WITH {UNIQUE}, e AS (SELECT a AS node, bitscore AS w, a, b FROM edges UNION ALL SELECT b, bitscore, a, b FROM edges), r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY w DESC, a, b) AS n FROM e)
SELECT node, round(sum(w) FILTER (n <= 3), 2) AS score, count(*) AS degree FROM r GROUP BY node""")
def agg18_node_scores(spark, sf_dir):
    scores = N.node_scores(edges(spark, sf_dir).withColumn("weight", F.col("bitscore")))
    return scores.select("node", F.round("score", 2).alias("score"), "degree")


@query(f"""WITH RECURSIVE {UNIQUE}, {REACH}, big AS (SELECT component FROM parts GROUP BY component HAVING count(*) >= 3)
SELECT p.component, e.a, e.b, e.bitscore AS weight FROM edges e JOIN parts p ON e.a = p.node JOIN parts o ON e.b = o.node JOIN big ON big.component = p.component WHERE p.component = o.component AND e.bitscore >= 30000""")
def jn11_flt08_within_components(spark, sf_dir):
    parts = connected_components(strong(spark, sf_dir), "a", "b")
    kept = parts.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    all_edges = edges(spark, sf_dir).withColumn("weight", F.col("bitscore"))
    return N.within_components(all_edges, parts, kept, 30000.0).select("component", "a", "b", "weight")


@query()
def gr08_prune_to_cap(spark, sf_dir):
    grouped = _grouped(spark, sf_dir)
    caps = grouped.select("component").distinct().withColumn("cap", F.lit(100).cast("long"))
    return N.prune_to_cap(N.maximum_spanning_forest(grouped), N.node_scores(grouped), caps)


@query()
def gr10_top04_snk06_reduced_network(spark, sf_dir):
    return N.reduce_network(strong(spark, sf_dir))


@query()
def gr06_minimised_networks(spark, sf_dir):
    return N.minimised(_grouped(spark, sf_dir).withColumn("distance", -F.col("weight")))


@query()
def gr11_str04_priority_clusters(spark, sf_dir):
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.substring("p_brand", 1, 7).alias("class"), F.col("p_size").alias("length"))
    links = stored(strong(spark, sf_dir).select("a", "b", "weight"))
    nodes = nodes.join(N.degrees(links).select("node"), "node", "left_semi")
    return N.priority_clusters(links, nodes, [f"Brand#{k}" for k in range(1, 6)])


CHARGES = "charges AS (SELECT p_partkey AS node, CASE WHEN p_size % 2 = 0 THEN 1 ELSE -1 END AS charge, CASE WHEN p_size % 5 = 0 THEN 'CYS' ELSE 'ASP' END AS residue FROM part)"


def _charges(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("node"), F.when(F.col("p_size") % 2 == 0, 1).otherwise(-1).alias("charge"), F.when(F.col("p_size") % 5 == 0, "CYS").otherwise("ASP").alias("residue"))


@query(f"""WITH {UNIQUE}, {CHARGES}, w AS (SELECT a, b FROM edges WHERE pident >= 95), ways AS (SELECT a, b FROM w UNION ALL SELECT b, a FROM w)
SELECT ways.a AS node, CAST(sum(x.charge * y.charge) AS BIGINT) AS parity, count(*) AS degree FROM ways JOIN charges x ON x.node = ways.a JOIN charges y ON y.node = ways.b GROUP BY ways.a""")
def agg27_neighbour_parity(spark, sf_dir):
    return N.neighbour_parity(edges(spark, sf_dir).where("pident >= 95"), _charges(spark, sf_dir))


@query(f"""WITH {UNIQUE}, {CHARGES}, k AS (SELECT e.a, e.b, CASE WHEN x.residue = 'CYS' AND y.residue = 'CYS' THEN 'disulfide' WHEN x.charge * y.charge < 0 THEN 'ion_pair' END AS kind, e.evalue AS distance
  FROM edges e JOIN charges x ON x.node = e.a JOIN charges y ON y.node = e.b WHERE e.evalue < 0.01) SELECT a, b, kind, distance FROM k WHERE kind IS NOT NULL""")
def gr12_tight_bonds(spark, sf_dir):
    return N.tight_bonds(edges(spark, sf_dir).withColumn("distance", F.col("evalue")), _charges(spark, sf_dir), 0.01)


@query(f"""WITH RECURSIVE {UNIQUE}, {CHARGES}, strong AS MATERIALIZED (SELECT e.a, e.b FROM edges e JOIN charges x ON x.node = e.a JOIN charges y ON y.node = e.b WHERE e.pident >= {STRONG} AND x.charge * y.charge > 0),
ways AS MATERIALIZED (SELECT a, b FROM strong UNION ALL SELECT b, a FROM strong), {SPREAD} SELECT node, component FROM parts""")
def gr13_parity_networks(spark, sf_dir):
    return N.parity_networks(strong(spark, sf_dir), _charges(spark, sf_dir))


@query(f"""WITH RECURSIVE {UNIQUE}, {CHARGES}, kept AS (SELECT a, b FROM edges WHERE pident >= 95 UNION SELECT a, b FROM edges WHERE pident < 95 AND evalue <= 0.001),
strong AS MATERIALIZED (SELECT e.a, e.b FROM kept e JOIN charges x ON x.node = e.a JOIN charges y ON y.node = e.b WHERE x.charge * y.charge < 0),
ways AS MATERIALIZED (SELECT a, b FROM strong UNION ALL SELECT b, a FROM strong), {SPREAD} SELECT node, component FROM parts""")
def gr13_recovered_edges(spark, sf_dir):
    e = edges(spark, sf_dir).withColumn("distance", F.col("evalue"))
    return N.parity_networks(e.where("pident >= 95"), _charges(spark, sf_dir), same=False, lost=e.where("pident < 95"), max_length=0.001)


@query(f"""WITH RECURSIVE {UNIQUE}, {CHARGES}, strong AS MATERIALIZED (SELECT e.a, e.b FROM edges e JOIN charges x ON x.node = e.a JOIN charges y ON y.node = e.b WHERE e.pident >= {STRONG} AND x.residue = y.residue),
ways AS MATERIALIZED (SELECT a, b FROM strong UNION ALL SELECT b, a FROM strong), {SPREAD}
SELECT residue AS class, c.node, coalesce(component, c.node) AS component FROM charges c LEFT JOIN parts p ON p.node = c.node""")
def gr14_class_networks(spark, sf_dir):
    return N.class_networks(strong(spark, sf_dir).select("a", "b"), _charges(spark, sf_dir).select("node", F.col("residue").alias("class")))


MIXED = f"""{UNIQUE}, {CHARGES}, w AS (SELECT a, b FROM edges WHERE pident >= 95), ways AS (SELECT a, b FROM w UNION ALL SELECT b, a FROM w), mixed AS (
SELECT ways.a AS node, x.residue AS label, count(*) FILTER (x.residue = y.residue) AS same_edges, count(*) FILTER (x.residue <> y.residue) AS mixed_edges
FROM ways JOIN charges x ON x.node = ways.a JOIN charges y ON y.node = ways.b GROUP BY 1, 2)"""


def _mixed(spark, sf_dir):
    return N.vertex_mixing(edges(spark, sf_dir).where("pident >= 95"), _charges(spark, sf_dir).select("node", F.col("residue").alias("label")))


@query(f"WITH {MIXED} SELECT * FROM mixed")
def gr15_vertex_mixing(spark, sf_dir):
    return _mixed(spark, sf_dir)


@query(f"""WITH {MIXED}, t AS (SELECT label, count(*) AS vertices, count(*) FILTER (mixed_edges > 0) AS mixed_vertices, count(*) FILTER (same_edges > 0) AS same_vertices FROM mixed GROUP BY label)
SELECT *, mixed_vertices / vertices AS mixed_fraction, same_vertices / vertices AS same_fraction FROM t""")
def agg25_mixing_summary(spark, sf_dir):
    return N.mixing_summary(_mixed(spark, sf_dir))


@query(f"""WITH RECURSIVE {UNIQUE}, strong AS MATERIALIZED (SELECT a, b FROM edges WHERE 100 - pident < 2), ways AS MATERIALIZED (SELECT a, b FROM strong UNION ALL SELECT b, a FROM strong), {SPREAD}
SELECT node, component, count(*) OVER (PARTITION BY component) AS size FROM parts QUALIFY size >= 3""")
def gr17_flt15_edge_clusters(spark, sf_dir):
    return N.clustered(edges(spark, sf_dir).withColumn("distance", 100 - F.col("pident")), 2.0, 3)


@query(f"""WITH RECURSIVE {UNIQUE}, strong AS MATERIALIZED (SELECT a, b FROM edges WHERE pident >= 98), ways AS MATERIALIZED (SELECT a, b FROM strong UNION ALL SELECT b, a FROM strong), {SPREAD},
s AS (SELECT component, count(*) AS size FROM parts GROUP BY component HAVING count(*) > 2) SELECT component, size, CAST(row_number() OVER (ORDER BY size DESC, component) AS INT) AS place FROM s""")
def top06_ranked_networks(spark, sf_dir):
    parts = N.reachable(edges(spark, sf_dir), F.col("pident") >= 98)
    return N.ranked(parts.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where("size > 2"), "size", "component")


@query(f"""WITH {UNIQUE}, ends AS (SELECT a AS node, b AS other FROM edges WHERE pident >= 95 UNION ALL SELECT b, a FROM edges WHERE pident >= 95), levels AS (SELECT node, min(other) AS parent, count(*) % 5 AS depth FROM ends GROUP BY node)
SELECT node, parent, depth, (row_number() OVER (PARTITION BY depth ORDER BY parent, node) - 1 - (count(*) OVER (PARTITION BY depth) - 1) / 2) * 80.0 AS x, -depth * 120.0 AS y FROM levels""")
def win10_snk19_level_layout(spark, sf_dir):
    e = N.both_ways(edges(spark, sf_dir).where("pident >= 95").select("a", "b"))
    tree = e.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("parent"), (F.count(F.lit(1)) % 5).alias("depth"))
    return N.level_layout(tree)


@query(f"""WITH {UNIQUE}, d AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM edges UNION ALL SELECT b FROM edges) GROUP BY node), n AS (SELECT node, degree, degree % 4 AS depth FROM d)
SELECT node, degree, depth, depth * 120.0 AS x, (row_number() OVER (PARTITION BY depth ORDER BY degree DESC, node) - 1 - (count(*) OVER (PARTITION BY depth) - 1) / 2) * 18.0 AS y FROM n""")
def win10_layered_layout(spark, sf_dir):
    return N.layered_layout(N.degrees(edges(spark, sf_dir)).withColumn("depth", F.col("degree") % 4))


@query(f"WITH {HITS}, k AS (SELECT least(q, s) AS a, greatest(q, s) AS b, * FROM hits WHERE q <> s AND pident >= 90) SELECT a, b, max(bitscore) AS weight, min(evalue) AS evalue, count(*) AS parallel FROM k GROUP BY a, b")
def jn22_parallel_edge_lookup(spark, sf_dir):
    k = N.canonical_edges(hits(spark, sf_dir).where("pident >= 90"), "q", "s")
    return k.groupBy("a", "b").agg(F.max("bitscore").alias("weight"), F.min("evalue").alias("evalue"), F.count(F.lit(1)).alias("parallel"))
