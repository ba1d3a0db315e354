"""Scan and text queries: lines written out of the driver tables and parsed again, held against the tables themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataline.functions import text as T
from strataline.queries import query
from strataline.sinks import writers as K
from strataline.sources import records as R
from strataline.session import table


def as_lines(df: DataFrame, file: Column, line_no: Column, value: Column) -> DataFrame:
    return df.select(file.cast("string").alias("file"), line_no.cast("long").alias("line_no"), value.alias("value"))


ACC = "'P' || CAST(p_partkey % 10 AS VARCHAR) || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') || CAST(p_size % 10 AS VARCHAR)"


def _acc() -> Column:
    s = lambda c: c.cast("string")
    return F.concat(F.lit("P"), s(F.col("p_partkey") % 10), F.lpad(s(F.col("p_partkey") % 1000), 3, "0"), s(F.col("p_size") % 10))


def _listing(spark, d):
    p = table(spark, d, "part")
    name = F.concat(F.lit("-rw-r--r-- 1 x y 10 "), F.col("p_size").cast("string"), F.lit("--0.5-0."), F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0"), F.lit("--AF-"), _acc(), F.lit("-F1--q--"), F.col("p_brand"), F.lit("-full.pdb"))
    return as_lines(p, F.lit("ls"), F.col("p_partkey"), F.when(F.col("p_partkey") % 50 == 0, F.lit("total 12")).otherwise(name))


@query(f"""WITH r AS (SELECT {ACC} AS uniprot, CAST(p_size AS DOUBLE) AS rank, 0.5 AS coverage, (p_partkey % 100) / 100.0 AS tm, p_brand AS type, p_partkey FROM part WHERE p_partkey % 50 <> 0)
SELECT uniprot, arg_max(rank, p_partkey) AS rank, 0.5::DOUBLE AS coverage, round(arg_max(tm, p_partkey), 2) AS tm, arg_max(type, p_partkey) AS type FROM r GROUP BY uniprot""")
def src01_agg05_listing(spark, d):
    return R.listing(_listing(spark, d)).withColumn("tm", F.round("tm", 2))


#: How a null is written in a line.
NULL = r"\N"


def _hit_lines(spark, d):
    li = table(spark, d, "lineitem")
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NULL))
    length = F.coalesce(F.col("l_linenumber").cast("string"), F.lit("bad"))
    v = F.concat_ws("\t", s("l_orderkey"), F.when(F.col("l_linenumber") == 7, "bad").otherwise(s("l_quantity")), length, F.when(F.col("l_returnflag") == "R", "NA").otherwise(s("l_discount")), s("l_extendedprice"), F.lit("title"))
    line_no = F.xxhash64("l_orderkey", "l_linenumber")  # any key: hits have no order
    return as_lines(li, F.lit("hits"), line_no, F.when(F.col("l_linenumber") == 6, F.concat(F.lit("# "), v)).otherwise(v))


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS qseqid, l_quantity AS pident, l_linenumber AS length, CASE WHEN l_returnflag = 'R' THEN CAST('inf' AS DOUBLE) ELSE l_discount END AS evalue, l_extendedprice AS bitscore, 'title' AS stitle
FROM lineitem WHERE l_linenumber NOT IN (6, 7)""")
def src10_search_hits(spark, d):
    return R.search_hits(_hit_lines(spark, d), NULL).drop("file", "line_no")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS uniprot_id, c_mktsegment AS superkingdom, c_name AS gene, 'o' AS organism, '1' AS rank, CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE c_nationkey END AS degree FROM customer""")
def src11_network_nodes(spark, d):
    c = table(spark, d, "customer")
    v = lambda degree: F.concat_ws("\t", "c_custkey", "c_mktsegment", "c_name", F.lit("o"), F.lit("1"), degree)
    old = as_lines(c, F.lit("n"), F.col("c_custkey"), v(F.lit("99")))
    new = as_lines(c, F.lit("n"), F.col("c_custkey") + 10_000_000, v(F.when(F.col("c_custkey") % 7 == 0, "?").otherwise(F.col("c_nationkey").cast("string"))))
    return R.network_nodes(old.union(new))


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS a, CAST(s_nationkey AS VARCHAR) AS b, s_acctbal AS pident, CASE WHEN s_suppkey % 2 = 0 THEN CAST('inf' AS DOUBLE) END AS evalue, CASE WHEN s_suppkey % 2 = 0 THEN 1.5 END AS bitscore FROM supplier""")
def src12_network_edges(spark, d):
    s = table(spark, d, "supplier")
    three = F.concat_ws("\t", "s_suppkey", "s_nationkey", "s_acctbal")
    return R.network_edges(as_lines(s, F.lit("e"), F.col("s_suppkey"), F.when(F.col("s_suppkey") % 2 == 0, F.concat_ws("\t", three, F.lit("inf"), F.lit("7"), F.lit("1.5"))).otherwise(three)))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS a, CAST(o_custkey AS VARCHAR) AS b, CAST(o_totalprice AS DOUBLE) AS weight FROM orders")
def src13_weighted_edges(spark, d):
    o = table(spark, d, "orders")
    raw = o.select(F.col("o_orderkey").cast("string").alias("﻿Source"), F.col("o_custkey").cast("string").alias("target "), F.col("o_totalprice").cast("string").alias("max_pident"))
    return R.weighted_edges(R.normalised_header(raw))


DICT = """dict AS (SELECT p_partkey, 'IPR' || lpad(CAST(p_size AS VARCHAR), 6, '0') AS ipr, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END AS description FROM part)"""


def _dictionary(spark, d):
    p = table(spark, d, "part")
    ipr = F.concat(F.lit("IPR"), F.lpad(F.col("p_size").cast("string"), 6, "0"))
    v = F.concat_ws("\t", _acc(), ipr, F.when(F.col("p_partkey") % 3 == 0, "-").otherwise(F.col("p_type")))
    junk = as_lines(p, F.lit("d"), F.col("p_partkey") - 10_000_000, F.when(F.col("p_partkey") % 2 == 0, "# comment").otherwise("a\tb"))
    return R.dictionary(as_lines(p, F.lit("d"), F.col("p_partkey"), v).union(junk))


@query(f"WITH {DICT} SELECT ipr, arg_min(description, p_partkey + CASE WHEN description = '' THEN 1000000000 ELSE 0 END) AS description FROM dict GROUP BY ipr")
def src04_agg06_first_descriptions(spark, d):
    return R.first_descriptions(_dictionary(spark, d))


@query(f"WITH {DICT} SELECT ipr, arg_min(description, p_partkey + CASE WHEN description = '' THEN 1000000000 ELSE 0 END) AS description FROM dict WHERE p_partkey < 99 GROUP BY ipr")
def flt16_line_cap(spark, d):
    return R.first_descriptions(_dictionary(spark, d), 100)


@query("SELECT o_custkey, arg_min(o_orderkey, o_orderkey) AS o_orderkey, arg_min(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY o_custkey")
def src06_agg04_first_row_index(spark, d):
    o = R.require(table(spark, d, "orders"), ["o_custkey", "o_orderkey"])
    return R.first_row_index(o.select(F.col("o_custkey").cast("string").alias("o_custkey"), "o_orderkey", "o_orderpriority"), "o_custkey", ["o_orderkey"]).withColumn("o_custkey", F.col("o_custkey").cast("long"))


def _doc_lines(spark, d, begin: Column):
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    heads = as_lines(docs.select("doc_id").distinct(), F.col("doc_id"), F.lit(-1), begin)
    return heads.union(as_lines(docs, F.col("doc_id"), F.col("k"), F.col("line")))


@query("SELECT 'doc|' || CAST(doc_id AS VARCHAR) || '|x' AS header, array_to_string(list_transform(string_split(text, chr(10)), lambda x: trim(x)), '') AS seq FROM documents")
def src08_fasta(spark, d):
    return R.fasta(_doc_lines(spark, d, F.concat(F.lit(">doc|"), F.col("doc_id").cast("string"), F.lit("|x")))).select("header", "seq")


@query("SELECT lang AS id, 'x|' || lang || '|' || CAST(max(doc_id) AS VARCHAR) AS header FROM documents GROUP BY lang")
def src08_fasta_last_of_id(spark, d):
    docs = table(spark, d, "documents")
    heads = as_lines(docs, F.lit("f"), F.col("doc_id") * 2, F.concat(F.lit(">x|"), F.col("lang"), F.lit("|"), F.col("doc_id").cast("string")))
    return R.fasta(heads.union(as_lines(docs, F.lit("f"), F.col("doc_id") * 2 + 1, F.lit("ACGT"))), last_of_id=True).select("id", "header")


@query("SELECT c_custkey, CAST(least(floor((row_number() OVER (ORDER BY c_custkey) - 1) / ceil(count(*) OVER () / 7)), 6) AS INT) AS chunk FROM customer")
def src09_win11_record_chunks(spark, d):
    return R.in_chunks(table(spark, d, "customer").select("c_custkey"), ["c_custkey"], 7)


ENTRY_SQL = f"""SELECT {ACC} AS primary_accession, CASE WHEN p_partkey % 2 = 0 THEN 'Reviewed' ELSE 'Unreviewed' END AS status, p_name AS protein, 'g' || CAST(p_size AS VARCHAR) AS gene, 'Homo sapiens' AS organism, 'Eukaryota' AS superkingdom,
2 AS n_lineage, 'IPR' || lpad(CAST(p_size AS VARCHAR), 6, '0') AS interpro, '1' AS protein_existence, 'MKTA' AS sequence_aa FROM part"""


def _entries(spark, d):
    p = table(spark, d, "part")
    ipr = F.concat(F.lit("DR   InterPro; IPR"), F.lpad(F.col("p_size").cast("string"), 6, "0"), F.lit("; x."))
    name = F.when(F.col("p_partkey") % 3 == 0, F.lit("DE   SubName: Full=")).otherwise("DE   RecName: Full=")
    body = F.array(
        F.concat(F.lit("ID   X_Y   "), F.when(F.col("p_partkey") % 2 == 0, "Reviewed").otherwise("Unreviewed"), F.lit(";  4 AA.")), F.concat(F.lit("AC   "), _acc(), F.lit("; Q99999;")), F.concat(name, F.col("p_name"), F.lit(" {ECO:1};")),
        F.concat(F.lit("GN   Name=g"), F.col("p_size").cast("string"), F.lit(" {ECO:2}; Synonyms=zz;")), F.lit("OS   Homo sapiens."), F.lit("OC   Eukaryota; Metazoa."), ipr, ipr, F.lit("PE   1: Evidence;"), F.lit("SQ   SEQUENCE   4 AA;"), F.lit("     mk ta"), F.lit("//"),
    )
    return R.entry_fields(R.flat_entries(as_lines(p.select("p_partkey", F.posexplode(body).alias("k", "v")), F.col("p_partkey"), F.col("k"), F.col("v"))))


@query(ENTRY_SQL)
def src02_prj01_flat_entries(spark, d):
    e = _entries(spark, d)
    return e.select("primary_accession", "status", F.rtrim("protein").alias("protein"), "gene", "organism", "superkingdom", F.size("lineage").alias("n_lineage"), F.array_join("interpro_ids", ";").alias("interpro"), "protein_existence", "sequence_aa")


@query(f"WITH w AS (SELECT p_partkey, {ACC} AS a FROM part), k AS (SELECT p_partkey, a FROM w WHERE p_partkey % 2 = 0) SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN a ELSE 'Q99999' END AS matched FROM w")
def jn01_flt02_first_matched_accession(spark, d):
    from strataline.operators import relational as O

    entries = _entries(spark, d).select(F.col("file").cast("long").alias("p_partkey"), "accessions")
    wanted = table(spark, d, "part").where("p_partkey % 2 = 0").select(_acc().alias("id"), F.col("p_partkey").alias("owner")).union(spark.createDataFrame([("Q99999", -1)], "id string, owner long"))
    # accessions repeat among parts, so an entry is matched with its own or with the shared one
    rows = O.first_match(entries, "p_partkey", "accessions", wanted.groupBy("id").agg(F.collect_set("owner").alias("owners")), "id", F.array_contains("owners", F.col("p_partkey")) | F.array_contains("owners", F.lit(-1).cast("long")))
    return rows.select("p_partkey", F.col("id").alias("matched"))


LI = "li AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_quantity) AS l_quantity, min(l_discount) AS l_discount, min(l_tax) AS l_tax FROM lineitem GROUP BY 1, 2)"
ATOM_RES = "list_extract(['ALA','ARG','ASN','ASP','CYS','GLN','UNK'], CAST(l_partkey % 7 AS INT) + 1)"


def _atoms(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax")])
    res = F.element_at(F.array(*[F.lit(x) for x in ("ALA", "ARG", "ASN", "ASP", "CYS", "GLN", "UNK")]), ((F.col("l_partkey") % 7) + 1).cast("int"))
    chain = F.when(F.col("l_suppkey") % 2 == 0, " ").otherwise("B")
    v = F.format_string("%-6s%5d %-4s%1s%3s %1s%4d%1s   %8.3f%8.3f%8.3f%6.2f%6.2f      %-4s%2s%2s", F.lit("ATOM"), F.col("l_linenumber"), F.when(F.col("l_linenumber") % 4 == 0, " CB ").otherwise(" CA "), F.lit(" "), res, chain, F.col("l_linenumber") * 2, F.lit(" "), F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"), F.lit(1.0), F.col("l_quantity"), F.lit("A"), F.lit("C"), F.lit(""))
    return R.pdb_atoms(as_lines(li, F.col("l_orderkey"), F.col("l_linenumber"), v))


@query(f"""WITH {LI} SELECT CAST(l_orderkey AS VARCHAR) AS structure, CASE WHEN l_partkey % 7 = 6 THEN 'HETATM' ELSE 'ATOM' END AS record, l_linenumber AS serial, CASE WHEN l_linenumber % 4 = 0 THEN 'CB' ELSE 'CA' END AS atom_name, {ATOM_RES} AS resname,
CASE WHEN l_suppkey % 2 = 0 THEN 'A' ELSE 'B' END AS chain, l_linenumber * 2 AS resnum, l_quantity AS x, l_discount AS y, l_tax AS z FROM li""")
def src18_snk12_pdb_atoms(spark, d):
    return _atoms(spark, d).select("structure", "record", "serial", "atom_name", "resname", "chain", "resnum", "x", "y", "z")


@query(f"""WITH {LI}, a AS (SELECT l_orderkey, l_linenumber AS n, {ATOM_RES} AS r FROM li WHERE l_linenumber % 4 <> 0), g AS (
SELECT l_orderkey, n, repeat('X', CAST(coalesce(2 * (n - lag(n) OVER (PARTITION BY l_orderkey ORDER BY n)) - 1, 0) AS INT)) || coalesce(CASE r WHEN 'ALA' THEN 'A' WHEN 'ARG' THEN 'R' WHEN 'ASN' THEN 'N' WHEN 'ASP' THEN 'D' WHEN 'CYS' THEN 'C' WHEN 'GLN' THEN 'Q' END, '') AS piece FROM a)
SELECT CAST(l_orderkey AS VARCHAR) AS structure, string_agg(piece, '' ORDER BY n) AS seq FROM g GROUP BY l_orderkey""")
def src20_win01_ca_sequence(spark, d):
    return R.ca_sequence(_atoms(spark, d))


@query(f"""WITH {LI}, a AS (SELECT l_orderkey, l_linenumber AS n, CASE WHEN l_suppkey % 2 = 0 THEN 'A' ELSE 'B' END AS chain FROM li), f AS (SELECT l_orderkey, arg_min(chain, n) AS chain FROM a GROUP BY 1)
SELECT CAST(a.l_orderkey AS VARCHAR) AS structure, row_number() OVER (PARTITION BY a.l_orderkey ORDER BY n) AS place, n * 2 AS resnum FROM a JOIN f ON a.l_orderkey = f.l_orderkey AND a.chain = f.chain""")
def src21_residue_series(spark, d):
    return R.residue_series(_atoms(spark, d)).drop("icode")


@query("SELECT CAST(l_orderkey AS VARCHAR) AS structure, l_linenumber AS serial, 'CA' AS atom_name, 'ALA' AS resname, 'C' AS chain, l_linenumber AS resnum, l_quantity AS x, l_discount AS y, l_tax AS z, CAST(NULL AS DOUBLE) AS occupancy FROM lineitem")
def src19_cif_atoms(spark, d):
    li = table(spark, d, "lineitem")
    fields = ["group_PDB", "id", "label_atom_id", "label_comp_id", "label_asym_id", "auth_seq_id", "Cartn_x", "Cartn_y", "Cartn_z", "auth_asym_id"]
    head = li.select("l_orderkey").distinct().select("l_orderkey", F.posexplode(F.array(*[F.lit(f"_atom_site.{f}") for f in fields])).alias("k", "v"))
    body = F.concat_ws(" ", F.lit("ATOM"), "l_linenumber", F.lit("CA"), F.lit("ALA"), F.lit("A"), "l_linenumber", "l_quantity", "l_discount", "l_tax", F.lit("C"))
    rows = as_lines(head, F.col("l_orderkey"), F.col("k"), F.col("v")).union(as_lines(li, F.col("l_orderkey"), F.col("l_linenumber") + 100, body))
    return R.cif_atoms(rows).select("structure", "serial", "atom_name", "resname", "chain", "resnum", "x", "y", "z", "occupancy")


@query("""SELECT 'm' || CAST(l_partkey AS VARCHAR) AS mobile_path, 'r' || CAST(l_suppkey AS VARCHAR) AS reference_path, CAST(l_discount AS DECIMAL(3,2)) AS tm1, CAST(l_tax AS DECIMAL(3,2)) AS tm2, l_quantity AS rmsd, l_linenumber AS len1, l_linenumber AS n_align FROM lineitem""")
def src14_alignment_results(spark, d):
    li = table(spark, d, "lineitem")
    v = F.concat_ws("\t", F.concat(F.lit("m"), F.col("l_partkey")), F.concat(F.lit("r"), F.col("l_suppkey")), F.col("l_discount"), F.col("l_tax"), F.col("l_quantity"), F.lit("0"), F.lit("0"), F.lit("0"), F.col("l_linenumber"), F.lit("9"), F.col("l_linenumber"))
    file = F.concat_ws("-", *li.columns)
    rows = as_lines(li, file, F.lit(1), F.lit("#PDBchain1\tPDBchain2\tTM1")).union(as_lines(li, file, F.lit(2), v)).union(as_lines(li, file, F.lit(3), F.lit("#Total CPU time")))
    return R.alignment_results(rows).drop("file", "line_no")


@query("SELECT l_discount AS tm_score, l_quantity AS rmsd, l_linenumber AS query_length, l_linenumber AS n_align, 'a' AS path1, 'b' AS path2 FROM lineitem WHERE l_linenumber <> 3")
def src15_result_rows(spark, d):
    li = table(spark, d, "lineitem")
    v = F.concat_ws(",", "l_discount", "l_quantity", "l_linenumber", F.when(F.col("l_linenumber") == 3, "x").otherwise(F.col("l_linenumber").cast("string")), F.lit("a"), F.lit(" b"))
    return R.result_rows(as_lines(li, F.lit("f"), F.col("l_linenumber"), v).union(spark.createDataFrame([("f", 0, "tm,rmsd,len,n,p1,p2")], "file string, line_no long, value string")))


@query("SELECT CAST(o_custkey AS VARCHAR) AS file, count(*) AS n FROM orders GROUP BY 1")
def src16_sniffed_rows(spark, d):
    o = table(spark, d, "orders")
    rows = as_lines(o, F.col("o_custkey"), F.col("o_orderkey"), F.col("o_orderstatus")).union(as_lines(o.select("o_custkey").distinct(), F.col("o_custkey"), F.lit(-1), F.lit("Rank,File")))
    return R.sniffed_rows(rows).groupBy("file").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'a' || CAST(doc_id AS VARCHAR) AS seq1_id, 'b' || CAST(doc_id AS VARCHAR) AS seq2_id, upper(lang) || '-' AS aligned1, '-' || upper(lang) AS aligned2 FROM documents""")
def src23_clustal_pair(spark, d):
    docs = table(spark, d, "documents")
    one, two = F.concat(F.upper("lang"), F.lit("-")), F.concat(F.lit("-"), F.upper("lang"))
    key = F.col("doc_id").cast("string")
    rows = as_lines(docs, F.col("doc_id"), F.lit(0), F.lit("CLUSTAL O(1.2)")).union(as_lines(docs, F.col("doc_id"), F.lit(1), F.concat(F.lit("a"), key, F.lit("   "), one))).union(as_lines(docs, F.col("doc_id"), F.lit(2), F.concat(F.lit("b"), key, F.lit("   "), two, F.lit(" 2"))))
    return R.clustal_pair(rows).drop("file")


@query("SELECT l_linenumber AS pos, l_returnflag AS symbol, count(*) AS n FROM lineitem WHERE l_linenumber <> 2 GROUP BY 1, 2")
def src24_match_rows(spark, d):
    li = table(spark, d, "lineitem")
    v = F.when(F.col("l_linenumber") == 2, "#c").when(F.col("l_linenumber") % 2 == 0, F.concat_ws("\t", "l_linenumber", F.lit("A"), F.lit("9"), F.lit("C"), "l_returnflag")).otherwise(F.concat_ws("\t", "l_linenumber", F.lit("9"), "l_returnflag"))
    return R.match_rows(as_lines(li, F.lit("m"), F.col("l_orderkey"), v)).groupBy("pos", "symbol").agg(F.count(F.lit(1)).alias("n"))


@query("WITH w AS (SELECT p_partkey, unnest(string_split(p_type, ' ')) AS id, generate_subscripts(string_split(p_type, ' '), 1) AS place FROM part) SELECT CAST(p_partkey AS VARCHAR) AS file, place, id FROM w")
def src25_id_list(spark, d):
    p = table(spark, d, "part")
    return R.id_list(as_lines(p, F.col("p_partkey"), F.lit(0), F.regexp_replace("p_type", " ", ", ")))


@query("SELECT n_name AS target, r_name AS query FROM nation JOIN region ON n_regionkey = r_regionkey")
def src26_work_pairs(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    j = n.join(r, n.n_regionkey == r.r_regionkey)
    return R.work_pairs(as_lines(j, F.lit("j"), F.col("n_nationkey"), F.concat(F.col("n_name"), F.lit("*"), F.col("r_name"))))


@query("SELECT l_returnflag AS label, l_quantity AS x, l_discount AS y, l_quantity * l_quantity + l_discount * l_discount AS z FROM lineitem")
def src28_point_rows(spark, d):
    li = table(spark, d, "lineitem")
    return R.point_rows(as_lines(li, F.concat(F.lit("/p/"), F.col("l_returnflag"), F.lit("_points_1.csv")), F.col("l_orderkey"), F.concat_ws(",", F.lit("p.tif"), "l_quantity", "l_discount"))).select("label", "x", "y", "z")


@query(f"SELECT p_brand AS domain, p_size AS rank, 0.5 AS coverage, {ACC} AS accession FROM part WHERE p_partkey % 4 = 1")
def src17_flt10_hit_files(spark, d):
    p = table(spark, d, "part")
    tail = F.when(F.col("p_partkey") % 4 == 1, "-full.pdb").when(F.col("p_partkey") % 4 == 2, "-trim.pdb").otherwise("_log-full.pdb")
    paths = p.select(F.concat(F.lit("/d/"), F.col("p_brand"), F.lit("-analysis/x-filtered_hits/"), F.col("p_size"), F.lit("--0.5-0.6--AF-"), _acc(), F.lit("-F1--q--OK"), tail).alias("path"))
    return R.hit_files(paths).select("domain", "rank", "coverage", "accession")


# ---- scalar families -------------------------------------------------------------------------------------------------------------


@query(r"""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'UC' ELSE regexp_replace(c_name, '[ #]+', '_', 'g') || '_' || c_mktsegment END AS name FROM customer""")
def scalar_clean_name(spark, d):
    c = table(spark, d, "customer")
    raw = F.when(F.col("c_custkey") % 5 == 0, " N/A ").otherwise(F.concat(F.lit("  "), F.regexp_replace("c_name", "#", " "), F.lit("  "), F.col("c_mktsegment"), F.lit("_ ")))
    return c.select("c_custkey", T.clean_name(raw).alias("name"))


@query("SELECT p_partkey, split_part(p_type, ' ', 1) AS first, split_part(p_name, '-', 1) AS stem FROM part")
def scalar_prj02_first_token(spark, d):
    return table(spark, d, "part").select("p_partkey", T.first_token(F.col("p_type"), [";", " "]).alias("first"), F.split_part("p_name", F.lit("-"), F.lit(1)).alias("stem"))


@query(f"SELECT p_partkey, {ACC} AS acc, {ACC} AS of_file, {ACC} AS of_header FROM part")
def scalar_accessions(spark, d):
    a = _acc()
    return table(spark, d, "part").select("p_partkey", T.accession(F.concat(F.lit("see "), a, F.lit("."))).alias("acc"), T.structure_accession(F.concat(F.lit("1--AF-"), a, F.lit("-F1"))).alias("of_file"), T.header_id(F.concat(F.lit("sp|"), a, F.lit("|N some name"))).alias("of_header"))


@query("SELECT s_suppkey, 'Bacteria' AS superkingdom, CAST(s_suppkey AS VARCHAR) AS uid, CASE WHEN s_suppkey % 2 = 0 THEN 'UC' ELSE 'g' END AS gene FROM supplier WHERE s_suppkey % 3 <> 0")
def prj05_prj06_header_fields(spark, d):
    s = table(spark, d, "supplier")
    head = F.concat(F.lit("Bacteria|"), F.col("s_suppkey").cast("string"), F.when(F.col("s_suppkey") % 2 == 0, "|").otherwise("|g"), F.when(F.col("s_suppkey") % 3 == 0, "").otherwise("|o|1"))
    r = s.select("s_suppkey", T.header_fields(head).alias("h")).where("h is not null")
    return r.select("s_suppkey", "h.superkingdom", "h.uid", "h.gene")


@query("SELECT o_orderkey, o_orderkey AS a, CAST(9 AS BIGINT) AS b, CAST(trunc(o_totalprice) AS BIGINT) AS c, o_totalprice AS e, CAST('inf' AS DOUBLE) AS f, 255 AS h FROM orders")
def scalar_casts(spark, d):
    k, price = F.col("o_orderkey").cast("string"), F.col("o_totalprice").cast("string")
    known = lambda c, x: F.when(c.isNotNull(), x)  # noqa: E731  # the defaults are for texts that can't be read, not for missing ones
    return table(spark, d, "orders").select(
        "o_orderkey", known(k, T.int_or(F.concat(F.lit(" "), k), 9)).alias("a"), T.int_or(F.concat(F.lit("x"), k), 9).cast("long").alias("b"), known(price, T.whole_of_float(price, 0)).alias("c"),
        T.float_or(price, None).alias("e"), T.evalue(F.lit("NA")).alias("f"), T.hex_int(F.lit("  FF")).alias("h"),
    )


@query("SELECT lang, count(*) AS n FROM documents WHERE regexp_matches(upper(text), '\\bTHE\\b|WAS FROM') GROUP BY lang")
def flt04_agg08_family(spark, d):
    docs = table(spark, d, "documents")
    return docs.where(T.in_family(F.col("text"), ["the", "was from"])).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT lang, count(*) AS n FROM documents WHERE NOT coalesce(regexp_matches(upper(text), '\\bTHE\\b|WAS FROM'), false) GROUP BY lang")
def set06_family_complement(spark, d):
    docs = table(spark, d, "documents")
    return docs.where(~T.in_family(F.col("text"), ["the", "was from"])).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, upper(p_name || ' ' || p_brand) AS h FROM part")
def prj10_haystack(spark, d):
    return table(spark, d, "part").select("p_partkey", T.haystack(["p_name", "p_brand"]).alias("h"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'bacteria' WHEN 1 THEN 'archaea' WHEN 2 THEN 'eukaryota' WHEN 3 THEN 'bacteria' ELSE 'other' END AS domain FROM documents")
def cls02_domain_class(spark, d):
    docs = table(spark, d, "documents")
    head = F.when(F.col("doc_id") % 5 == 0, "Bacterial thing|x").when(F.col("doc_id") % 5 == 1, "Archaeon|y").when(F.col("doc_id") % 5 == 2, "z|in eukaryota").when(F.col("doc_id") % 5 == 3, "q|Bacteria").otherwise("virus")
    return docs.select("doc_id", T.domain_of(head).alias("domain"))


@query("SELECT c_custkey, CASE WHEN c_mktsegment LIKE 'B%' THEN 'bacteria' ELSE lower(c_mktsegment) END AS k FROM customer")
def cls03_kingdom_prefix(spark, d):
    return table(spark, d, "customer").select("c_custkey", T.kingdom_prefix(F.when(F.col("c_mktsegment").startswith("B"), " Bacterium").otherwise(F.col("c_mktsegment"))).alias("k"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'ionizable' WHEN 1 THEN 'polar' WHEN 2 THEN 'apolar' END AS kind, CASE p_size % 4 WHEN 0 THEN 'D' WHEN 1 THEN 'N' WHEN 2 THEN 'G' END AS letter FROM part")
def cls06_flt13_residue_class(spark, d):
    r = F.element_at(F.array(F.lit("ASP"), F.lit("ASN"), F.lit("GLY"), F.lit("HOH")), (F.col("p_size") % 4 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", T.side_chain_type(r).alias("kind"), T.one_letter(r).alias("letter"))


@query("""WITH l AS (SELECT unnest(string_split('ACDEFGHIKLMNPQRSTVWYX-', '')) AS a), p AS (SELECT x.a AS a, y.a AS b FROM l x, l y), s AS (SELECT unnest(['STA','NEQK','NHQK','NDEQ','QHRK','MILV','MILF','FYW']) AS g), w AS (SELECT unnest(['CSA','ATV','SAG','STNK','STPA','SGND','SNDEQK','NDEQHK','NEQHRK','FVLIM','HFY']) AS g)
SELECT a, b, CASE WHEN a = '-' OR b = '-' THEN ' ' WHEN a = b AND a <> 'X' THEN '*' WHEN EXISTS (SELECT 1 FROM s WHERE contains(g, a) AND contains(g, b)) THEN ':' WHEN EXISTS (SELECT 1 FROM w WHERE contains(g, a) AND contains(g, b)) THEN '.' ELSE ' ' END AS symbol FROM p""")
def scalar_pair_symbol(spark, d):
    letters = spark.range(1).select(F.explode(F.split(F.lit("ACDEFGHIKLMNPQRSTVWYX-"), "")).alias("a")).where("a <> ''")
    pairs = letters.join(letters.withColumnRenamed("a", "b"))
    return pairs.select("a", "b", T.pair_symbol(F.col("a"), F.col("b")).alias("symbol"))


@query("SELECT doc_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS s FROM documents")
def scalar_letters_upper(spark, d):
    return table(spark, d, "documents").select("doc_id", T.letters_upper(F.col("text")).alias("s"))


@query("SELECT p_partkey, string_split(p_type, ' ') AS parts FROM part")
def scalar_win12_clean_list(spark, d):
    return table(spark, d, "part").select("p_partkey", T.clean_list(F.concat(F.regexp_replace("p_type", " ", " ; "), F.lit(";;"), F.regexp_replace("p_type", " ", ";"))).alias("parts"))


@query("SELECT l_orderkey, l_linenumber, CAST(round(CAST(l_extendedprice AS DECIMAL(20,6)) * CAST(0.125 AS DECIMAL(4,3)), 2) AS DECIMAL(18,2)) AS v FROM lineitem")
def scalar_half_up(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", T.half_up(F.col("l_extendedprice").cast("decimal(20,6)") * F.lit("0.125").cast("decimal(4,3)"), 2).alias("v"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def scalar_json(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages")
def prj01_page_fields(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"))


@query("SELECT a || chr(9) || b || chr(9) || printf('%.3f', p) || chr(9) || e AS line FROM (SELECT CAST(l_partkey AS VARCHAR) AS a, CAST(l_suppkey AS VARCHAR) AS b, l_quantity AS p, CASE WHEN l_returnflag = 'R' THEN 'inf' ELSE printf('%.2f', l_discount) END AS e FROM lineitem)")
def snk04_edge_lines(spark, d):
    li = table(spark, d, "lineitem")
    e = F.when(F.col("l_returnflag") == "R", F.lit(float("inf"))).otherwise(F.col("l_discount"))
    return K.edge_lines(li.select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.col("l_quantity").alias("pident"), e.alias("evalue")), "%.2f")


@query("SELECT l_orderkey, l_linenumber, printf('%-6s%5d  %-3s %3s %1s%4d    %8.3f%8.3f%8.3f', 'ATOM', l_linenumber, 'CA', 'ALA', 'A', l_linenumber, l_quantity, l_discount, l_tax) AS line FROM lineitem")
def snk12_pdb_lines(spark, d):
    li = table(spark, d, "lineitem").withColumns({"record": F.lit("ATOM"), "atom_name": F.lit("CA"), "resname": F.lit("ALA"), "chain": F.lit("A")})
    cols = {"serial": F.col("l_linenumber"), "resnum": F.col("l_linenumber"), "x": F.col("l_quantity"), "y": F.col("l_discount"), "z": F.col("l_tax")}
    return li.withColumns(cols).select("l_orderkey", "l_linenumber", F.substring(K.pdb_line(), 1, 54).alias("line"))
