"""Scans of line-based records.

`lines` reads text with the file and an ordinal that ascends within a file; every parser takes such a table (file, line_no, value), so it is
tested and queried on any table of lines. Compressed files are told by their extension; a gzip file is one partition, hence the
repartition after it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataline.functions import text as T
from strataline.plans.ordering import numbered


def lines(spark: SparkSession, path: str | list[str], glob: str | None = None, recursive: bool = False) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line_no"), "value")


def resolve(spark: SparkSession, path: str) -> str:
    """The path, or the same with .gz where only that exists."""
    jvm = spark._jvm
    there = lambda p: (q := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(spark._jsc.hadoopConfiguration()).exists(q)
    return path if there(path) or not there(path + ".gz") else path + ".gz"


def blocks(rows: DataFrame, starts: Column, columns: Sequence[Column] = ()) -> DataFrame:
    """(file, block, first_line, body array of struct(line_no, value)): lines from one that satisfies `starts` to the next. Lines before the first are dropped."""
    number = F.sum(F.when(starts, 1).otherwise(0)).over(Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = rows.withColumn("block", number).where(F.col("block") > 0)
    return marked.groupBy("file", "block", *columns).agg(F.min("line_no").alias("first_line"), F.array_sort(F.collect_list(F.struct("line_no", "value"))).alias("body"))


def texts(body: str = "body") -> Column:
    return F.transform(body, lambda x: x["value"])


# ---- listings and hits -----------------------------------------------------------------------------------------------------------


def listing(rows: DataFrame) -> DataFrame:
    """(uniprot, rank, coverage, tm, type) of `rank--coverage-tm--AF-id-...` names; blank and total lines and names of fewer parts are skipped; the last line of an id wins."""
    token = F.element_at(F.split(T.strip_all(F.col("value")), r"\s+"), -1)
    r = rows.where((T.strip_all(F.col("value")) != "") & ~F.col("value").startswith("total ")).withColumn("parts", F.split(token, "--")).where(F.size("parts") >= 3)
    scores, name = F.split(F.get("parts", F.lit(1)), "-"), F.get("parts", F.lit(2))
    uid = F.coalesce(F.when(name.startswith("AF-"), F.nullif(F.get(F.split(name, "-"), F.lit(1)), F.lit(""))), T.accession(name))
    r = r.select(
        "file", "line_no", uid.alias("uniprot"), T.float_or(F.get("parts", F.lit(0)), None).alias("rank"), T.float_or(F.get(scores, F.lit(0)), None).alias("coverage"),
        T.float_or(F.get(scores, F.lit(1)), None).alias("tm"), F.split_part(F.element_at("parts", -1), F.lit("-"), F.lit(1)).alias("type"),
    ).where(F.col("uniprot").isNotNull())
    last = F.max_by(F.struct("rank", "coverage", "tm", "type"), F.struct("file", "line_no")).alias("r")
    return r.groupBy("uniprot").agg(last).select("uniprot", "r.*")


def tab_fields(rows: DataFrame, least: int, comment: str = "#") -> DataFrame:
    """Adds `f`, the tab-separated fields, of lines that aren't comments and have at least so many."""
    return rows.where(~F.col("value").startswith(comment)).withColumn("f", F.split("value", "\t")).where(F.size("f") >= least)


def field(k: int) -> Column:
    return F.get("f", F.lit(k))


def search_hits(rows: DataFrame, missing: str | None = None) -> DataFrame:
    """(qseqid, pident, length, evalue, bitscore, stitle); comments, short rows and unreadable numbers are dropped, an empty or NA evalue is infinite.

    A field that is the token `missing` is null, which is not unreadable.
    """
    r = tab_fields(rows, 6)
    if missing is not None:
        r = r.withColumn("f", F.transform("f", lambda x: F.when(x != missing, x)))
    number = {"pident": field(1).try_cast("double"), "length": field(2).try_cast("int"), "bitscore": field(4).try_cast("double")}
    read = [c.isNotNull() | field(k).isNull() for k, c in zip((1, 2, 4), number.values(), strict=True)]
    evalue = T.evalue(field(3)) if missing is None else F.when(field(3).isNotNull(), T.evalue(field(3)))
    return r.where(read[0] & read[1] & read[2]).select(
        field(0).alias("qseqid"), number["pident"].alias("pident"), number["length"].alias("length"), evalue.alias("evalue"), number["bitscore"].alias("bitscore"), field(5).alias("stitle"), "file", "line_no"
    )


def network_nodes(rows: DataFrame) -> DataFrame:
    """(uniprot_id, superkingdom, gene, organism, rank, degree): six columns or more, an unreadable degree is 0, the last row of an id wins."""
    r = tab_fields(rows, 6).select(field(0).alias("uniprot_id"), F.struct(field(1).alias("superkingdom"), field(2).alias("gene"), field(3).alias("organism"), field(4).alias("rank"), F.coalesce(field(5).try_cast("int"), F.lit(0)).alias("degree")).alias("r"), "file", "line_no")
    return r.groupBy("uniprot_id").agg(F.max_by("r", F.struct("file", "line_no")).alias("r")).select("uniprot_id", "r.*")


def network_edges(rows: DataFrame) -> DataFrame:
    """(a, b, pident, evalue, bitscore) of 3- or 6-column lines; evalue and bitscore are null where there are three."""
    r = tab_fields(rows, 3)
    wide = F.size("f") >= 6
    return r.select(field(0).alias("a"), field(1).alias("b"), field(2).try_cast("double").alias("pident"), F.when(wide, T.evalue(field(3))).alias("evalue"), F.when(wide, field(5).try_cast("double")).alias("bitscore")).where(F.col("pident").isNotNull())


NODE_ID_NAMES = ("uid", "node", "id", "node_id", "uid_id")
EDGE_LAYOUTS = (("src_uid", "dst_uid"), ("source", "target"), ("src", "dst"), ("parent", "child"))
WEIGHT_NAMES = ("pident_max", "max_pident", "pident", "weight")


def normalised_header(df: DataFrame) -> DataFrame:
    """Column names without byte-order marks and outer blanks."""
    return df.toDF(*[c.replace("﻿", "").strip() for c in df.columns])


def node_id_column(df: DataFrame) -> str:
    lower = {c.lower(): c for c in df.columns}
    for name in NODE_ID_NAMES:
        if name in lower:
            return lower[name]
    raise ValueError(f"no node id column among {df.columns}")


def weighted_edges(df: DataFrame) -> DataFrame:
    """(a, b, weight) of any accepted edge layout; without a weight column every edge weighs 1."""
    lower = {c.lower(): c for c in df.columns}
    for a, b in EDGE_LAYOUTS:
        if a in lower and b in lower:
            weight = next((F.col(lower[w]).try_cast("double") for w in WEIGHT_NAMES if w in lower), F.lit(1.0))
            return df.select(F.col(lower[a]).alias("a"), F.col(lower[b]).alias("b"), weight.alias("weight"))
    raise ValueError(f"no edge layout among {df.columns}")


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    return df


def header_table(spark: SparkSession, path: str | list[str], columns: Sequence[str] = ()) -> DataFrame:
    """A tab-separated table with a header, all strings, nothing read as null; `columns` must be there."""
    return require(normalised_header(spark.read.csv(path, sep="\t", header=True, quote="", nullValue="\u0000", emptyValue="", mode="DROPMALFORMED")), columns).na.fill("")


def first_row_index(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row of every key that isn't blank."""
    rest = [c for c in df.columns if c != key]
    kept = df.where(F.col(key).isNotNull() & (T.strip_all(F.col(key)) != ""))
    return kept.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def dictionary(rows: DataFrame) -> DataFrame:
    """(uniprot, ipr, description) of tab lines; comments, lines of fewer than three columns and empty keys are skipped, - is an empty description."""
    r = tab_fields(rows, 3).select(T.strip_all(field(0)).alias("uniprot"), T.strip_all(field(1)).alias("ipr"), T.strip_all(field(2)).alias("description"), "file", "line_no")
    return r.where((F.col("uniprot") != "") & (F.col("ipr") != "")).withColumn("description", F.when(F.col("description") == "-", "").otherwise(F.col("description")))


def first_descriptions(entries: DataFrame, max_lines: int | None = None) -> DataFrame:
    """(ipr, description): the first description, or the first that isn't empty if there is one. A cap on lines stops before the line of that number."""
    rows = entries if max_lines is None else entries.where(F.col("line_no") < max_lines - 1)
    return rows.groupBy("ipr").agg(F.min_by("description", F.struct(F.col("description") == "", F.col("file"), F.col("line_no"))).alias("description"))


# ---- flat files and sequences ----------------------------------------------------------------------------------------------------


def flat_entries(rows: DataFrame) -> DataFrame:
    """(file, block, text): records ended by lines that start with //; an unended last record counts."""
    ended = F.col("value").startswith("//")
    ahead = F.sum(F.when(ended, 1).otherwise(0)).over(Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1))
    kept = rows.withColumn("block", F.coalesce(ahead, F.lit(0))).where(~ended)
    return kept.groupBy("file", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "value"))), lambda x: x["value"]), "\n").alias("text")).where(T.strip_all(F.col("text")) != "")


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """As `flat_entries`, of files read by the records' end: a file of any size is split among tasks. Blocks ascend with the file."""
    rows = spark.read.option("lineSep", "\n//\n").text(resolve(spark, path))
    text = F.regexp_replace("value", r"(?m)^//.*\n?", "")  # a record that the end of the file or another end of line ends
    return rows.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("block"), F.rtrim(text, F.lit("\n")).alias("text")).where(T.strip_all(F.col("text")) != "")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, header, seq) of files read by the headers' mark: a file of any size is split among tasks; what stands before a file's first header is ignored."""
    rows = spark.read.option("lineSep", "\n>").text(resolve(spark, path)).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("block"), "value")
    first = rows.groupBy("file").agg(F.min("block").alias("block"), F.min_by(~F.col("value").startswith(">"), "block").alias("_before")).where("_before")  # one row a file
    lines = F.split(F.regexp_replace("value", "^>", ""), r"\r?\n")
    records = rows.join(first, ["file", "block"], "left_anti")
    return records.select("file", "block", F.get(lines, F.lit(0)).alias("header"), F.array_join(F.transform(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), T.strip_all), "").alias("seq"))


def entry_fields(entries: DataFrame) -> DataFrame:
    """The fields of annotation records."""
    x = F.col("text")
    found = lambda p: F.nullif(F.regexp_extract(x, p, 1), F.lit(""))
    joined = lambda key: F.array_join(F.regexp_extract_all(x, F.lit(rf"(?m)^{key}   (.*)$"), F.lit(1)), " ")
    lineage = T.clean_list(F.regexp_replace(joined("OC"), r"\.\s*$", ""))
    accessions = F.filter(T.clean_list(joined("AC")), lambda a: a.rlike(f"^{T.ACCESSION}$"))
    gene = T.first_token(found(r"(?m)^GN   .*?Name=([^;{]+)"), (",", " "))
    sequence = F.regexp_extract(x, r"(?s)\nSQ   [^\n]*\n(.*)$", 1)
    return entries.select(
        "file", "block",
        found(r"(?m)^ID   \S+\s+(\w+);").alias("status"), F.get(accessions, F.lit(0)).alias("primary_accession"), accessions.alias("accessions"),
        F.coalesce(found(r"(?m)^DE   RecName: Full=([^;{]+)"), found(r"(?m)^DE   SubName: Full=([^;{]+)")).alias("protein"), gene.alias("gene"),
        F.nullif(F.regexp_replace(joined("OS"), r"\.\s*$", ""), F.lit("")).alias("organism"), lineage.alias("lineage"), F.get(lineage, F.lit(0)).alias("superkingdom"),
        F.array_distinct(F.regexp_extract_all(x, F.lit(r"(?m)^DR   InterPro; (IPR[0-9]+);"), F.lit(1))).alias("interpro_ids"), found(r"(?m)^PE   ([0-9])").alias("protein_existence"),
        T.letters_upper(sequence).alias("sequence_aa"), found(r"(?m)^(ID   .*)$").alias("id_line"),
    )


def fasta(rows: DataFrame, last_of_id: bool = False) -> DataFrame:
    """(file, block, header, seq): text before the first header is ignored; with `last_of_id` a later record of a header's id replaces earlier ones."""
    b = blocks(rows, F.col("value").startswith(">"))
    out = b.select("file", "block", F.substring(F.get(texts(), F.lit(0)), 2, 1 << 30).alias("header"), F.array_join(F.transform(F.slice(texts(), F.lit(2), F.greatest(F.size("body") - 1, F.lit(0))), T.strip_all), "").alias("seq"))
    if not last_of_id:
        return out
    keyed = out.withColumn("id", T.header_id(F.col("header")))
    return keyed.groupBy("id").agg(F.max_by(F.struct("file", "block", "header", "seq"), F.struct("file", "block")).alias("r")).select("r.*", "id")


def in_chunks(records: DataFrame, order: Sequence[str], chunks: int, name: str = "chunk") -> DataFrame:
    """Adds the chunk of each record: equal numbers of whole records but for the last chunk, 0-based."""
    per = max(1, -(-records.count() // chunks))
    return numbered(records, order, "_place").withColumn(name, F.least(F.floor(F.col("_place") / per), F.lit(chunks - 1)).cast("int")).drop("_place")


# ---- structures ------------------------------------------------------------------------------------------------------------------


def pdb_atoms(rows: DataFrame) -> DataFrame:
    """Atoms of fixed-width structure lines, first model only; a blank chain is A, large numbers are hexadecimal, a known residue outside ATOM records stays HETATM."""
    v = F.col("value")
    cut = lambda a, b: T.strip_all(F.substring(v, a + 1, b - a))
    real = lambda a, b: cut(a, b).try_cast("double")
    ended = F.max(F.when(v.startswith("ENDMDL"), 1).otherwise(0)).over(Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    atoms = rows.where(v.rlike("^(ATOM|HETATM|ENDMDL)")).withColumn("_ended", ended).where((F.col("_ended") == 0) & ~v.startswith("ENDMDL"))
    known = F.upper(cut(17, 20)).isin(*T.RESIDUE_LETTERS, "MLY", "MLZ", "M3L")
    return atoms.select(
        F.col("file").alias("structure"), "line_no", F.when(v.startswith("ATOM") & known, "ATOM").otherwise("HETATM").alias("record"), T.hex_int(cut(6, 11)).alias("serial"), cut(12, 16).alias("atom_name"),
        cut(16, 17).alias("altloc"), cut(17, 20).alias("resname"), F.when(cut(21, 22) == "", "A").otherwise(cut(21, 22)).alias("chain"), T.hex_int(cut(22, 26)).alias("resnum"), cut(26, 27).alias("icode"),
        real(30, 38).alias("x"), real(38, 46).alias("y"), real(46, 54).alias("z"), real(54, 60).alias("occupancy"), real(60, 66).alias("bfactor"), cut(72, 76).alias("segment"), cut(76, 78).alias("element"), cut(78, 80).alias("charge"),
    )


def cif_atoms(rows: DataFrame) -> DataFrame:
    """Atoms of `_atom_site` loops: the loop's header lines give each field's place; fields that are absent are null."""
    v = T.strip_all(F.col("value"))
    names = rows.where(v.startswith("_atom_site.")).withColumn("name", F.regexp_extract(v, r"^_atom_site\.(\S+)", 1))
    place = F.row_number().over(Window.partitionBy("file").orderBy("line_no")) - 1
    at = names.withColumn("k", place).groupBy(F.col("file").alias("_file")).agg(F.map_from_entries(F.collect_list(F.struct("name", "k"))).alias("at"))
    tokens = F.split(v, r"\s+")
    data = rows.where(v.rlike("^(ATOM|HETATM) ")).withColumn("t", tokens).join(at, F.col("file") == F.col("_file"))
    get = lambda name: F.nullif(F.nullif(F.get("t", F.col("at")[name]), F.lit("?")), F.lit("."))
    return data.select(
        F.col("file").alias("structure"), "line_no", F.get("t", F.lit(0)).alias("record"), get("id").try_cast("int").alias("serial"), F.regexp_replace(get("label_atom_id"), '"', "").alias("atom_name"), get("label_comp_id").alias("resname"),
        F.coalesce(get("auth_asym_id"), get("label_asym_id"), F.lit("A")).alias("chain"), F.coalesce(get("auth_seq_id"), get("label_seq_id")).try_cast("int").alias("resnum"),
        get("Cartn_x").try_cast("double").alias("x"), get("Cartn_y").try_cast("double").alias("y"), get("Cartn_z").try_cast("double").alias("z"), get("occupancy").try_cast("double").alias("occupancy"),
        get("B_iso_or_equiv").try_cast("double").alias("bfactor"), get("type_symbol").alias("element"),
    )


def ca_sequence(atoms: DataFrame, group: Sequence[str] = ("structure",), filler: str = "X") -> DataFrame:
    """(group..., seq): letters of CA atoms in file order; a numbering gap of n puts in n fillers; unknown residues add nothing."""
    ca = atoms.where(F.col("atom_name") == "CA").withColumn("_letter", F.coalesce(T.one_letter(F.col("resname")), F.lit("")))
    gap = F.col("resnum") - F.lag("resnum").over(Window.partitionBy(*group).orderBy("line_no")) - 1
    ca = ca.withColumn("_piece", F.concat(F.repeat(F.lit(filler), F.greatest(F.coalesce(gap, F.lit(0)), F.lit(0)).cast("int")), F.col("_letter")))
    return ca.groupBy(*group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "_piece"))), lambda x: x["_piece"]), "").alias("seq"))


def residue_series(atoms: DataFrame) -> DataFrame:
    """(structure, place, resnum, icode): the first chain's distinct residues in file order."""
    first = atoms.groupBy(F.col("structure").alias("_s")).agg(F.min_by("chain", "line_no").alias("_c"))
    rows = atoms.join(first, (F.col("structure") == F.col("_s")) & (F.col("chain") == F.col("_c"))).groupBy("structure", "resnum", "icode").agg(F.min("line_no").alias("line_no"))
    return rows.select("structure", (F.row_number().over(Window.partitionBy("structure").orderBy("line_no"))).alias("place"), "resnum", "icode")


def alignment_results(rows: DataFrame) -> DataFrame:
    """(mobile_path, reference_path, tm1, tm2, rmsd, len1, n_align): the line after each #PDBchain1 line; scores are decimals, halves up."""
    before = F.lag("value").over(Window.partitionBy("file").orderBy("line_no"))
    r = rows.withColumn("_before", before).where(F.col("_before").startswith("#PDBchain1")).withColumn("f", F.split(T.strip_all(F.col("value")), "\t"))
    score = lambda k: T.half_up(field(k), 2).try_cast("decimal(3,2)")
    return r.select(field(0).alias("mobile_path"), field(1).alias("reference_path"), score(2).alias("tm1"), score(3).alias("tm2"), field(4).try_cast("double").alias("rmsd"), field(8).try_cast("int").alias("len1"), field(10).try_cast("int").alias("n_align"), "file", "line_no")


def result_rows(rows: DataFrame) -> DataFrame:
    """Rows of a results CSV; the header and malformed rows fall away."""
    r = rows.withColumn("f", F.split("value", ",")).where(F.size("f") == 6)
    out = r.select(field(0).try_cast("double").alias("tm_score"), field(1).try_cast("double").alias("rmsd"), field(2).try_cast("int").alias("query_length"), field(3).try_cast("int").alias("n_align"), T.strip_all(field(4)).alias("path1"), T.strip_all(field(5)).alias("path2"))
    return out.where("tm_score is not null and rmsd is not null and query_length is not null and n_align is not null")


HEADER_WORDS = ("uniprot", "accession", "file", "filename", "rank", "domain")


def sniffed_rows(rows: DataFrame) -> DataFrame:
    """Lines but for a file's first if that holds a header word."""
    first = F.row_number().over(Window.partitionBy("file").orderBy("line_no")) == 1
    return rows.withColumn("_first", first).where(~(F.col("_first") & F.lower("value").rlike("|".join(HEADER_WORDS)))).drop("_first")


def clustal_pair(rows: DataFrame) -> DataFrame:
    """(file, seq1_id, seq2_id, aligned1, aligned2) of two-sequence alignment blocks; unequal lengths are an error."""
    name = F.regexp_extract("value", r"^(\S+)\s+([A-Za-z-]+)\s*[0-9]*$", 1)
    part = F.regexp_extract("value", r"^(\S+)\s+([A-Za-z-]+)\s*[0-9]*$", 2)
    seqs = rows.where(~F.upper("value").startswith("CLUSTAL")).withColumn("id", name).where(F.col("id") != "").withColumn("part", part)
    joined = seqs.groupBy("file", "id").agg(F.min("line_no").alias("at"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "part"))), lambda x: x["part"]), "").alias("seq"))
    pair = joined.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("at", "id", "seq"))).alias("s"))
    one, two = F.get("s", F.lit(0)), F.get("s", F.lit(1))
    same = F.assert_true(F.length(one["seq"]) == F.length(two["seq"]), "aligned sequences of unequal length")
    return pair.select("file", one["id"].alias("seq1_id"), two["id"].alias("seq2_id"), one["seq"].alias("aligned1"), F.coalesce(same.cast("string"), two["seq"]).alias("aligned2"))


def match_rows(rows: DataFrame, position: int = 1) -> DataFrame:
    """(pos, symbol) of 5- or 3-column match lines for sequence 1 or 2; comments and rows without that position are dropped."""
    r = rows.where(~F.col("value").startswith("#")).withColumn("f", F.split(T.strip_all(F.col("value")), "[\t,]"))
    wide = F.size("f") >= 5
    pos = F.when(wide, field(0 if position == 1 else 2)).otherwise(field(position - 1)).try_cast("int")
    return r.where(F.size("f") >= 3).select("file", pos.alias("pos"), F.when(wide, field(4)).otherwise(field(2)).alias("symbol")).where(F.col("pos").isNotNull())


def id_list(rows: DataFrame) -> DataFrame:
    """(file, place, id) of comma- or newline-separated ids, in order."""
    parts = rows.select("file", "line_no", F.posexplode(F.split("value", ",")).alias("k", "raw")).withColumn("id", T.strip_all(F.col("raw"))).where(F.col("id") != "")
    return parts.select("file", F.row_number().over(Window.partitionBy("file").orderBy("line_no", "k")).alias("place"), "id")


def work_pairs(rows: DataFrame) -> DataFrame:
    """(target, query) of `target*query` lines; a line without * is a target alone."""
    s = F.split(T.strip_all(F.col("value")), r"\*")
    return rows.where(T.strip_all(F.col("value")) != "").select(F.get(s, F.lit(0)).alias("target"), F.get(s, F.lit(1)).alias("query"))


def point_rows(rows: DataFrame) -> DataFrame:
    """(label, filename, x, y, z) of point CSVs named `<label>_points...`; z = x^2 + y^2."""
    r = sniffed_rows(rows).withColumn("f", F.split("value", ","))
    label = F.regexp_extract("file", r"([^/]*?)_points[^/]*$", 1)
    out = r.select(label.alias("label"), field(0).alias("filename"), field(1).try_cast("double").alias("x"), field(2).try_cast("double").alias("y")).where("x is not null and y is not null")
    return out.withColumn("z", F.col("x") * F.col("x") + F.col("y") * F.col("y"))


# ---- catalogues and archives -----------------------------------------------------------------------------------------------------


def hit_files(paths: DataFrame, suffix: str = "-full.pdb") -> DataFrame:
    """(path, domain, rank, coverage, tm, accession) of files below `*-analysis/*-filtered_hits`, logs excluded."""
    p = F.col("path")
    kept = paths.where(p.rlike(r"/[^/]*-analysis/[^/]*-filtered_hits/") & p.endswith(suffix) & ~F.contains(p, F.lit("_log")))
    name = F.element_at(F.split(p, "/"), -1)
    parts = F.split(name, "--")
    scores = F.split(F.get(parts, F.lit(1)), "-")
    return kept.select("path", F.regexp_extract(p, r"/([^/]*)-analysis/", 1).alias("domain"), T.float_or(F.get(parts, F.lit(0)), None).cast("int").alias("rank"), T.float_or(F.get(scores, F.lit(0)), None).alias("coverage"), T.float_or(F.get(scores, F.lit(1)), None).alias("tm"), T.structure_accession(name).alias("accession"))


def list_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(path, length) of all files below a folder, contents unread."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(root).select("path", "length")


def archive_members(spark: SparkSession, paths: str | list[str], ids: DataFrame, suffix: str = "-trim.pdb") -> DataFrame:
    """(archive, member, id, value): texts of a tar archive's members of that suffix whose accession is wanted; an archive is streamed by one task."""
    import io
    import tarfile
    from collections.abc import Iterator

    import pandas as pd

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as tar:
                    for m in tar:
                        if m.isfile() and m.name.endswith(suffix):
                            yield pd.DataFrame({"archive": [path], "member": [m.name], "value": [tar.extractfile(m).read().decode("utf-8", "replace")]})

    found = spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(members, "archive string, member string, value string")
    return found.withColumn("id", T.structure_accession(F.col("member"))).join(ids.select("id"), "id", "left_semi").select("archive", "member", "id", "value")


def image_pixels(images: DataFrame, decode) -> DataFrame:
    """(image_id, y, x, v) of binary images by a decoder (bytes -> 2-D array); an image that it can't read is an error."""
    from collections.abc import Iterator

    import numpy as np
    import pandas as pd

    def pixels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                a = decode(bytes(content))
                if a is None:
                    raise ValueError(f"{path} is not an image")
                y, x = np.indices(a.shape)
                yield pd.DataFrame({"image_id": path, "y": y.ravel().astype("int32"), "x": x.ravel().astype("int32"), "v": a.ravel().astype("int32")})

    return images.select("path", "content").mapInPandas(pixels, "image_id string, y int, x int, v int")
