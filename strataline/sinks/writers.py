"""Writers: every sink is an ordered table and a Spark writer; formats that have no writer here become lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataline.functions import text as T
from strataline.plans.ordering import numbered

# fixed values: column order of merged tables and of the identity report
MERGED_PREFIX = ("rank", "tm", "coverage", "type", "protein", "gene", "protein_existence", "superkingdom", "organism", "lineage", "primary_accession", "interpro_ids", "source", "status", "id_line", "sequence_aa")

IDENTITY_COLUMNS = (
    "Traceback Depth", "Sequence 1", "Sequence 2", "Full Matches (*)", "Strong Similar (:)", "Weak Similar (.)", "Total Identity (Effective)", "Raw Identity (Effective) (%)", "Strong Identity (Effective) (%)",
    "Weak Identity (Effective) (%)", "Total Identity (Seq1 Norm)", "Raw Identity (Seq1 Norm) (%)", "Strong Identity (Seq1 Norm) (%)", "Weak Identity (Seq1 Norm) (%)", "Alignment Length (Effective)", "Seq1 Sequence Length", "Seq2 Sequence Length",
)


def write_table(df: DataFrame, path: str, order: Sequence[Column] = (), sep: str = "\t", single: bool = False, gzip: bool = False, rows_a_file: int | None = None) -> None:
    """A header, nulls as nothing, in order; `single` makes one file, `rows_a_file` rolls over."""
    out = df.orderBy(*order) if order else df
    out = out.select(*[(F.array_join(c, ";") if t.startswith("array") else F.col(c).cast("string")).alias(c) for c, t in df.dtypes])
    if single:
        out = out.coalesce(1)
    writer = out.write.mode("overwrite").option("header", True).option("sep", sep).option("emptyValue", "").option("nullValue", "")
    if gzip:
        writer = writer.option("compression", "gzip")
    if rows_a_file:
        writer = writer.option("maxRecordsPerFile", rows_a_file)
    writer.csv(path)


def dynamic_columns(df: DataFrame, prefix: Sequence[str] = MERGED_PREFIX) -> DataFrame:
    """The prefix's columns first (null where absent), then the others as they stand."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in prefix], *[c for c in df.columns if c not in prefix])


def union_rows(*frames: DataFrame) -> DataFrame:
    """Rows of tables with different columns."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def edge_lines(edges: DataFrame, evalue_format: str = "%.6g") -> DataFrame:
    """(line): a, b, pident to three places and evalue, `inf` where infinite."""
    e = F.when(F.col("evalue") == F.lit(float("inf")), "inf").otherwise(F.format_string(evalue_format, "evalue"))
    return edges.select(F.concat_ws("\t", F.col("a").cast("string"), F.col("b").cast("string"), F.format_string("%.3f", "pident"), e).alias("line"))


def fasta_lines(df: DataFrame, header: Column, seq: Column) -> DataFrame:
    return df.select(F.concat(F.lit(">"), header, F.lit("\n"), seq).alias("value"))


def write_fasta_by_class(df: DataFrame, path: str, header: Column, seq: Column, cls: Column, classes: Sequence[str]) -> None:
    """One folder a class, empty ones included."""
    spark = df.sparkSession
    rows = df.select(cls.alias("class"), F.concat(F.lit(">"), header, F.lit("\n"), seq).alias("value"))
    blank = spark.createDataFrame([(c, None) for c in classes], "class string, value string")
    rows.union(blank.join(rows.select("class").distinct(), "class", "left_anti")).write.mode("overwrite").partitionBy("class").text(path)


def pdb_line() -> Column:
    """Fixed-width structure line of the atom columns."""
    name = F.when(F.length("atom_name") < 4, F.concat(F.lit(" "), F.rpad("atom_name", 3, " "))).otherwise(F.col("atom_name"))
    return F.format_string("%-6s%5d %4s %3s %1s%4d    %8.3f%8.3f%8.3f%6.2f%6.2f", "record", "serial", name, "resname", "chain", "resnum", "x", "y", "z", F.lit(1.0), F.lit(0.0))


def conect_lines(networks: DataFrame) -> DataFrame:
    """(place, line): CONECT records of network edges (component, a, b), larger networks first."""
    sizes = networks.groupBy("component").agg(F.count(F.lit(1)).alias("_size"))
    rows = numbered(networks.join(sizes, "component"), [F.desc("_size"), F.col("component"), F.col("a"), F.col("b")])
    return rows.select((F.col("place0") + 1).alias("place"), F.format_string("CONECT%5d%5d", "a", "b").alias("line"))


def identity_table(metrics: DataFrame, depth: str, one: str, two: str, a: str = "aligned1", b: str = "aligned2") -> DataFrame:
    """The identity report of aligned pairs with their metrics, in its 17 columns; shares are of the gap-free length and of the shorter sequence."""
    share = lambda c, of: F.when(F.col(of) > 0, F.round(100.0 * F.col(c) / F.col(of), 1)).otherwise(0.0)
    total = lambda of: F.round(share("identical", of) + share("strong", of) + share("weak", of), 1)
    bare = lambda c: F.length(F.regexp_replace(c, "-", "")).cast("long")
    values = [F.col(depth), F.col(one), F.col(two), F.col("identical"), F.col("strong"), F.col("weak")]
    for of in ("compared", "shorter"):
        values += [total(of), *[share(c, of) for c in ("identical", "strong", "weak")]]
    return metrics.select(*[v.alias(name) for v, name in zip([*values, F.col("compared"), bare(a), bare(b)], IDENTITY_COLUMNS, strict=True)])


def match_rows(pairs: DataFrame, keys: Sequence[str], a: str = "aligned1", b: str = "aligned2", series: tuple[str, str] | None = None) -> DataFrame:
    """(keys..., place, line): one line a column of an alignment: number and letter of either sequence and the symbol between them.

    Numbers count a sequence's letters, or are taken from the array columns in `series` in turn; a gap, and a letter beyond its series, has none.
    """
    left, right = F.split(a, ""), F.split(b, "")
    rows = pairs.select(*keys, *([F.col(c).alias(f"_s{k}") for k, c in enumerate(series)] if series else []), F.posexplode(F.arrays_zip(left.alias("p"), right.alias("q"))).alias("place", "_c"))
    rows = rows.where((F.col("_c.p") != "") & (F.col("_c.q") != ""))
    ahead = Window.partitionBy(*keys).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for k, side in enumerate("pq"):
        nth = F.sum(F.when(F.col(f"_c.{side}") == "-", 0).otherwise(1)).over(ahead)
        number = F.get(F.col(f"_s{k}"), (nth - 1).cast("int")).cast("string") if series else nth.cast("string")
        rows = rows.withColumn(f"_n{k}", F.when(F.col(f"_c.{side}") == "-", "").otherwise(F.coalesce(number, F.lit(""))))
    return rows.select(*keys, "place", F.concat_ws("\t", "_n0", "_c.p", "_n1", "_c.q", T.pair_symbol(F.col("_c.p"), F.col("_c.q"))).alias("line"))


def count_sheets(populations: dict[str, DataFrame], column: str, summary: dict[str, str]) -> dict[str, DataFrame]:
    """The sheets of a counts workbook: for each population how often each value of a column occurs, most frequent first, and a summary of names and values."""
    spark = next(iter(populations.values())).sparkSession
    sheets = {name: df.groupBy(column).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), column) for name, df in populations.items()}
    return sheets | {"summary": spark.createDataFrame([(k, v) for k, v in summary.items()], "metric string, value string")}


def write_sheets(sheets: dict[str, DataFrame], folder: str) -> None:
    """A folder a sheet, each with a header and one file."""
    for name, df in sheets.items():
        write_table(df, f"{folder}/{name}", single=True)


def time_stamp(c: Column) -> Column:
    """The part of a run's name that says when it began."""
    return F.date_format(c, "yyyyMMdd_HHmmss")


def run_suffix(**parameters: float) -> str:
    """Part of an output's name from its thresholds."""
    return "_".join(f"{k}{v:g}" for k, v in parameters.items())


def parameter_log(spark, **values) -> DataFrame:
    """One row a parameter or result."""
    return spark.createDataFrame([(k, str(v)) for k, v in values.items()], "name string, value string")
