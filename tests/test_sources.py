import gzip
import io
import tarfile

import pytest
from pyspark.sql import functions as F

from strataline.functions import text as T
from strataline.sinks import writers as K
from strataline.sources import records as R


def test_gzip_and_plain_lines(spark, tmp_path):
    with gzip.open(tmp_path / "a.dat.gz", "wt") as f:
        f.write("ID   X_Y   Reviewed;  3 AA.\nAC   P12345;\nSQ   SEQUENCE\n     mkt\n//\nID   Z_Z   Unreviewed;\nAC   Q99999;\n")
    path = R.resolve(spark, str(tmp_path / "a.dat"))
    assert path.endswith(".gz")
    got = {r["primary_accession"]: r for r in R.entry_fields(R.flat_entries(R.lines(spark, path))).collect()}
    assert got["P12345"]["sequence_aa"] == "MKT" and got["Q99999"]["status"] == "Unreviewed"  # the last record needs no end


def test_header_table_keeps_na_and_checks_columns(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("﻿uid \tname\n1\tNA\n2\t\n")
    df = R.header_table(spark, str(tmp_path / "t.tsv"), ["uid"])
    assert {(r.uid, r.name) for r in df.collect()} == {("1", "NA"), ("2", "")}
    assert R.node_id_column(df) == "uid"
    with pytest.raises(ValueError):
        R.require(df, ["absent"])


def test_archive_members(spark, tmp_path):
    with tarfile.open(tmp_path / "x.tgz", "w:gz") as tar:
        for name in ("AF-P12345-F1-trim.pdb", "AF-Q99999-F1-trim.pdb", "AF-P12345-F1-full.pdb"):
            info = tarfile.TarInfo(name)
            info.size = 4
            tar.addfile(info, io.BytesIO(b"ATOM"))
    ids = spark.createDataFrame([("P12345",)], "id string")
    got = R.archive_members(spark, str(tmp_path / "x.tgz"), ids).collect()
    assert [(r.member, r.value) for r in got] == [("AF-P12345-F1-trim.pdb", "ATOM")]


def test_image_pixels(spark, tmp_path):
    import numpy as np

    (tmp_path / "i.raw").write_bytes(bytes(range(6)))
    images = spark.read.format("binaryFile").load(str(tmp_path / "i.raw"))
    got = R.image_pixels(images, lambda b: np.frombuffer(b, np.uint8).reshape(2, 3)).collect()
    assert {(r.y, r.x): r.v for r in got}[1, 2] == 5
    with pytest.raises(Exception, match="not an image"):
        R.image_pixels(images, lambda b: None).collect()


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(2, ["a", "b"], None), (1, [], "x")], "rank int, ids array<string>, name string")
    K.write_table(K.dynamic_columns(df, ("rank", "tm")), str(tmp_path / "o"), [F.col("rank")], single=True, gzip=True)
    part = next((tmp_path / "o").glob("*.gz"))
    assert gzip.open(part, "rt").read().splitlines() == ["rank\ttm\tids\tname", "1\t\t\tx", "2\t\ta;b\t"]
    K.write_table(df, str(tmp_path / "r"), rows_a_file=1, single=True)
    assert len(list((tmp_path / "r").glob("part-*"))) == 2
    K.write_fasta_by_class(df.where("rank = 1"), str(tmp_path / "f"), F.col("name"), F.lit("ACGT"), F.lit("bacteria"), ["bacteria", "archaea"])
    assert {p.name for p in (tmp_path / "f").glob("class=*")} == {"class=bacteria", "class=archaea"}
    edges = spark.createDataFrame([("c1", 1, 2), ("c2", 3, 4), ("c2", 4, 5)], "component string, a int, b int")
    assert [r.line for r in K.conect_lines(edges).orderBy("place").collect()][0] == "CONECT    3    4"
    assert K.run_suffix(id=30.0, bs=30.5) == "id30_bs30.5"
    assert K.parameter_log(spark, a=1).count() == 1


def test_names_and_terms(spark):
    df = spark.createDataFrame([("  A  b ",), ("n/A",), (None,), ("__x__",)], "s string")
    assert [r[0] for r in df.select(T.clean_name(F.col("s"))).collect()] == ["A_b", "UC", "UC", "x"]
    hay = spark.createDataFrame([("a 7TM-GPCR_SRX family",), ("gcr-12",), ("opsinlike",), (None,)], "s string")
    got = [r[0] for r in hay.select(T.in_family(F.col("s"), T.FAMILY_TERMS)).collect()]
    assert got == [True, True, False, False]
    assert [r[0] for r in hay.select(T.in_family(F.col("s"), [])).collect()] == [False] * 4


def test_clustal_lengths_must_agree(spark):
    rows = spark.createDataFrame([("f", 0, "CLUSTAL"), ("f", 1, "a  AC-"), ("f", 2, "b  AC")], "file string, line_no long, value string")
    with pytest.raises(Exception, match="unequal"):
        R.clustal_pair(rows).collect()
