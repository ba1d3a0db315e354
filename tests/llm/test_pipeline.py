import collections

from pyspark.sql import functions as F

import corpus_pipeline
from strataline.session import table


def test_stages(spark, sf, tmp_path):
    docs = table(spark, sf, "documents")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == before.columns and docs.schema["doc_id"].dataType == before.schema["doc_id"].dataType
        assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} <= ids, name
        if k < 3:
            assert max(collections.Counter(r.doc_id for r in docs.select("doc_id").collect()).values()) == 1
    assert {"doc_id", "sequence_id", "offset"} <= set(docs.columns)


def test_run_matches_the_stages(spark, sf):
    one, two = (collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, sf).collect()) for _ in range(2))
    assert one == two and one


def test_near_dedup_keeps_one_row_of_each_group(spark):
    text = lambda s: " ".join(f"{s}{k}" for k in range(60))
    rows = [(None, text("alone")), *[(None, text("many"))] * 50, (1, text("copied")), (None, text("copied")), (7, text("x")), (7, text("y")), (7, text("y")), (9, text("x"))]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = collections.Counter((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert got == collections.Counter([(None, text("alone")), (None, text("many")), (1, text("copied")), (7, text("x")), (7, text("y"))])


def test_stages_on_odd_and_empty_tables(spark, sf):
    body = " ".join(f"word{k}" for k in range(90))
    rows = [(1, None, "en", "a"), (2, "", None, None), (None, " \n\t", "de", "a"), (3, body, "en", None), (3, body, "en", None), (None, body + " more", "xx", "b"), (4, "THE " * 300, "en", "b"), (5, " ".join(f"w{k % 9973} x{k}" for k in range(30000)), "en", "a"), (6, "ünï 文字", None, "c")]
    docs = spark.createDataFrame([(i, t, g, s, None if t is None else len(t)) for i, t, g, s in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumns({"row": F.lit(1), "key": F.lit("k"), "_score": F.lit(0.0)})
    out = {name: stage(spark, docs, sf).collect() for name, stage in corpus_pipeline.STAGES}
    every = collections.Counter((r.doc_id, r.text) for r in docs.collect())
    for name in ("quality_classifier", "quality_rules", "near_dedup"):
        assert collections.Counter((r.doc_id, r.text) for r in out[name]) <= every, name
    assert sorted((r.doc_id or 0, len(r.text)) for r in out["quality_rules"]) == sorted((i or 0, len(t)) for i, t, _, _ in rows if t and len(t.split()) >= 50 and not t.startswith("THE"))
    assert collections.Counter((r.doc_id, (r.text or "")[:5]) for r in out["near_dedup"]) == collections.Counter([(1, ""), (3, "word0"), (4, "THE T"), (5, "w0 x0"), (6, "ünï 文")])
    assert {r.doc_id for r in out["source_mix"]} <= {3, 4, 5, 6, None} and all(r.text and r.n_chars == len(r.text) for r in out["source_mix"])
    whole = collections.Counter()
    for r in out["pack"]:
        whole[r.doc_id] += r.length
    assert whole[1] == whole[2] == 1 and set(whole) == {i for i, *_ in rows}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name
