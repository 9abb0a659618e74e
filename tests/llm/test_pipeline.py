"""The stages keep columns, act on their input alone, and their decisions take effect."""

import corpus_pipeline
from pyspark.sql import functions as F

from kerbline.llm import langid, quality_rules
from test_near_copies import least_of_groups, shingles

SF = "/root/testdata/sf0.001"


def test_stages_filter_and_keep_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("row", F.lit("clash"))
    extra = spark.createDataFrame([(9001, None, "en", "s", 0, "x"), (9002, "12 34 56", "en", "s", 8, "x"), (9003, "too short", "en", "s", 9, "x")], docs.schema)
    docs = docs.union(extra).union(docs.where("doc_id = 1"))
    given = docs
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language id", "quality rules", "simhash near-dedup", "best-fit packing"]
    for k, (_, step) in enumerate(corpus_pipeline.STAGES):
        step(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if k < 3:
            assert out.columns == given.columns
            assert out.select("doc_id").subtract(docs.select("doc_id")).count() == 0
        if k == 0:
            assert {9001, 9002} & {r["doc_id"] for r in out.collect()} == set()
            assert out.count() == langid.keep(docs).count()
        if k == 1:
            assert out.where("doc_id = 9003").count() == 0
            assert out.count() == quality_rules.verdicts(docs).where("kept").count()
        if k == 2:
            rows = sorted(docs.collect(), key=lambda r: r["doc_id"])
            roots = least_of_groups([shingles(r["text"]) for r in rows])
            assert sorted(r["doc_id"] for r in out.collect()) == [rows[i]["doc_id"] for i, r in enumerate(roots) if r == i]
        if k == 3:
            assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in docs.collect()}
        docs = out


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns[:7] == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.count() > 0
