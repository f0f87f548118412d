"""The pipeline on the smallest tables: each stage keeps documents of the one before, and what it decides takes effect."""

import corpus_pipeline as cp

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    from graphloom.llm import common, decontaminate, lmscore, simhash

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in cp.STAGES[:-1]:
        out = common.stored(stage(spark, docs, DIR), name)
        assert out.columns == columns
        assert out.count() == out.select("doc_id").distinct().count() <= before
        assert out.join(docs, "doc_id", "left_anti").isEmpty()
        if name == "simhash":
            groups = {r.component_id for r in simhash.near_duplicates(docs).collect()}
            assert {r.doc_id for r in out.select("doc_id").collect()} == groups
        docs, before = out, out.count()
    assert before > 50
    assert decontaminate.leaks(docs, spark.read.parquet(f"{DIR}/benchmark.parquet")).isEmpty()
    assert cp.run(spark, DIR).count() == before
    assert lmscore.op6_lm_score(spark, DIR).count() == spark.read.parquet(f"{DIR}/documents.parquet").count()
