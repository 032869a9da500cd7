from pyspark.sql import functions as F

import corpus_pipeline
from lodestar.llm import decontaminate, neardup, quality
from lodestar.runtime import table


def test_stages_and_their_decisions(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "near duplicates", "decontamination", "mixing", "sharding"]
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, sf).cache()
        assert out.columns == docs.columns
        assert out.join(at, "doc_id", "left_semi").count() == out.count() <= at.count()
        if name == "near duplicates":
            gone = {r.doc_id for r in neardup.groups(at).filter("not kept").collect()}
            assert {r.doc_id for r in at.select("doc_id").collect()} - {r.doc_id for r in out.select("doc_id").collect()} == gone
        if name == "decontamination":
            leaked = decontaminate.leaks(at, table(spark, sf, "benchmark")).select("doc_id").distinct()
            assert out.count() == at.count() - leaked.count()
        at = out
    last = corpus_pipeline.STAGES[-1][1](spark, at, sf)
    assert sorted(r.doc_id for r in last.collect()) == sorted(r.doc_id for r in at.collect())
    labels = table(spark, sf, "labels")
    first = quality.stage(spark, docs, sf).join(labels, "doc_id")
    good = docs.join(labels, "doc_id").filter("quality = 1 and toxic = 0")
    assert first.filter("quality = 1 and toxic = 0").count() >= 0.97 * good.count()
    assert first.filter(F.col("quality") == 0).count() <= 2
