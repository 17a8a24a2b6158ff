"""The pipeline's stages, one after the other, against brute force on the smallest table."""

import corpus_pipeline
from pyspark.sql import functions as F
from test_llm_operators import base_counts, stripped

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "suffix_dedup", "packing"]
    kept = corpus_pipeline.quality_stage(spark, docs, SF)
    ids = {r.doc_id for r in kept.collect()}
    for r in docs.collect():
        n, *_, repeated = base_counts(r.text)
        if n < 50 or 100 * repeated > 50 * n:
            assert r.doc_id not in ids
    exact = corpus_pipeline.exact_stage(spark, kept, SF)
    texts = [stripped(r.text) for r in exact.collect()]
    assert sorted(texts) == sorted({stripped(r.text) for r in kept.collect()})
    near = corpus_pipeline.near_stage(spark, exact, SF)
    sets = {}
    for r in exact.collect():
        w = r.text.lower().split()
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    stay = {r.doc_id for r in near.collect()}
    for a in sets:
        alike = [b for b in sets if b != a and len(sets[a] & sets[b]) >= 0.83 * len(sets[a] | sets[b])]
        if a not in stay:
            assert any(len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for b in sets if b != a)
        elif alike:
            assert min(alike) > a or not set(alike) & stay
    cut = corpus_pipeline.suffix_stage(spark, near, SF)
    assert cut.columns == docs.columns and {r.doc_id for r in cut.collect()} == stay
    long = {r.doc_id: r.text for r in near.collect()}
    for r in cut.collect():
        assert len(r.text) <= len(long[r.doc_id])


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    totals = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert totals.where("n > 2048 OR n <> end").count() == 0
