"""The stages of the pipeline hand whole texts to Python in small batches."""

import corpus_pipeline


def test_stages_take_small_batches(spark):
    before = spark.conf.get(corpus_pipeline.BATCH_SETTING)
    try:
        spark.conf.set(corpus_pipeline.BATCH_SETTING, 10_000)
        docs = spark.range(0, 3_000, 1, 1).selectExpr("id as doc_id", "concat('some text ', id) as text")
        out = corpus_pipeline.personal_data(spark, docs, "")
        sizes = out.select("doc_id").mapInPandas(lambda frames: (f.assign(doc_id=len(f)).head(1) for f in frames), "doc_id long")
        got = [r.doc_id for r in sizes.collect()]
        assert sum(got) == 3_000 and max(got) <= corpus_pipeline.BATCH_ROWS
        spark.conf.set(corpus_pipeline.BATCH_SETTING, 100)
        corpus_pipeline.personal_data(spark, docs, "")
        assert spark.conf.get(corpus_pipeline.BATCH_SETTING) == "100"
    finally:
        spark.conf.set(corpus_pipeline.BATCH_SETTING, before)
