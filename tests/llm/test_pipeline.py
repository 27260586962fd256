"""The pipeline's stages in a row on the smallest tables."""

import corpus_pipeline
from agrarium.llm import op1_decontaminate


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n, counts = docs.columns, docs.count(), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / f"{i}_{name}")
        stage(spark, docs, sf).write.parquet(out)
        docs = spark.read.parquet(out)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if name == "decontaminate":
            assert op1_decontaminate.leaks(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).count() == 0
        counts.append(docs.count())
    assert counts[0] <= n and counts[1] == counts[0] and counts[2] < counts[1] and counts[3] < counts[2] and counts[4] == counts[3]
    assert corpus_pipeline.run(spark, sf).count() == counts[-1]
