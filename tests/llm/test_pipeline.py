"""The pipeline's stages over the smallest tables: each decision checked on the stage's own input."""

import re


def test_stages(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        sizes.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "secret_scans":
            assert not any(re.search("AKIA[A-Z0-9]{12}|[0-9a-f]{32}", r["text"] or "") for r in docs.collect())
    assert sizes[1] < sizes[0] and sizes[2] < sizes[1] and sizes[3] == sizes[2] == sizes[4] <= sizes[5]
    assert corpus_pipeline.run(spark, sf).count() == sizes[5]
