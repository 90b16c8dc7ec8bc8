import numpy as np

import corpus_pipeline


def test_classifier_learns_from_documents_that_the_rules_removed(spark, tmp_path):
    rng = np.random.default_rng(3)
    good = [" ".join(rng.choice(["the", "of", "river", "morning", "walked", "and", "bridge"], 80)) for _ in range(300)]
    bad = [" ".join(rng.choice(["A|B", "##", "QQ", "Z9", "|", "$$"], 80)) for _ in range(301)]
    rows = [(k, t, int(k < 300)) for k, t in enumerate(good + bad)]
    spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q) for i, _, q in rows[:600]], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    left = spark.createDataFrame([r[:2] for r in rows[:300]] + [rows[600][:2]], "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.quality_classifier(spark, left, str(tmp_path)).collect()}
    assert kept == set(range(300))
