import numpy as np

from folium.llm import quality_classifier as qc

from .test_quality import docs


def test_models_of_many_rules_are_compiled(spark, monkeypatch):
    rng = np.random.default_rng(4)
    tests = lambda: tuple((int(f), bool(rng.integers(2)), float(rng.random())) for f in rng.choice(len(qc.NAMES), 3, replace=False))
    model = qc.RuleModel(0.25, [(float(rng.normal()) / 9, tests()) for _ in range(1500)])
    monkeypatch.setattr(qc, "fit", lambda *a, **k: model)
    d = docs(spark, [(200, None, None)])
    counted = d.select("doc_id", qc.stats(qc.text_bytes()).alias("s")).select("doc_id", "s.*").select("doc_id", *qc.features()).toPandas().set_index("doc_id")
    want = dict(zip(counted.index, model.score(counted.to_numpy(float)), strict=True))
    got = {r.doc_id: r.score for r in qc.quality_scores(d, None).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert {r.doc_id for r in qc.keep_good(d, None).collect()} == {k for k, v in want.items() if v >= qc.PREDICT_AT}
