import numpy as np

from folium.llm import quality_classifier as qc
from folium.llm import quality_rules as qr
from folium.llm.textstats import FIELDS, counts, repeated

GOOD = "the cat and the dog went to a house that is on the hill with many more words of plain prose here and there for all to read in peace as it goes on and on to its end without any noise or marks so that it is kept by rules and models alike in the end ."
BAD = "### $$$ %%% *** &&& |||"


def brute(words):
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w in windows if windows.count(w) > 1}
    return len({i + k for i, w in enumerate(windows) if w in twice for k in range(3)})


def test_counts_against_brute_force():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 10, 60):
        words = [w.encode() for w in rng.choice(["a", "b", "c", "dd"], n)]
        assert (repeated(words)[0] if words else 0) == brute(words)
    text = "A bé!\t##\n\n x |y\nA bé!\t##\n"
    c = dict(zip(FIELDS, counts(text.encode()), strict=True))
    assert (c["n_words"], c["word_chars"], c["n_symbols"], c["n_dup_lines"], c["n_lines"]) == (8, 15, 5, 1, 3)


def docs(spark, extra=()):
    rows = [(k, GOOD + f" tail{k}", "s") for k in range(40)] + [(100 + k, f"{BAD} w{k} " * 30, "s") for k in range(20)]
    return spark.createDataFrame([*rows, *extra], "doc_id long, text string, n_words string")


def test_rules_keep_prose(spark):
    d = docs(spark, [(200, None, None), (201, "", "x"), (0, GOOD + " tail0", "s")])
    r = {(x.doc_id): x for x in qr.quality_rules(d.select("doc_id", "text")).collect()}
    assert all(r[k].kept for k in range(40)) and not any(r[100 + k].kept for k in range(20))
    assert r[200].base_failed and r[200].n_words == 0 and not r[201].kept
    kept = qr.keep_good(d)
    assert kept.columns == d.columns and kept.count() == 41
    assert qr.quality_rules(d.select("doc_id", "text").limit(0)).count() == 0


def test_em_prefers_agreeing_rules():
    # two rules that vote bad together on a few patterns; most abstain
    post = qr.fit(np.array([0, 2 + 6]), np.array([900.0, 100.0]), 2)
    assert post[0] > 0.9 and post[8] < 0.5


def test_classifier_held_out(spark):
    d = docs(spark)
    labels = spark.createDataFrame([(k, 1) for k in range(40)] + [(100 + k, 0) for k in range(20)] + [(None, 1), (1, None)], "doc_id long, quality int")
    r = qc.quality_scores(d, labels).collect()
    assert len(r) == 60 and any(x.held_out for x in r)
    assert all(x.predicted == (x.doc_id < 100) and 0 <= x.score <= 1 for x in r)
    assert qc.keep_good(d, labels).columns == d.columns and qc.keep_good(d, labels).count() == 40
    none = qc.quality_scores(d, labels.limit(0)).collect()
    assert {x.score for x in none} == {0.5}


def test_compiled_rules_equal_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.random((400, len(qc.NAMES)))
    y = ((x[:, 2] > 0.5) & (x[:, 0] < 0.7)).astype(float)
    model = qc.RuleModel.fit(x, y)
    assert model.rules and ((model.score(x) > 0.5) == y).mean() > 0.95
    df = spark.createDataFrame(x.tolist(), ", ".join(f"{n} double" for n in qc.NAMES))
    assert np.allclose(sorted(r[0] for r in df.select(model.column()).collect()), sorted(model.score(x)))
