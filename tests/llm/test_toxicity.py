import itertools

import numpy as np

from folium.llm import toxicity as tx


def brute(w):
    """Maximal-scoring segments by their definition: the best one, then recursively both sides."""
    if not len(w):
        return []
    best = max(((sum(w[i:j]), -(j - i), -i, i, j) for i, j in itertools.combinations(range(len(w) + 1), 2)), default=None)
    if best is None or best[0] <= 0:
        return []
    i, j = best[3], best[4]
    return brute(w[:i]) + [(i, j, best[0])] + [(a + j, b + j, s) for a, b, s in brute(w[j:])]


def test_linear_scan_against_definition():
    rng = np.random.default_rng(2)
    for _ in range(200):
        w = rng.normal(-0.2, 1, int(rng.integers(0, 14)))
        got = tx.maximal(w)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in brute(w.tolist())]


def docs(n=160):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(n):
        words = rng.choice(vocabulary, 80).tolist()
        if k % 3 == 0:
            words[20:20] = rng.choice(["vilewordly", "vilewords", "nastyx"], 6).tolist()
        rows.append((k, f"{k} " + " ".join(words), "en"))
        labels.append((k, int(k % 3 == 0)))
    return rows, labels


def test_scores_separate(spark):
    rows, labels = docs()
    d = spark.createDataFrame([*rows, (900, None, "x"), (901, "", "x"), (0, rows[0][1], "en")], "doc_id long, text string, score string")
    known = spark.createDataFrame([*labels, (None, 1), (2, None)], "doc_id long, toxic int")
    got = tx.toxicity(d, known).collect()
    truth = dict(labels)
    right = [x.predicted == truth.get(x.doc_id, 0) for x in got if x.held_out]
    assert len(got) == 163 and np.mean(right) > 0.9 and all(0 <= x.score <= 1 for x in got)
    assert all(not x.predicted for x in got if x.doc_id >= 900)
    model = tx.fit(d, known)
    spans = tx.passages(d, model).filter("doc_id = 3").collect()
    assert spans and all(15 <= s.first_word <= 30 for s in spans)
    assert tx.toxicity(d, known.limit(0)).filter("predicted = 1").count() == 0
    assert tx.toxicity(d.limit(0), known).count() == 0


def test_stems_and_lambda():
    assert tx.stems("réeuxpa".encode())[:2] == ["réeu*".encode(), "réeux*".encode()]
    share = {-1.0: 0.75, 1.0: 0.25}
    assert abs(tx.karlin_lambda(share) - np.log(3)) < 1e-6


def test_logistic_on_separated_classes():
    rng = np.random.default_rng(9)
    x = np.vstack([rng.random((9000, 2)) * 0.05, 3 + rng.random((1000, 2))])
    x[:8000] = 0
    y = np.r_[np.zeros(9000), np.ones(1000)]
    a, b, c = tx.logistic(x, y)
    p = 1 / (1 + np.exp(-(a + x @ [b, c])))
    assert abs(a) < 50 and p[:9000].max() < 0.1 and p[9000:].min() > 0.9
