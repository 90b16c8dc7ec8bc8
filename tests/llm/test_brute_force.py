"""op2, op7 and op10 from beginning to end against plain versions that look at one document at a time."""

import math
import zlib
from collections import Counter

import numpy as np

from folium.llm import quality_classifier as qc
from folium.llm import quality_rules as qr
from folium.llm import toxicity as tx
from folium.llm.textstats import FIELDS, STOPS

LONG = "the plain prose of a very long text goes on . " * 30_000


def crc(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode())


def plain_counts(text):
    """FIELDS by their definitions, character by character."""
    white = " \t\n\v\f\r"
    words, word = [], ""
    for c in text + " ":
        if c in white:
            words += [word] if word else []
            word = ""
        else:
            word += c
    n = len(words)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    inside = set()
    for i in range(n - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            inside |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if x.strip(white)]
    chars = "".join(words)
    count = lambda test: sum(map(test, text)) if n else 0
    return dict(zip(FIELDS, (
        n, len(chars), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), len(lines), len(set(words)),
        sum(a == b for a, b in zip(words, words[1:], strict=False)), count(lambda c: "A" <= c <= "Z"), count(lambda c: "0" <= c <= "9"),
        count(lambda c: c == "!"), count(lambda c: c == "|"), count(lambda c: c == "."), sum(w.encode() in STOPS for w in words),
    ), strict=True))


def corpus(seed=1):
    rng = np.random.default_rng(seed)
    plain = ["the", "house", "of", "and", "river", "stone", "Anna", "walks", "to", "in", "bread", "is", "old", "town", "light", "door"]
    rows = []
    for k in range(150):
        w = rng.choice(plain, int(rng.integers(50, 120))).tolist()
        if k % 4 == 1:
            w = [x if rng.random() < 0.5 else str(rng.choice(["###", "$$", "!!!", "|", "%%%"])) for x in w]
        if k % 8 == 2:
            w = w[:6] * 20
        rows.append((k, " ".join(w).replace(" is ", " is.\n")))
    return [*rows, (500, None), (501, ""), (502, " \n"), (0, rows[0][1]), (0, rows[0][1]), (None, rows[3][1]), (503, LONG), (504, "é" * 60 + " word" * 60)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 0.5) for i, t in rows], "doc_id long, text string, posterior string, score double")


def test_quality_rules_against_em_over_documents(spark):
    rows = corpus()
    counted = [plain_counts(t or "") for _, t in rows]
    rules = [
        (lambda c: c["n_symbols"] > 0.06 * c["word_chars"], lambda c: c["n_symbols"] <= 0.002 * c["word_chars"]),
        (lambda c: c["n_upper"] > 0.35 * c["word_chars"], lambda c: False), (lambda c: c["n_adjacent"] > 0.2 * c["n_words"], lambda c: False),
        (lambda c: c["n_repeat_words"] > 0.4 * c["n_words"], lambda c: False),
        (lambda c: c["n_dup_lines"] > 0.4 * c["n_lines"] and c["n_lines"] >= 3, lambda c: c["n_dup_lines"] == 0 and c["n_lines"] >= 3),
        (lambda c: c["n_marks"] > 0.2 * c["n_words"], lambda c: False), (lambda c: c["n_pipes"] > 0.2 * c["n_words"], lambda c: False),
        (lambda c: c["n_stops"] == 0 and c["n_words"] >= 50, lambda c: 0.05 * c["n_words"] <= c["n_stops"] <= 0.7 * c["n_words"]),
    ]
    votes = [[2 if bad(c) else 1 if good(c) else 0 for bad, good in rules] for c in counted]
    share, pseudo = qr.PRIOR_GOOD, max(qr.PRIOR_SHARE * len(rows), 1.0)
    table = [[[v / sum(row) for v in row] for _ in rules] for row in qr.PRIOR_VOTES.tolist()]

    def posterior(v):
        p = [s * math.prod(table[y][k][x] for k, x in enumerate(v)) for y, s in ((0, share), (1, 1 - share))]
        return p[0] / sum(p)

    for _ in range(300):
        good = [posterior(v) for v in votes]
        new = [[[pseudo * x for x in row] for _ in rules] for row in qr.PRIOR_VOTES.tolist()]
        for v, g in zip(votes, good, strict=True):
            for k, x in enumerate(v):
                new[0][k][x] += g
                new[1][k][x] += 1 - g
        table = [[[x / sum(one) for x in one] for one in side] for side in new]
        share = min(max(sum(good) / len(good), 0.02), 0.98)
    want = []
    for (i, _), c, v in zip(rows, counted, votes, strict=True):
        failed = c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]
        want.append((str(i), c["n_words"], c["word_chars"], c["n_symbols"], c["n_dup_lines"], c["n_repeat_words"], failed, not failed and posterior(v) >= 0.5, round(posterior(v), 4)))
    got = [(str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, round(r.posterior, 4)) for r in qr.quality_rules(frame(spark, rows)).collect()]
    assert sorted(got) == sorted(want) and {True, False} == {w[7] for w in want if not w[6]}


def test_em_learns_from_the_documents_and_not_the_prior_alone():
    rng = np.random.default_rng(2)
    good = rng.random(20_000) < 0.7
    # the last rule votes bad on good texts more often than on bad ones, against the prior's belief
    bad_rate = np.array([[0.02, 0.05, 0.03, 0.3], [0.6, 0.5, 0.7, 0.05]])
    votes = np.where(rng.random((len(good), 4)) < bad_rate[np.where(good, 0, 1)], 2, np.where(rng.random((len(good), 4)) < 0.3, 1, 0))
    pattern, n = np.unique(votes @ 3 ** np.arange(4), return_counts=True)
    post = qr.fit(pattern, n.astype(float), 4)
    assert ((post[votes @ 3 ** np.arange(4)] >= 0.5) == good).mean() > 0.9
    assert post[2 * 27] > post[0] > 0.5  # its bad vote alone speaks for a text


def test_a_posterior_on_the_bound_is_kept(spark):
    p, kept = qr.verdict(np.where(np.arange(3**8) == 3**7, 0.5, 0.49), keep_at=0.5)
    row = {f: 0 for f in FIELDS} | {"n_words": 100, "n_stops": 30, "word_chars": 400, "n_symbols": 10}
    assert spark.createDataFrame([tuple(row.values())], ", ".join(f"{f} long" for f in FIELDS)).select(p, kept).first()[:] == (0.5, True)


def test_quality_scores_against_one_document_at_a_time(spark):
    rows = corpus()
    labels = [(k, int(k % 4 != 1)) for k in range(150)] + [(None, 0), (3, None), (501, 0)]
    known = {i: y for i, y in labels if i is not None and y is not None and crc(i) % 5}
    div = lambda a, b: a / max(b, 1)

    def features(text):
        c = plain_counts(text)
        n, chars, lines = c["n_words"], c["word_chars"], c["n_lines"]
        return [
            math.log(1 + n), div(chars, n), *(div(c[x], chars) for x in ("n_symbols", "n_upper", "n_digits")),
            *(div(c[x], n) for x in ("n_marks", "n_pipes", "n_dots", "n_stops", "n_distinct", "n_adjacent", "n_repeat_words")), div(c["n_dup_lines"], lines), div(n, lines),
        ]

    x = [features(t or "") for _, t in rows]
    taught = sorted([known[i], *f] for (i, _), f in zip(rows, x, strict=True) if i in known)
    model = qc.RuleModel.fit(np.array(taught)[:, 1:], np.array(taught)[:, 0])
    want = sorted((str(i), crc(i) % 5 == 0, round(float(s), 6)) for (i, _), s in zip(rows, model.score(np.array(x)), strict=True))
    got = qc.quality_scores(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert sorted((str(r.doc_id), r.held_out, round(r.score, 6)) for r in got) == want
    assert all(r.predicted == (r.score >= 0.3) for r in got) and len({round(r.score, 6) for r in got}) > 3
    assert qc.quality_scores(frame(spark, rows).limit(0), spark.createDataFrame(labels, "doc_id long, quality int")).count() == 0


def best_segments(w):
    """Maximal-scoring segments by definition: the best one (the shortest, then the first), then both sides of it."""
    total = np.r_[0.0, np.cumsum(w)]
    best = max(((round(total[j] - total[i], 9), i - j, -i, i, j) for i in range(len(w)) for j in range(i + 1, len(w) + 1)), default=(0,))
    if best[0] <= 1e-9:
        return []
    i, j = best[3], best[4]
    return best_segments(w[:i]) + [(i, j, best[0])] + [(a + j, b + j, s) for a, b, s in best_segments(w[j:])]


def toxic_corpus():
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for k in range(150):
        w = rng.choice([f"w{i}" for i in range(120)], 25).tolist()
        if k % 3 == 0:
            w[9:9] = rng.choice(["vilewordly", "vilewords", "nastyx"], 4).tolist()
        rows.append((k, " ".join(w) + "."))
        labels.append((k, int(k % 3 == 0)))
    return [*rows, (500, None), (501, ""), (0, rows[0][1]), (None, rows[3][1])], [*labels, (None, 1), (2, None), (501, 0)]


def test_toxicity_against_one_document_at_a_time(spark):
    rows, labels = toxic_corpus()
    known = {}
    for i, y in labels:
        if i is not None and y is not None and crc(i) % 3 != 1:
            known[i] = y
    taught = [(known[i], t or "") for i, t in rows if i in known]
    split = lambda t: "".join(c.lower() if c.isascii() and c.isalnum() else c if not c.isascii() else " " for c in t).split()
    beginnings = lambda w: [w[:k] + "*" for k in range(4, 10) if k <= len(w)]
    count = [Counter(), Counter()]
    for y, t in {(y, t) for y, t in taught}:
        for w in set(split(t)):
            count[y].update([w, *beginnings(w)])
    n = [sum(c for w, c in one.items() if not w.endswith("*")) for one in count]
    pseudo = tx.PRIOR * sum(n)
    model = tx.fit(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"), train=tx.id_crc() % 3 != 1)

    def weights(z):
        out = {}
        for w in count[0].keys() | count[1].keys():
            a = [one[w] + tx.PRIOR * (count[0][w] + count[1][w]) for one in count]
            odds = math.log(a[1] / (n[1] + pseudo - a[1])) - math.log(a[0] / (n[0] + pseudo - a[0]))
            if abs(odds) > z * math.sqrt(1 / a[0] + 1 / a[1]) and abs(odds) > tx.LEAST_WEIGHT:
                out[w.encode()] = odds
        return out

    same = [z for z in tx.ZS if weights(z).keys() == model.weights.keys()]
    assert same and all(abs(weights(same[0])[w] - x) < 1e-9 for w, x in model.weights.items())

    def segments(t):
        w = split(t)
        value = [next((model.weights[x.encode()] for x in [v, *reversed(beginnings(v))] if x.encode() in model.weights), model.rest) for v in w]
        return [(a, b, model.lam * s - model.log_k - math.log(len(w))) for a, b, s in best_segments(np.array(value))]

    want = []
    for i, t in rows:
        found = segments(t or "")
        strong = [x for x in found if x[2] > -math.log(tx.E_VALUE)]
        u, v = math.log1p(max([x[2] for x in found] + [0])), math.log1p(sum(x[2] for x in strong))
        score = 1 / (1 + math.exp(-(model.logistic[0] + model.logistic[1] * u + model.logistic[2] * v)))
        top = max(strong, key=lambda x: (x[2], -x[0]), default=(None, None))
        want.append((str(i), crc(i) % 3 == 1, round(score, 6), int(score >= 0.7), len(strong), str(top[0]), str(top[1])))
    got = tx.toxicity(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert sorted((str(r.doc_id), r.held_out, round(r.score, 6), r.predicted, r.passages, str(r.first_word), str(r.end_word)) for r in got) == sorted(want)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 150]
    assert np.mean([r.predicted == (r.doc_id % 3 == 0) for r in held]) > 0.9


def test_the_choice_of_z_sees_learnable_rows_only(spark):
    """Labels of held-out rows change nothing."""
    rows, labels = toxic_corpus()
    turned = [(i, (1 - y if i is not None and y is not None and crc(i) % 3 == 1 else y)) for i, y in labels]
    a, b = (tx.fit(frame(spark, rows), spark.createDataFrame(x, "doc_id long, toxic int"), train=tx.id_crc() % 3 != 1) for x in (labels, turned))
    assert a.weights == b.weights and a.logistic == b.logistic
