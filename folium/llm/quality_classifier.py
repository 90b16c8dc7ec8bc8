"""Quality classifier: a sparse rule ensemble over text statistics.

Small regression trees are boosted on the labelled sample; every path from a root becomes a conjunction of threshold
tests. A logistic model with an L1 penalty over these rules keeps a few of them. The kept rules are compiled into one
Spark column expression over the statistics, so scoring is JVM code after one pass over the texts.

Fitting reads at most SAMPLE_ROWS labelled rows (a documented bound: the smallest hashes of the ids, whatever the
size of the corpus); scoring reads every row. Labels, language, source and id are never inputs of a score.

Edge cases: a null text counts as empty and gets a score; without labels of both classes every score is the share of
label 1 (0.5 without any); several labels of an id and repeated rows each count as rows; an empty table gives an
empty result.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, id_crc, text_bytes
from .textstats import stats

SAMPLE_ROWS = 20_000
PREDICT_AT = 0.3
TREES, DEPTH, SHRINK, LEAST = 40, 3, 0.3, 20
PENALTY = 0.0008

#: The statistics that rules test, as SQL over the counts.
FEATURES: dict[str, str] = {
    "words": "ln(1 + n_words)",
    "word_len": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "capitals": "n_upper / greatest(word_chars, 1)",
    "digits": "n_digits / greatest(word_chars, 1)",
    "marks": "n_marks / greatest(n_words, 1)",
    "pipes": "n_pipes / greatest(n_words, 1)",
    "dots": "n_dots / greatest(n_words, 1)",
    "stops": "n_stops / greatest(n_words, 1)",
    "distinct": "n_distinct / greatest(n_words, 1)",
    "adjacent": "n_adjacent / greatest(n_words, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "line_len": "n_words / greatest(n_lines, 1)",
}
NAMES = tuple(FEATURES)

Test = tuple[int, bool, float]  # feature, above, threshold
Rule = tuple[Test, ...]


def features() -> list[Column]:
    return [F.expr(f"cast({x} as double)").alias(name) for name, x in FEATURES.items()]


def _grow(x: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, rows: np.ndarray, path: Rule, depth: int, rules: list[Rule], value: np.ndarray) -> None:
    """Split ``rows`` where the squared sums of the gradient grow most; note each path; leaves fill ``value``."""
    best, g = (1e-9, None), grad[rows]
    total, n = g.sum(), len(rows)
    least = max(1, min(LEAST, len(grad) // 20))
    if depth and n >= 2 * least:
        for f, cut in enumerate(cuts):
            if not len(cut):
                continue
            bins = np.searchsorted(cut, x[rows, f], side="left")
            left = np.cumsum(np.bincount(bins, g, len(cut) + 1))[:-1]
            size = np.cumsum(np.bincount(bins, minlength=len(cut) + 1))[:-1]
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = left**2 / size + (total - left) ** 2 / (n - size) - total**2 / n
            gain[(size < least) | (n - size < least)] = 0
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), (f, float(cut[k])))
    if best[1] is None:
        value[rows] = total / max(n, 1)
        return
    f, cut = best[1]
    above = x[rows, f] > cut
    for side in (False, True):
        step = (*path, (f, side, cut))
        rules.append(step)
        _grow(x, cuts, grad, rows[above == side], step, depth - 1, rules, value)


def tree_rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """The distinct paths of a few boosted trees."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 34)[1:-1])) for c in x.T]
    cuts = [c[c < col.max()] for c, col in zip(cuts, x.T, strict=True)]
    raw, rules = np.full(len(y), np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9))), []
    rng = np.random.default_rng(7)
    for _ in range(TREES):
        grad, value = y - 1 / (1 + np.exp(-raw)), np.zeros(len(y))
        half = rng.permutation(len(y))[: max(len(y) // 2, min(len(y), 200))]
        start = len(rules)
        _grow(x, cuts, grad, np.sort(half), (), 1 + int(rng.integers(DEPTH)), rules, value)
        if len(rules) == start:
            continue
        step = np.zeros(len(y))
        for path in rules[start:]:  # leaves reach the rows outside the half too; an inner node is overwritten by its children
            inside = holds(x, path)
            step[inside] = grad[half][inside[half]].mean() if inside[half].any() else 0
        raw += SHRINK * 4 * step
    return list(dict.fromkeys(tuple(sorted(r)) for r in rules))


def holds(x: np.ndarray, rule: Rule) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, above, cut in rule:
        out &= (x[:, f] > cut) == above
    return out


def lasso(r: np.ndarray, y: np.ndarray, penalty: float = PENALTY, rounds: int = 600) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty, by accelerated proximal gradient steps; the intercept is free."""
    a = np.hstack([np.ones((len(r), 1)), r])
    step = 4 * len(y) / max(np.linalg.norm(a, 2) ** 2, 1e-9)
    w, z, t = np.zeros(a.shape[1]), np.zeros(a.shape[1]), 1.0
    for _ in range(rounds):
        g = a.T @ (1 / (1 + np.exp(-np.clip(a @ z, -50, 50))) - y) / len(y)
        new = z - step * g
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return float(w[0]), w[1:]


class RuleModel:
    """Intercept and weighted rules; ``column`` compiles them."""

    def __init__(self, intercept: float, rules: list[tuple[float, Rule]]):
        self.intercept, self.rules = intercept, rules

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> RuleModel:
        if not len(y) or y.min() == y.max():
            share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
            return cls(float(np.log(share / (1 - share))), [])
        rules = tree_rules(x, y)
        if not rules:
            return cls(float(np.log(y.mean() / (1 - y.mean()))), [])
        w0, w = lasso(np.stack([holds(x, r) for r in rules], 1).astype(float), y)
        return cls(w0, [(float(v), r) for v, r in zip(w, rules, strict=True) if abs(v) > 1e-6])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.intercept + sum((w * holds(x, r) for w, r in self.rules), np.zeros(len(x))))))

    def column(self) -> Column:
        """The score over columns named as FEATURES.

        The rules are one array literal: a nested sum of them takes the driver memory by the square of their number.
        """
        rules = [{"w": w, "tests": [{"f": f + 1, "above": above, "cut": cut} for f, above, cut in rule]} for w, rule in self.rules]
        kind = "array<struct<w: double, tests: array<struct<f: int, above: boolean, cut: double>>>>"
        literal = F.from_json(F.lit(json.dumps(rules)), kind)

        def total(x: Column) -> Column:
            passes = lambda t: (F.element_at(x, t["f"]) > t["cut"]) == t["above"]
            return F.aggregate(literal, F.lit(float(self.intercept)), lambda s, r: s + F.when(F.forall(r["tests"], passes), r["w"]).otherwise(F.lit(0.0)))

        sums = F.transform(F.array(F.array(*NAMES)), total)  # a lambda's argument: the statistics are made once a row
        return 1 / (1 + F.exp(-sums[0]))


def sample(labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``rows`` labelled ids: those with the smallest hashes."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("__id"), F.col(label).cast("double").alias("__y"))
    return known.orderBy(F.xxhash64("__id"), "__id", "__y").limit(rows)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", train: Column | None = None) -> RuleModel:
    """A model from the labelled rows of ``docs``; ``train``: which ids of ``labels`` may be learnt from."""
    known = sample(labels if train is None else labels.filter(train), label)
    picked = docs.select("doc_id", text_bytes().alias("b")).join(F.broadcast(known), F.col("doc_id") == F.col("__id"))  # bounded by SAMPLE_ROWS
    flat = picked.select("__y", stats(F.col("b")).alias("s")).select("__y", "s.*").select("__y", *features())
    got = flat.orderBy(*flat.columns).toPandas().to_numpy(float)  # sorted: the order of arrival must not matter
    got = got.reshape(-1, 1 + len(NAMES))
    return RuleModel.fit(got[:, 1:], got[:, 0])


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: held_out, score, predicted. Rows with crc32(doc_id) mod 5 = 0 are never learnt from."""
    model = fit(docs, labels, train=id_crc() % 5 != 0)
    counted = docs.select("doc_id", stats(text_bytes()).alias("s")).select("doc_id", "s.*").select("doc_id", *features())
    score = counted.select("doc_id", (id_crc() % 5 == 0).alias("held_out"), model.column().alias("score"))
    return score.withColumn("predicted", (F.col("score") >= PREDICT_AT).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, learn_from: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` with a score of PREDICT_AT or more, with all their columns.

    The model learns from the labelled rows of ``learn_from``, by default ``docs``; after a filter of quality few of
    label 0 may be left there.
    """
    model = fit(docs if learn_from is None else learn_from, labels, train=id_crc() % 5 != 0)
    s = free_name(docs, "counts")
    once = docs.withColumn(s, stats(text_bytes(), once=True))
    flat = once.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{s}`.*")).select("row", *features())
    return flat.filter(model.column() >= PREDICT_AT).select("row.*")
