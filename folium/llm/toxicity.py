"""Toxicity by maximum-scoring segments.

Learning: the words of a bounded labelled sample, and their beginnings of STEMS characters, are counted by class, once
per text. A weight is the log-odds between toxic and clean texts with an informative Dirichlet prior (each class is
smoothed by pseudo-words, PRIOR of all words, that follow the pooled frequencies). A word has its own weight if that is z standard
errors away from zero, with the z of ZS that scores left-out folds of the learnable rows best, else that of its longest beginning of which this holds, so inflected words are found by their
stems. All other words share one weight, their log-odds together, less a small DRIFT, so that a clean text's expected
score is negative.

Scoring: a linear scan (Ruzzo and Tompa) over the word weights finds all maximal-scoring segments of the whole text.
Under the clean words' distribution the best segment of n words follows an extreme-value law with parameters lambda
(the root of the mean of exp(lambda * weight) = 1) and K (from the clean sample's best segments). A segment's excess is
lambda * score - ln(K n), and the passages with an expected count below E_VALUE are reported. The text's features, the
logarithms of the best excess and of the summed excess of significant passages, are turned into a probability by a ridge logistic.

At most SAMPLE_ROWS labelled rows are learnt from (smallest hashes of ids; equal texts of a class count once), and z is
chosen on at most CHOICE_ROWS of them in FOLDS folds, equal texts in one fold. Every row is scored. Labels, language, source and id are no inputs.

Edge cases: null and empty texts have no words and get the lowest score; without labels of both classes every score is
the share of label 1, or 0; ties in weights are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, id_crc, text_bytes

SAMPLE_ROWS = 20_000
PREDICT_AT = 0.7
PRIOR, LEAST_WEIGHT, DRIFT = 0.02, 1.0, 0.02
#: Standard errors that a weight must be away from zero: what is tried, on how many rows and folds of the learnable ones.
ZS, CHOICE_ROWS, CHOICE_TASKS, FOLDS = (2.0, 2.5, 3.0), 6000, 24, 3
STEMS = range(4, 10)
E_VALUE = 0.01
#: Words whose weights a worker remembers.
REMEMBER = 500_000
RIDGE = 0.1

_PLAIN = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    """ASCII-lower-cased words; ASCII marks and white space stand between them."""
    return text.translate(_PLAIN).split()


def stems(word: bytes) -> list[bytes]:
    """The word's proper beginnings of STEMS characters, shortest first, each marked with a star, which no word holds."""
    text = word.decode("utf-8", "replace")
    return [text[:k].encode() + b"*" for k in STEMS if k < len(text)] + ([word + b"*"] if len(text) in STEMS else [])


class Weights(dict):
    """The weight of every word: its own, else its longest known stem's, else the rest's; computed once per word."""

    def __init__(self, known: dict[bytes, float], rest: float):
        super().__init__()
        self.known, self.rest = known, rest

    def __missing__(self, word: bytes) -> float:
        w = self.known.get(word)
        if w is None:
            w = next((self.known[x] for x in reversed(stems(word)) if x in self.known), self.rest)
        if len(self) >= REMEMBER:
            self.clear()
        self[word] = w
        return w


@dataclass(frozen=True)
class Model:
    """Weights of significant words and stems, the weight of all others, the extreme-value law and the logistic."""

    weights: dict[bytes, float]
    rest: float
    lam: float = 1.0
    log_k: float = 0.0
    logistic: tuple[float, ...] = (-4.0, 1.0, 0.0)

    @cached_property
    def of_word(self) -> Weights:
        return Weights(self.weights, self.rest)

    def segments(self, tokens: list[bytes]) -> list[tuple[int, int, float]]:
        """All maximal-scoring segments (first word, end, score), in order."""
        w = np.fromiter(map(self.of_word.__getitem__, tokens), np.float64, len(tokens))
        return maximal(w)

    def excess(self, score: float, n: int) -> float:
        return self.lam * score - self.log_k - math.log(max(n, 1))

    def excesses(self, tokens: list[bytes]) -> list[tuple[int, int, float]]:
        """All segments with their excess."""
        return [(a, b, self.excess(s, len(tokens))) for a, b, s in self.segments(tokens)]

    def passages(self, tokens: list[bytes]) -> list[tuple[int, int, float]]:
        """The significant segments with their excess."""
        return significant(self.excesses(tokens))

    def features(self, tokens: list[bytes]) -> tuple[float, float]:
        return features_of(self.excesses(tokens))

    def score(self, found: list[tuple[int, int, float]]) -> float:
        """Of a text's segments with their excess."""
        a, b, c = self.logistic
        x, y = features_of(found)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x + c * y))))


def significant(found: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    return [x for x in found if x[2] > -math.log(E_VALUE)]


def features_of(found: list[tuple[int, int, float]]) -> tuple[float, float]:
    """Logarithms of the best excess and of the summed excess of significant segments."""
    best = max((x for _, _, x in found), default=0.0)
    return math.log1p(max(best, 0.0)), math.log1p(sum(x for _, _, x in significant(found)))


def maximal(w: np.ndarray) -> list[tuple[int, int, float]]:
    """Ruzzo and Tompa's linear scan; runs between positive weights enter as one step, which changes nothing."""
    total = np.concatenate([[0.0], np.cumsum(w)])
    stack: list[list[float]] = []  # first, end, sum before, sum after, index of the nearest earlier entry that begins lower
    for i in np.flatnonzero(w > 0).tolist():
        one = [i, i + 1, total[i], total[i + 1], -1]
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= one[2]:
                j = int(stack[j][4])
            if j < 0 or stack[j][3] >= one[3]:
                one[4] = j
                stack.append(one)
                break
            one[0], one[2] = stack[j][0], stack[j][2]
            del stack[j:]
            j = len(stack) - 1
    return [(int(a), int(b), float(q - p)) for a, b, p, q, _ in stack]


# --- learning --------------------------------------------------------------------------------------------------------


def _batch(rows: list[tuple], **kinds: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts by word and stem, per fold and class: columns clean0, toxic0, clean1, ..."""
    by = [Counter() for _ in range(2 * FOLDS)]
    for batch in batches:
        for y, text, fold in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            by[2 * fold + (int(y) > 0)].update(set(words(text.as_py())))
    for one in by:
        for word, n in list(one.items()):
            for stem in stems(word):
                one[stem] += n
    every = list(set().union(*by))
    for at in range(0, len(every), 50_000):
        some = every[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()), *[pa.array([one[x] for x in some], pa.int64()) for one in by]], names=["word", *COUNTS])


COUNTS = [f"{kind}{fold}" for fold in range(FOLDS) for kind in ("clean", "toxic")]


def without(counts: DataFrame, fold: int | None) -> DataFrame:
    """word, clean, toxic over all folds but one."""
    total = lambda kind: sum((F.col(f"{kind}{k}") for k in range(FOLDS) if k != fold), F.lit(0))
    return counts.select("word", total("clean").alias("clean"), total("toxic").alias("toxic")).filter("clean + toxic > 0")


def log_odds(counts: DataFrame, zs: tuple[float, ...] = ZS) -> dict[float, tuple[dict[bytes, float], float, dict[float, float]]]:
    """For each z: weights of significant words, weight of the rest, clean distribution of weights; from word counts by class."""
    n = counts.filter(~F.endswith("word", F.lit(b"*"))).agg(F.coalesce(F.sum("clean"), F.lit(0)).alias("c"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    if not n.c or not n.t:
        return {z: ({}, -DRIFT, {-DRIFT: 1.0}) for z in zs}
    pseudo = PRIOR * (n.c + n.t)
    prior = F.lit(PRIOR) * (F.col("clean") + F.col("toxic"))
    t, c = F.col("toxic") + F.col("a"), F.col("clean") + F.col("a")
    scored = counts.withColumn("a", prior).select(
        "word", "clean", "toxic",
        (F.log(t / (n.t + pseudo - t)) - F.log(c / (n.c + pseudo - c))).alias("w"), F.sqrt(1 / t + 1 / c).alias("se"),
    )
    # the sample is bounded, and so are its words
    found = scored.filter(f"abs(w) > {min(zs)} * se and abs(w) > {LEAST_WEIGHT}").orderBy("word").collect()
    out = {}
    for z in zs:
        kept = [r for r in found if abs(r.w) > z * r.se]
        weights = {bytes(r.word): float(r.w) for r in kept}
        # those without a kept stem of their own are disjoint and cover all words that have a weight
        cover = [r for r in kept if not any(x in weights and x != bytes(r.word) for x in stems(bytes(r.word).removesuffix(b"*")))]
        rest_t, rest_c = n.t - sum(r.toxic for r in cover), n.c - sum(r.clean for r in cover)
        rest = min(math.log(((rest_t + 1) / (n.t + 1)) / ((rest_c + 1) / (n.c + 1))) - DRIFT, -DRIFT)
        share: dict[float, float] = Counter()
        for r in cover:
            share[float(r.w)] += (r.clean + 0.5) / n.c
        share[rest] += max(rest_c / n.c, 1e-9)
        out[z] = weights, rest, share
    return out


def karlin_lambda(share: dict[float, float]) -> float:
    """The positive root of the mean of exp(lambda * weight) = 1; 1 if the mean weight isn't negative."""
    w, p = np.array(list(share)), np.array(list(share.values()))
    p = p / p.sum()
    if (w * p).sum() >= 0 or w.max() <= 0:
        return 1.0
    low, high = 1e-6, 1.0
    mean = lambda x: float((p * np.exp(np.minimum(x * w, 700))).sum())
    while mean(high) < 1 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if mean(mid) < 1 else (low, mid)
    return high


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Ridge logistic regression by Newton's method; a step is halved until the penalised loss falls.

    Features may separate the classes, so the intercept is penalised too, if less.
    """
    a = np.hstack([np.ones((len(x), 1)), x])
    w, ridge = np.zeros(a.shape[1]), RIDGE * np.array([0.1, *[1.0] * x.shape[1]])

    def loss(w: np.ndarray) -> float:
        z = a @ w
        return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * ridge @ w**2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge), a.T @ (y - p) - ridge * w)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > loss(w):
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def calibrated(sample: DataFrame, models: list[tuple[Model, int | None]]) -> list[tuple[Model, np.ndarray]]:
    """Each model with its extreme-value law and logistic, and (label, features) of the rows of the fold left out.

    ``sample`` has y, b and fold; a model learns from the other folds' rows alone. Two passes for all models together.
    """

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for y, text, fold in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens = words(text)
                if not y and tokens:
                    rows += [(k, len(tokens), max((s for _, _, s in m.segments(tokens)), default=0.0)) for k, (m, out) in enumerate(models) if fold != out]
            if rows:
                yield _batch(rows, k=pa.int64(), n=pa.int64(), best=pa.float64())

    got = sample.mapInArrow(best, "k long, n long, best double").orderBy("k", "n", "best").toPandas()
    laws = []
    for k, (m, _) in enumerate(models):
        clean = got[got["k"] == k]
        # the mean of an extreme-value law is (ln(K n) + Euler's constant) / lambda
        log_k = float((m.lam * clean["best"] - np.log(clean["n"])).mean() - 0.5772156649) if len(clean) else 0.0
        laws.append(replace(m, log_k=max(log_k, -20.0)))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for y, text, fold in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens = words(text)
                rows += [(k, fold, y, *m.features(tokens)) for k, m in enumerate(laws)]
            if rows:
                yield _batch(rows, k=pa.int64(), fold=pa.int64(), y=pa.int64(), u=pa.float64(), v=pa.float64())

    x = sample.mapInArrow(features, "k long, fold long, y long, u double, v double").orderBy("k", "y", "u", "v", "fold").toPandas()
    out = []
    for k, (law, (_, left)) in enumerate(zip(laws, models, strict=True)):
        own, held = (x[(x["k"] == k) & side][["y", "u", "v"]].to_numpy(float) for side in (x["fold"] != left, x["fold"] == left))
        out.append((replace(law, logistic=logistic(own[:, 1:], own[:, 0])), held))
    return out


def loss(model: Model, rows: np.ndarray) -> float:
    """Sum of the logarithmic loss over rows of label and features."""
    z = np.clip(model.logistic[0] + rows[:, 1:] @ np.array(model.logistic[1:]), -30, 30)
    return float(np.logaddexp(0, z).sum() - rows[:, 0] @ z)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", train=None) -> Model:
    """A model from at most SAMPLE_ROWS labelled rows of ``docs``; z is the one that loses least on the folds left out."""
    known = (labels if train is None else labels.filter(train)).filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    ids = known.select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("y")).orderBy(F.xxhash64("__id"), "__id", "y").limit(SAMPLE_ROWS)
    texts = docs.select("doc_id", text_bytes().alias("b")).join(F.broadcast(ids), F.col("doc_id") == F.col("__id")).select("y", "b")  # bounded by SAMPLE_ROWS
    sample = checkpoint(texts.withColumn("fold", F.pmod(F.xxhash64("b"), F.lit(FOLDS)).cast("int")))
    size = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not size.get(0) or not size.get(1):
        share = size.get(1, 0) / max(sum(size.values()), 1)
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model({}, -DRIFT, logistic=(math.log(share / (1 - share)), 0.0, 0.0))
    once = sample.distinct()  # of equal texts of a class one teaches words; distinct texts all do, however alike they begin
    kinds = ", ".join(f"{c} long" for c in COUNTS)
    counts = checkpoint(once.mapInArrow(_count, f"word binary, {kinds}").groupBy("word").agg(*[F.sum(c).alias(c) for c in COUNTS]))
    first = lambda fold: {z: Model(w, rest, karlin_lambda(share)) for z, (w, rest, share) in log_odds(without(counts, fold)).items()}
    tried = [(z, fold, m) for fold in range(FOLDS) for z, m in first(fold).items()]
    some = checkpoint(sample.orderBy(F.xxhash64("b", F.lit(1)), "y").limit(CHOICE_ROWS).repartition(CHOICE_TASKS))  # a limit leaves one task
    lost = dict.fromkeys(ZS, 0.0)
    for (z, _, _), (model, held) in zip(tried, calibrated(some, [(m, fold) for _, fold, m in tried]), strict=True):
        lost[z] += loss(model, held)
    chosen = min(ZS, key=lambda z: (lost[z], z))
    return calibrated(sample, [(first(None)[chosen], None)])[0][0]


FOUND = pa.struct([("score", pa.float64()), ("passages", pa.int64()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("expected", pa.float64())])


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """Of every row, from its whole text: doc_id, score, the number of significant passages, and of the strongest one
    its first word, end and expected count in clean texts (null without any)."""

    def found(text: bytes) -> dict:
        every = model.excesses(words(text))
        spans = significant(every)
        a, b, x = max(spans, key=lambda s: (s[2], -s[0]), default=(None, None, None))
        return {"score": model.score(every), "passages": len(spans), "first_word": a, "end_word": b, "expected": None if x is None else math.exp(-x)}

    def run(text: pa.Array) -> pa.Array:
        return pa.array([found(x.as_py() or b"") for x in text], FOUND)

    kind = "struct<score:double,passages:long,first_word:long,end_word:long,expected:double>"
    return docs.select("doc_id", F.arrow_udf(run, kind)(text_bytes()).alias("f")).select("doc_id", "f.*")


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, first_word, end_word, excess of every significant passage."""
    kind = "array<struct<first_word:long,end_word:long,excess:double>>"

    def run(text: pa.Array) -> pa.Array:
        item = pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("excess", pa.float64())])
        rows = [[{"first_word": a, "end_word": b, "excess": x} for a, b, x in model.passages(words(t.as_py() or b""))] for t in text]
        return pa.array(rows, pa.list_(item))

    return docs.select("doc_id", F.explode(F.arrow_udf(run, kind)(text_bytes())).alias("p")).select("doc_id", "p.*")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and the passages of ``scores``; rows with crc32(doc_id) mod 3 = 1 are never learnt from."""
    model = fit(docs, labels, train=id_crc() % 3 != 1)
    out = scores(docs, model).withColumn("predicted", (F.col("score") >= PREDICT_AT).cast("int"))
    return out.select("doc_id", (id_crc() % 3 == 1).alias("held_out"), "score", "predicted", "passages", "first_word", "end_word", "expected")
