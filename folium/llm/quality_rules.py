"""Quality rules by weak supervision: rules vote or abstain, EM weighs them, a posterior decides.

Each rule looks at counts of the whole text and votes bad (-1), good (+1) or abstains (0). Over the corpus only the
number of documents per vote pattern matters: with R rules there are at most 3**R patterns, whatever the input, so
that table goes to the driver and expectation-maximisation of a two-class model with one confusion vector per rule
(Dawid and Skene) runs there over all documents. Each pattern's posterior is then a literal of a column expression.

Edge cases: a null or empty text has no words and fails the base test; an empty table gives an empty result; repeated
rows count as often as they occur, and each is returned; other columns are never read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, free_name, text_bytes
from .textstats import stats

#: Votes per rule: (bad if, good if) as SQL over the counts; neither: the rule abstains.
RULES: dict[str, tuple[str, str]] = {
    "symbols": ("n_symbols > 0.06 * word_chars", "n_symbols <= 0.002 * word_chars"),
    "capitals": ("n_upper > 0.35 * word_chars", "false"),
    "adjacent": ("n_adjacent > 0.2 * n_words", "false"),
    "repeats": ("n_repeat_words > 0.4 * n_words", "false"),
    "lines": ("n_dup_lines > 0.4 * n_lines and n_lines >= 3", "n_dup_lines = 0 and n_lines >= 3"),
    "marks": ("n_marks > 0.2 * n_words", "false"),
    "pipes": ("n_pipes > 0.2 * n_words", "false"),
    "prose": ("n_stops = 0 and n_words >= 50", "n_stops between 0.05 * n_words and 0.7 * n_words"),
}
PRIOR_GOOD = 0.85
#: Before any data: how often a rule abstains, votes good, votes bad on a good and on a bad text.
PRIOR_VOTES = np.array([[0.59, 0.40, 0.01], [0.55, 0.20, 0.25]])
PRIOR_SHARE = 0.1
KEEP_AT = 0.5


def base_failed() -> Column:
    """Too short, or over half of the words inside repeated 3-word windows."""
    return F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")


def votes(rules: dict[str, tuple[str, str]] | None = None) -> Column:
    """The vote pattern as one base-3 number: digit 0 abstains, 1 good, 2 bad, first rule lowest."""
    digits = [f"{3**k} * (case when {bad} then 2 when {good} then 1 else 0 end)" for k, (bad, good) in enumerate((rules or RULES).values())]
    return F.expr(" + ".join(digits)).cast("int")


def fit(patterns: np.ndarray, weights: np.ndarray, n_rules: int, rounds: int = 1000) -> np.ndarray:
    """Posterior probability of good for every possible pattern, by EM on pattern counts.

    Each rule has for each class a distribution over its three votes. Pseudo-documents, PRIOR_SHARE of the corpus,
    vote as PRIOR_VOTES say: a rule seldom votes bad on a good text. They settle which class is which and keep
    unseen votes possible.
    """
    digits = lambda p: (p[:, None] // 3 ** np.arange(n_rules)) % 3
    every = digits(np.arange(3**n_rules))
    prior = np.maximum(PRIOR_SHARE * float(weights.sum()), 1.0) * PRIOR_VOTES
    share, table = PRIOR_GOOD, np.repeat((prior / prior.sum(1, keepdims=True))[:, None, :], n_rules, 1)

    def posterior(d: np.ndarray) -> np.ndarray:
        ll = np.log(table[:, np.arange(n_rules), d]).sum(2) + np.log([[share], [1 - share]])
        return 1 / (1 + np.exp(np.clip(ll[1] - ll[0], -500, 500)))

    if len(patterns) and weights.sum() > 0:
        seen = digits(patterns)
        hot = np.eye(3)[seen]
        for _ in range(rounds):
            good = posterior(seen)
            new = np.stack([np.einsum("p,prv->rv", weights * g, hot) + q for g, q in ((good, prior[0]), (1 - good, prior[1]))])
            new /= new.sum(2, keepdims=True)
            part = float(np.clip((weights * good).sum() / weights.sum(), 0.02, 0.98))
            moved = max(abs(part - share), float(np.abs(new - table).max()))
            table, share = new, part
            if moved < 1e-9:
                break
    return posterior(every)


def learn(counted: DataFrame, rules: dict[str, tuple[str, str]] | None = None) -> np.ndarray:
    """EM over all rows of a table that has the counts as columns; at most 3**R rows reach the driver."""
    rules = rules or RULES
    rows = counted.groupBy(votes(rules).alias("p")).agg(F.count("*").alias("n")).collect()
    return fit(np.array([r.p for r in rows], int), np.array([r.n for r in rows], float), len(rules))


def verdict(posterior: np.ndarray, rules: dict[str, tuple[str, str]] | None = None, keep_at: float = KEEP_AT) -> tuple[Column, Column]:
    """(posterior of good, kept) over the counts; the pattern table is an array literal of 3**R floats."""
    p = F.element_at(F.from_json(F.lit("[" + ",".join(f"{x:.6g}" for x in posterior) + "]"), "array<double>"), votes(rules) + 1)
    return p, ~base_failed() & (p >= keep_at)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, base test, posterior and verdict for each row; texts are read once, counts are checkpointed."""
    counted = checkpoint(docs.select(F.col(id_col), stats(text_bytes(text_col)).alias("s")).select(F.col(id_col), "s.*"))
    p, kept = verdict(learn(counted))
    return counted.select("*", base_failed().alias("base_failed"), p.alias("posterior"), kept.alias("kept"))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns; two passes over the texts, no shuffle of them."""
    s = free_name(docs, "counts")
    posterior = learn(docs.select(stats(text_bytes(text_col)).alias("s")).select("s.*"))
    once = docs.withColumn(s, stats(text_bytes(text_col), once=True))  # else the filter would run it twice
    p, kept = verdict(posterior)
    keep = f"{s}_keep"
    inner = docs.columns
    flat = once.select(F.struct(*[F.col(f"`{c}`") for c in inner]).alias("row"), F.col(f"`{s}`.*"))
    return flat.select("row", kept.alias(keep)).filter(F.col(keep)).select("row.*")
