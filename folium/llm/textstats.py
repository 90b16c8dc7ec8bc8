"""Counts over whole texts, made once per text on its UTF-8 bytes.

Words are ``[^\\x20\\x09-\\x0D]+``, which is what ``bytes.split()`` returns. All counts are exact and have no upper
bound on the length of a text; a null text counts as an empty one.
"""

from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELDS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_adjacent",
    "n_upper", "n_digits", "n_marks", "n_pipes", "n_dots", "n_stops",
)
SCHEMA = T.StructType([T.StructField(f, T.LongType()) for f in FIELDS])

WHITE = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = b"0123456789"
CONTINUATION = bytes(range(0x80, 0xC0))
#: Frequent function words of the four languages of the corpus.
STOPS = frozenset(
    "the of and to in is that for it with on as are by this from or an be was und der die das von mit den ist für ein "
    "eine auf zu im dem le la les de des et que du un une en dans pour est sur pas el los las y por con del se al su".encode().split()
)


def _gone(text: bytes, chars: bytes) -> int:
    return len(text) - len(text.translate(None, chars))


def repeated(words: list[bytes]) -> tuple[int, int, int]:
    """Words inside 3-word windows that occur twice or more; distinct words; words equal to the one before."""
    index: dict[bytes, int] = defaultdict(itertools.count().__next__)
    ids = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
    n, m = len(ids), len(index)
    same = int((ids[1:] == ids[:-1]).sum())
    if n < 3 or m == n:
        return 0, m, same
    pair = ids[:-1] * m + ids[1:]
    if m > 1_000_000:  # a third factor of m would leave 64 bits
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    window = pair[:-1] * m + ids[2:]
    order = np.sort(window)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0, m, same
    twice = np.unique(twice)
    hit = twice[np.minimum(np.searchsorted(twice, window), len(twice) - 1)] == window
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[k : n - 2 + k] |= hit
    return int(inside.sum()), m, same


def counts(text: bytes) -> tuple[int, ...]:
    """The values of FIELDS for one text."""
    words = text.split()
    n = len(words)
    if not n:
        return (0, 0, _gone(text, SYMBOLS)) + (0,) * (len(FIELDS) - 3)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    repeats, distinct, adjacent = repeated(words)
    return (
        n,
        len(text.translate(None, WHITE + CONTINUATION)),
        _gone(text, SYMBOLS),
        len(lines) - len(set(lines)),
        repeats,
        len(lines),
        distinct,
        adjacent,
        _gone(text, UPPER),
        _gone(text, DIGITS),
        text.count(b"!"),
        text.count(b"|"),
        text.count(b"."),
        sum(map(STOPS.__contains__, words)),
    )


def _stats(text: pa.Array) -> pa.Array:
    rows = np.array([counts(x.as_py() or b"") for x in text], np.int64).reshape(-1, len(FIELDS))
    return pa.StructArray.from_arrays([pa.array(rows[:, k].copy()) for k in range(len(FIELDS))], names=list(FIELDS))


def stats(text: Column, once: bool = False) -> Column:
    """FIELDS of each text, given as UTF-8 bytes; ``once``: a filter above may not run it a second time."""
    udf = F.arrow_udf(_stats, SCHEMA)
    return (udf.asNondeterministic() if once else udf)(text)
