"""Text kernels: white space, tokens, joining, longest common subsequences, inline marks."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache, reduce

import numpy as np
import regex

from .. import limits

#: White space (fixed values: the White_Space property), as the inside of a character class.
SPACE_CLASS = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE_CHARS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SPACES = re.compile(f"[{SPACE_CLASS}]+")
TOKENS = regex.compile(rf"[\p{{Alphabetic}}\p{{N}}_]+|[^{SPACE_CLASS}]")
CLOSING, OPENING = tuple(".,;:!?%)]}"), tuple("([{")
NO_GAP_BEFORE, NO_GAP_AFTER = {*CLOSING, "'", "’"}, {*OPENING, "'", "’"}
LIST_MARKER = re.compile(rf"[{SPACE_CLASS}]*(?:[-*•–—](?:[{SPACE_CLASS}]|$)|(?:[0-9]+|[A-Za-z])[.)][{SPACE_CLASS}])")


def squeeze(text: str) -> str:
    """White space collapsed to single spaces and trimmed."""
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # str.split takes these for white space too
        return SPACES.sub(" ", text).strip(" ")
    return " ".join(text.split())


@lru_cache(4096)
def _tokens(text: str) -> tuple[str, ...]:
    return tuple(TOKENS.findall(text))


def tokens(text: str) -> list[str]:
    """Runs of letters, digits and underscores; every other visible character alone."""
    return list(_tokens(text))


def joined(left: str, right: str) -> str:
    """The two with a space between, unless the right begins with a closing mark or the left ends with an opening one."""
    if not left or not right:
        return left + right
    return left + ("" if right.startswith(CLOSING) or left.endswith(OPENING) else " ") + right


def token_gap(left: str, right: str) -> bool:
    """Whether a space stands between two tokens; apostrophes bind on both sides."""
    return not (right[:1] in NO_GAP_BEFORE or left[-1:] in NO_GAP_AFTER)


def flow(lines: Sequence[str]) -> str:
    return reduce(joined, lines, "")


def variant_key(text: str) -> str:
    return squeeze(text).lower()


_NUMBER = "\u0002"


def role_key(text: str) -> str:
    """Digit runs become ``#``; white space is single and moves behind numbers that follow it; lower case."""
    t = re.sub("[0-9]+", _NUMBER, squeeze(text))
    while " " + _NUMBER in t:
        t = t.replace(" " + _NUMBER, _NUMBER + " ")
    return re.sub(" +", " ", t.replace(_NUMBER, "#")).strip(" ").lower()


def is_list_marker(text: str) -> bool:
    return LIST_MARKER.match(text) is not None


def short_error(message: str) -> str:
    return message if len(message) <= 256 else message[:256] + "..."


def codes(*sides: Sequence) -> list[np.ndarray]:
    """The same whole number for equal items across all sides."""
    index: dict = {}
    return [np.array([index.setdefault(x, len(index)) for x in side], np.int32) for side in sides]


def lcs_table(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of every pair of suffixes; a row at a time, as running maxima."""
    table = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    if not len(b):
        return table
    for i in range(len(a) - 1, -1, -1):
        below = table[i + 1]
        best = np.where(b == a[i], below[1:] + 1, below[:-1])
        table[i, :-1] = np.maximum.accumulate(best[::-1])[::-1]
    return table


def lcs(a: Sequence, b: Sequence) -> int:
    """Length of the longest common subsequence, a bit per item of ``a`` in whole numbers of any size."""
    p, q = affixes(a, b)
    a, b = a[p : len(a) - q], b[p : len(b) - q]
    where: dict = {}
    for k, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    open_ = full
    for y in b:
        hit = open_ & where.get(y, 0)
        open_ = (open_ + hit | open_ - hit) & full
    return p + q + len(a) - open_.bit_count()


def walk(a: Sequence, b: Sequence) -> Iterator[tuple[str, int, int]]:
    """An edit walk: ``=`` as soon as the heads agree, else ``-`` where that loses nothing, else ``+``."""
    p = common_prefix(a, b)
    yield from (("=", k, k) for k in range(p))
    x, y = codes(a[p:], b[p:])
    table = lcs_table(x, y)
    n, m, i, j = len(x), len(y), 0, 0
    x, y = x.tolist(), y.tolist()
    while i < n or j < m:
        if i < n and j < m and x[i] == y[j]:
            yield "=", p + i, p + j
            i, j = i + 1, j + 1
        elif i < n and (j == m or table[i + 1, j] >= table[i, j + 1]):
            yield "-", p + i, p + j
            i += 1
        else:
            yield "+", p + i, p + j
            j += 1


def too_large(n: int, m: int, cells: int = limits.MAX_MATRIX_CELLS) -> bool:
    return (n + 1) * (m + 1) > cells


def similarity(before: str, after: str) -> float:
    """Common tokens over the larger token count; over the size limit only the common beginning counts."""
    if before == after:
        return 1.0
    a, b = tokens(before), tokens(after)
    most = max(len(a), len(b))
    if not most:
        return 1.0
    if too_large(len(a), len(b), limits.MAX_SIMILARITY_CELLS):
        return common_prefix(a, b) / most
    return lcs(a, b) / most


def common_prefix(a: Sequence, b: Sequence) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def affixes(a: Sequence, b: Sequence) -> tuple[int, int]:
    """Common prefix, and common suffix within what the prefix leaves."""
    p = common_prefix(a, b)
    return p, min(common_prefix(a[::-1], b[::-1]), len(a) - p, len(b) - p)


def is_subsequence(source: Sequence, target: Sequence) -> bool:
    rest = iter(target)
    return all(x in rest for x in source)


def edit_kind(before: str, after: str) -> str:
    """added or removed if the shorter's tokens all stand in the longer in order, else modified."""
    a, b = tokens(before), tokens(after)
    if len(a) < len(b) and is_subsequence(a, b):
        return "added"
    if len(b) < len(a) and is_subsequence(b, a):
        return "removed"
    return "modified"


Span = tuple[str, str]


def inline(before: str, after: str) -> tuple[list[Span], list[Span]]:
    """(kind, text) spans of both sides by tokens; neighbours of a kind are one span, which may begin with its space."""
    a, b = tokens(before), tokens(after)
    if too_large(len(a), len(b)):
        return [("removed", before)], [("added", after)]
    left: list[list] = []
    right: list[list] = []

    def put(side: list[list], kind: str, token: str) -> None:
        if not side:
            side.append([kind, [token]])
            return
        last = side[-1]
        if not (token[:1] in NO_GAP_BEFORE or last[1][-1][-1:] in NO_GAP_AFTER):
            token = " " + token
        if last[0] == kind:
            last[1].append(token)
        else:
            side.append([kind, [token]])

    for op, i, j in walk(a, b):
        if op != "+":
            put(left, "equal" if op == "=" else "removed", a[i])
        if op != "-":
            put(right, "equal" if op == "=" else "added", b[j])
    return [(k, "".join(t)) for k, t in left], [(k, "".join(t)) for k, t in right]


def changed_text(before: str, after: str, kind: str) -> str:
    """Only the added (of after) or removed (of before) spans, joined again."""
    spans = inline(before, after)[kind == "added"]
    return reduce(joined, [t for k, t in spans if k == kind], "").strip(SPACE_CHARS)


def marked(text: str, opening: str, closing: str) -> str:
    """The marks around the part without outer white space."""
    core = text.strip(SPACE_CHARS)
    if not core:
        return text
    at = text.index(core)
    return text[:at] + opening + core + closing + text[at + len(core) :]


def marked_line(text: str, spans: Sequence[Span]) -> str:
    """A diff line with its changed spans marked, if it has both equal and changed ones."""
    one_line = lambda t: t.replace("\r", "\\n").replace("\n", "\\n")
    kinds = {k for k, _ in spans}
    if "equal" not in kinds or len(kinds) < 2:
        return one_line(text)
    around = {"added": ("{+", "+}"), "removed": ("[-", "-]")}
    return "".join(marked(one_line(t), *around[k]) if k in around else one_line(t) for k, t in spans)
