"""Line diffs with hunks and inline spans."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field


from .. import limits
from ..functions import words


@dataclass
class Line:
    kind: str
    before_line: int | None
    after_line: int | None
    text: str
    spans: list[words.Span] = field(default_factory=list)


@dataclass
class Hunk:
    before_start: int
    after_start: int
    lines: list[Line]


@dataclass
class TextDiff:
    changed_lines: int = 0
    truncated: bool = False
    hunks: list[Hunk] = field(default_factory=list)


def reads_as_flow(before: Sequence[str], after: Sequence[str], common_lines: int) -> bool:
    """Nearly the same tokens on mostly different lines: the text was wrapped anew and edited."""
    if not before or not after:
        return False
    a, b = ([t for line in side for t in words.tokens(line)] for side in (before, after))
    if a == b or words.too_large(len(a), len(b)):
        return False
    share = words.lcs(a, b) / max(len(a), len(b))
    return share >= limits.FLOW_TOKEN_SIMILARITY and common_lines / max(len(before), len(after)) < limits.FLOW_LINE_SIMILARITY


def flow_diff(before: Sequence[str], after: Sequence[str]) -> TextDiff:
    """One removed and one added line, each the whole text of its side."""
    texts = words.flow(before), words.flow(after)
    spans = words.inline(*texts)
    lines = [Line(k, 1 if k == "removed" else None, 1 if k == "added" else None, t, s) for k, t, s in zip(("removed", "added"), texts, spans, strict=True) if t]
    return TextDiff(len(lines), False, [Hunk(1, 1, lines)])


def add_spans(lines: list[Line]) -> None:
    """Within each island of changed lines the k-th removed is compared with the k-th added; others stand whole."""
    island: list[Line] = []
    for line in [*lines, None]:
        if line is not None and line.kind != "context":
            island.append(line)
            continue
        sides = ([x for x in island if x.kind == k] for k in ("removed", "added"))
        for old, new in zip(*sides, strict=False):
            old.spans, new.spans = words.inline(old.text, new.text)
        for x in island:
            x.spans = x.spans or [(x.kind, x.text)]
        if line is not None:
            line.spans = [("equal", line.text)]
        island = []


def hunks(lines: Sequence[Line], context: int) -> list[Hunk]:
    """Changed lines with their context; ranges that touch are one hunk."""
    context = min(context, limits.MAX_CONTEXT_LINES)
    ranges: list[list[int]] = []
    for k, line in enumerate(lines):
        if line.kind == "context":
            continue
        a, b = max(0, k - context), min(len(lines), k + context + 1)
        if ranges and a <= ranges[-1][1]:
            ranges[-1][1] = max(b, ranges[-1][1])
        else:
            ranges.append([a, b])
    first = lambda part, side: next((n for x in part if (n := getattr(x, side)) is not None), 1)
    return [Hunk(first(lines[a:b], "before_line"), first(lines[a:b], "after_line"), list(lines[a:b])) for a, b in ranges]


def text_diff(before: Sequence[str], after: Sequence[str], context: int = 3) -> TextDiff:
    """The diff of two pages' lines."""
    if words.too_large(len(before), len(after)):
        return TextDiff(truncated=True)
    if reads_as_flow(before, after, common_lines(before, after)):
        return flow_diff(before, after)
    lines = []
    for op, i, j in words.walk(before, after):
        if op == "=":
            lines.append(Line("context", i + 1, j + 1, before[i]))
        elif op == "-":
            lines.append(Line("removed", i + 1, None, before[i]))
        else:
            lines.append(Line("added", None, j + 1, after[j]))
    add_spans(lines)
    return TextDiff(sum(x.kind != "context" for x in lines), False, hunks(lines, context))


def common_lines(before: Sequence[str], after: Sequence[str]) -> int:
    return words.lcs(list(before), list(after))


