"""From positioned text segments to lines in reading order; one page at a time."""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Sequence
from functools import reduce
from itertools import pairwise
from typing import NamedTuple

from .. import limits
from ..functions import boxes, words
from ..functions.boxes import Box


class Fragment(NamedTuple):
    text: str
    box: Box


class Run(NamedTuple):
    text: str
    box: Box
    fragments: tuple[Fragment, ...] = ()

    def parts(self) -> tuple[Fragment, ...]:
        return self.fragments or (Fragment(self.text, self.box),)


def clean(runs: Sequence[Run]) -> list[Run]:
    """White space collapsed, empty runs dropped, a run without fragments is its own."""
    kept = (r._replace(text=words.squeeze(r.text)) for r in runs)
    return [r._replace(fragments=r.parts()) for r in kept if r.text]


def grouped(runs: Sequence[Run]) -> list[list[Run]]:
    """Each run, in input order, joins the line with the closest member among lines that have one on its level."""
    if len(runs) > 32:
        return _grouped_many(runs)
    lines: list[list[Run]] = []
    for run in runs:
        near = [
            (min(abs(run.box.cy - m.box.cy) for m in line), k)
            for k, line in enumerate(lines)
            if any(boxes.same_line(m.box, run.box) for m in line)
        ]
        if near:
            lines[min(near)[1]].append(run)
        else:
            lines.append([run])
    return lines


def _grouped_many(runs: Sequence[Run]) -> list[list[Run]]:
    """The same for pages of many runs, which are found by cells as wide and tall as a run on the same line can be away."""
    tall = max([1.0, *(r.box.height for r in runs)])
    reach = max(8 * tall, 32.0)
    cells: dict[tuple[int, int], list[tuple[Box, int]]] = defaultdict(list)
    levels: list[list[float]] = []  # the sorted middles of each line's members
    lines: list[list[Run]] = []

    def closest(k: int, cy: float) -> float:
        at = bisect_left(levels[k], cy)
        return min(abs(cy - m) for m in levels[k][max(at - 1, 0) : at + 1])

    for run in runs:
        b, row = run.box, math.floor(run.box.cy / tall)
        columns = range(math.floor((b.x - reach) / reach), math.floor((b.right + reach) / reach) + 1)
        near = {k for c in columns for r in (row - 1, row, row + 1) for box, k in cells.get((c, r), ()) if boxes.same_line(box, b)}
        if near:
            k = min((closest(k, b.cy), k) for k in near)[1]
        else:
            k = len(lines)
            lines.append([])
            levels.append([])
        lines[k].append(run)
        insort(levels[k], b.cy)
        for c in range(math.floor(b.x / reach), math.floor(b.right / reach) + 1):
            cells[c, row].append((b, k))
    return lines


def line_of(members: Sequence[Run]) -> Run:
    """One run from a line's members, left to right."""
    across = sorted(members, key=lambda r: r.box.x)
    text = reduce(words.joined, [r.text for r in across])
    return Run(text, boxes.around(r.box for r in across), tuple(f for r in across for f in r.parts()))


def down_the_page(lines: Sequence[Run]) -> list[Run]:
    return sorted(lines, key=lambda r: (r.box.cy, r.box.x))


def column_split(lines: Sequence[Run], careful: bool) -> float | None:
    """The middle of the gap between edges that splits most lines evenly; wider gaps win ties, then the first."""
    least, side, spanning = (4, 2, len(lines) // 4) if careful else (2, 1, len(lines) // 2)
    if len(lines) < least:
        return None
    edges: list[float] = []
    for e in sorted(e for r in lines for e in (r.box.x, r.box.right)):
        if not edges or abs(edges[-1] - e) >= 0.5:
            edges.append(e)
    best, found = (0, 0.0), None
    for a, b in pairwise(edges):
        if b - a < limits.COLUMN_GAP:
            continue
        at = (a + b) / 2
        left, right = sum(r.box.right <= at for r in lines), sum(r.box.x >= at for r in lines)
        if min(left, right) < side or len(lines) - left - right > spanning:
            continue
        if (min(left, right), b - a) > best:
            best, found = (min(left, right), b - a), at
    return found


def ordered(lines: Sequence[Run], reading_order: str = "auto") -> list[Run]:
    """Rows, or columns between the lines that span them."""
    lines = down_the_page(lines)
    at = None if reading_order == "rows" else column_split(lines, reading_order == "auto")
    if at is None:
        return lines
    left = [r for r in lines if r.box.right <= at]
    right = [r for r in lines if r.box.right > at and r.box.x >= at]
    across = [r for r in lines if r.box.right > at and r.box.x < at]
    if len(left) < 2 or len(right) < 2:
        return left + across + right
    heights = [r.box.cy for r in left + right]
    above = [r for r in across if r.box.cy <= min(heights)]
    below = [r for r in across if min(heights) < r.box.cy and r.box.cy > max(heights)]
    between = [r for r in across if min(heights) < r.box.cy <= max(heights)]
    return above + left + between + right + below


def normalize(runs: Sequence[Run], reading_order: str = "auto") -> list[Run]:
    """Segments of a page to its lines in reading order."""
    return ordered([line_of(members) for members in grouped(clean(runs))], reading_order)
