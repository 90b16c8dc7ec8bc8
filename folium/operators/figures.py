"""Image figures of a page pair: by identity, then by slot."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from ..functions import boxes
from ..functions.boxes import Box


class Figure(NamedTuple):
    box: Box
    content: int


class FigureDiff(NamedTuple):
    id: str
    status: str
    before: Box | None
    after: Box | None
    confidence: float


def matched(before: Sequence[Figure], after: Sequence[Figure]) -> list[tuple[int, int, bool, float]]:
    """(before, after, same content, confidence): the nearest of equal content, then the best slot (the last of equals)."""
    free, out, rest = set(range(len(after))), [], []
    for i, f in enumerate(before):
        same = [j for j in free if after[j].content == f.content]
        if not same:
            rest.append(i)
            continue
        j = min(same, key=lambda j: (boxes.distance(f.box, after[j].box), j))
        free.discard(j)
        out.append((i, j, True, 1.0))
    for i in rest:
        scored = [(s, j) for j in free if (s := boxes.slot_score(before[i].box, after[j].box)) is not None]
        if scored:
            score, j = max(scored)
            free.discard(j)
            out.append((i, j, False, score))
    return out


def compare(before: Sequence[Figure], after: Sequence[Figure]) -> list[FigureDiff]:
    """swapped, moved, modified; then removed, then added."""
    pairs = matched(before, after)
    same = [(i, j) for i, j, exact, _ in pairs if exact]
    rows: list[tuple] = []
    for i, j, exact, confidence in pairs:
        a, b = before[i].box, after[j].box
        if exact and boxes.close(a, b):
            continue
        status = "modified"
        if exact:
            trades = any(p != i and boxes.overlap_share(b, before[p].box) >= 0.6 and boxes.overlap_share(after[q].box, a) >= 0.6 for p, q in same)
            status = "swapped" if trades else "moved"
        rows.append((status, a, b, confidence))
    old, new = ({p[k] for p in pairs} for k in (0, 1))
    rows += [("removed", f.box, None, 1.0) for i, f in enumerate(before) if i not in old]
    rows += [("added", None, f.box, 1.0) for j, f in enumerate(after) if j not in new]
    return [FigureDiff(f"figure-{k}", *row) for k, row in enumerate(rows, 1)]
