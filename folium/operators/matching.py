"""Positioned-run changes and review blocks of a page pair."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from .. import limits
from ..functions import boxes, words
from ..functions.boxes import Box
from .reading import Run
from .textdiff import TextDiff, text_diff


@dataclass
class Change:
    id: str
    kind: str
    before_text: str | None = None
    after_text: str | None = None
    before_box: Box | None = None
    after_box: Box | None = None
    before_focus: Box | None = None
    after_focus: Box | None = None


@dataclass
class Block(Change):
    structure: str = "paragraph"
    confidence: float = 1.0
    before_role: str | None = None
    after_role: str | None = None
    diff: TextDiff = field(default_factory=TextDiff)


@dataclass
class Summary:
    """What text extraction gave for one page side."""

    runs: int = 0
    characters: int = 0
    replaced: int = 0
    status: str = "empty"
    error: str | None = None

    @classmethod
    def of(cls, runs: Sequence[Run], replaced: int = 0) -> Summary:
        status = "empty" if not runs else "suspect" if replaced else "text"
        return cls(len(runs), sum(len(r.text) for r in runs), replaced, status)

    @classmethod
    def failed(cls, message: str) -> Summary:
        return cls(status="suspect", error=words.short_error(message))


@dataclass
class PageText:
    """The semantic comparison of a page pair."""

    equal: bool
    quality: str
    before: Summary
    after: Summary
    changes: list[Change] = field(default_factory=list)
    truncated: bool = False
    diff: TextDiff = field(default_factory=TextDiff)
    blocks: list[Block] = field(default_factory=list)


def quality(before: str, after: str) -> str:
    """Of both sides' extraction statuses."""
    both = {before, after}
    return "suspect" if "suspect" in both else "empty" if both == {"empty"} else "partial" if "empty" in both else "text"


# --- focus boxes -----------------------------------------------------------------------------------------------------


def token_focus(run: Run, other: Run) -> Box:
    """The slice of the box, in proportion to tokens, that holds what the other run lacks."""
    own, theirs = words.tokens(run.text), words.tokens(other.text)
    if not own or not theirs:
        return run.box
    prefix, suffix = words.affixes(own, theirs)
    changed, box = len(own) - prefix - suffix, run.box
    start = box.x + box.width * prefix / len(own)
    least = 0.7 * box.height
    width = max(box.width * changed / len(own), least) if changed else min(least, max(box.width, 1.0))
    return Box(start, box.y, min(width, max(box.right - start, 0.0)), box.height)


def focus(before: Run, after: Run) -> tuple[Box, Box]:
    """The union of the fragments that differ on each side; tokens decide where fragments say nothing."""
    a, b = before.parts(), after.parts()
    prefix, suffix = words.affixes([f.text for f in a], [f.text for f in b])
    out = []
    for run, other, parts in ((before, after, a), (after, before, b)):
        box = boxes.around(f.box for f in parts[prefix : len(parts) - suffix])
        out.append(token_focus(run, other) if box is None or box == run.box or len(run.fragments) <= 1 else box)
    return out[0], out[1]


def sided(change: Change) -> Change:
    """Without the side that an added or removed change does not own."""
    if change.kind == "added":
        return replace(change, before_text=None, before_box=None, before_focus=None)
    if change.kind == "removed":
        return replace(change, after_text=None, after_box=None, after_focus=None)
    return change


def owned_texts(kind: str, before: str, after: str) -> tuple[str | None, str | None]:
    if kind == "added":
        return None, words.changed_text(before, after, "added")
    if kind == "removed":
        return words.changed_text(before, after, "removed"), None
    return before, after


# --- positioned runs -------------------------------------------------------------------------------------------------


def matched_change(number: int, before: Run, after: Run) -> Change:
    kind = words.edit_kind(before.text, after.text)
    texts, spots = owned_texts(kind, before.text, after.text), focus(before, after)
    return sided(Change(f"text-{number}", kind, *texts, before.box, after.box, *spots))


def reflows(before: Sequence[Run], after: Sequence[Run]) -> bool:
    """The same tokens in all, otherwise broken into lines."""
    a, b = ([words.tokens(r.text) for r in side] for side in (before, after))
    return a != b and [t for x in a for t in x] == [t for x in b for t in x]


def pairs_of_runs(before: Sequence[Run], after: Sequence[Run]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(equal text, positional) matches: each before run in order takes the nearest of equal text, then each of those
    left takes the most similar run at its place."""
    by_text: dict[str, list[int]] = {}
    for j, r in enumerate(after):
        by_text.setdefault(r.text, []).append(j)
    exact, rest, free = [], [], [True] * len(after)
    for i, r in enumerate(before):
        same = [j for j in by_text.get(r.text, ()) if free[j]]
        if same:
            j = min(same, key=lambda j: (boxes.distance(r.box, after[j].box), j))
            free[j] = False
            exact.append((i, j))
        else:
            rest.append(i)
    placed, left = [], [j for j in range(len(after)) if free[j]]
    for i in rest:
        near = [j for j in left if free[j] and boxes.positional(before[i].box, after[j].box)]
        if near:
            j = min(near, key=lambda j: (-words.similarity(before[i].text, after[j].text), boxes.distance(before[i].box, after[j].box), j))
            free[j] = False
            placed.append((i, j))
    return exact, placed


def compare_bounded(before: Sequence[Run], after: Sequence[Run]) -> tuple[list[Change], bool, bool]:
    """(changes, more than may be listed, equal) by position in the list, for pages beyond the size limit."""
    changes, more, equal = [], False, len(before) == len(after)
    for k in range(max(len(before), len(after))):
        b, a = (side[k] if k < len(side) else None for side in (before, after))
        if b and a and b.text == a.text:
            if boxes.distance(b.box, a.box) <= limits.POSITION_TOLERANCE:
                continue
            change = Change("", "moved", b.text, a.text, b.box, a.box, b.box, a.box)
        else:
            equal = False
            if b and a:
                change = matched_change(0, b, a)
            elif b:
                change = Change("", "removed", before_text=b.text, before_box=b.box, before_focus=b.box)
            else:
                change = Change("", "added", after_text=a.text, after_box=a.box, after_focus=a.box)
        if len(changes) >= limits.MAX_CHANGES:
            more = True
        else:
            changes.append(replace(change, id=f"text-{len(changes) + 1}"))
    return changes, more, equal and not changes


def compare_runs(before: Sequence[Run], after: Sequence[Run], context: int = 3, summaries: tuple[Summary, Summary] | None = None) -> PageText:
    """Changes, page diff and review blocks of two pages' lines."""
    s = summaries or (Summary.of(before), Summary.of(after))
    grade = quality(s[0].status, s[1].status)
    if len(before) * len(after) > limits.MAX_RUN_PAIRS:
        changes, more, equal = compare_bounded(before, after)
        return PageText(equal, grade, *s, changes, more, TextDiff(truncated=True), review_blocks(before, after))
    blocks = review_blocks(before, after)
    if reflows(before, after):  # one change and an empty page diff, but blocks all the same
        texts = [words.flow([r.text for r in side]) for side in (before, after)]
        change = Change("text-1", "reflowed", *texts, *(boxes.around(r.box for r in side) for side in (before, after)))
        return PageText(False, grade, *s, [change], blocks=blocks)
    exact, placed = pairs_of_runs(before, after)
    changes: list[Change] = []
    for i, j in exact:
        if boxes.distance(before[i].box, after[j].box) > limits.POSITION_TOLERANCE:
            changes.append(Change(f"text-{len(changes) + 1}", "moved", before[i].text, after[j].text, before[i].box, after[j].box, before[i].box, after[j].box))
    for i, j in placed:
        changes.append(matched_change(len(changes) + 1, before[i], after[j]))
    used_before, used_after = ({p[k] for p in exact + placed} for k in (0, 1))
    for i, r in enumerate(before):
        if i not in used_before:
            changes.append(Change(f"text-{len(changes) + 1}", "removed", before_text=r.text, before_box=r.box, before_focus=r.box))
    for j, r in enumerate(after):
        if j not in used_after:
            changes.append(Change(f"text-{len(changes) + 1}", "added", after_text=r.text, after_box=r.box, after_focus=r.box))
    diff = text_diff([r.text for r in before], [r.text for r in after], context)
    return PageText(not changes, grade, *s, changes, False, diff, blocks)


# --- review blocks ---------------------------------------------------------------------------------------------------


@dataclass
class Paragraph:
    """Consecutive lines that belong together."""

    kind: str
    lines: list[Run]
    text: str
    box: Box


def is_list_item(run: Run) -> bool:
    return words.is_list_marker(run.text) or words.is_list_marker(" ".join(f.text for f in run.parts()[:2]))


def is_table_row(run: Run) -> bool:
    if "|" in run.text or "\t" in run.text:
        return True
    parts = run.parts()
    return sum(b.box.x - a.box.right >= limits.COLUMN_GAP for a, b in zip(parts, parts[1:], strict=False)) >= 2


def continues(last: Run, following: Run) -> bool:
    """Whether the next line goes on with the block of the last one."""
    if is_table_row(last) or is_table_row(following) or is_list_item(following):
        return False
    height = max(last.box.height, following.box.height, 1.0)
    gap = abs(following.box.cy - last.box.cy)
    if gap > max(2.25 * height, 24.0):
        return False
    if last.text.rstrip(words.SPACE_CHARS).endswith((".", "!", "?", ":", ";")) and gap > max(1.35 * height, 16.0):
        return False
    across = min(last.box.right, following.box.right) - max(last.box.x, following.box.x)
    return across > 0 or abs(last.box.x - following.box.x) <= max(2.5 * height, 18.0)


def paragraphs(runs: Sequence[Run]) -> list[Paragraph]:
    groups: list[list[Run]] = []
    for run in runs:
        if groups and continues(groups[-1][-1], run):
            groups[-1].append(run)
        else:
            groups.append([run])
    out = []
    for lines in groups:
        text = words.flow([r.text for r in lines])
        kind = "table-row" if any(map(is_table_row, lines)) else "list-item" if any(map(is_list_item, lines)) or words.is_list_marker(text) else "paragraph"
        out.append(Paragraph(kind, lines, text, boxes.around(r.box for r in lines)))
    return out


def span_kind(blocks: Sequence[Paragraph]) -> str | None:
    if not blocks:
        return None
    if any(b.kind == "table-row" or "|" in b.text for b in blocks):
        return "table-row"
    if any(b.kind == "list-item" or words.is_list_marker(b.text) for b in blocks):
        return "list-item"
    return blocks[0].kind if len({b.kind for b in blocks}) == 1 else None


def geometry_score(a: Sequence[Paragraph], b: Sequence[Paragraph]) -> float:
    p, q = boxes.around(x.box for x in a), boxes.around(x.box for x in b)
    if p is None or q is None:
        return 0.0
    if boxes.positional(p, q):
        return 1.0
    return 0.5 if boxes.distance(p, q) <= 3 * max(p.width, p.height, q.width, q.height) else 0.0


def candidate(before: Sequence[Paragraph], after: Sequence[Paragraph]) -> tuple[int, int, float] | None:
    """The best pair of one or two blocks at the head of each side."""
    found = []
    for n in range(1, min(2, len(before)) + 1):
        for m in range(1, min(2, len(after)) + 1):
            alike = words.similarity(words.flow([x.text for x in before[:n]]), words.flow([x.text for x in after[:m]]))
            place = geometry_score(before[:n], after[:m])
            if alike >= (limits.BLOCK_SIMILARITY if place else limits.BLOCK_SIMILARITY_FAR):
                found.append((min(0.75 * alike + 0.25 * place, 1.0), n, m))
    if not found:
        return None
    confidence, n, m = max(found, key=lambda x: (x[0], -(x[1] + x[2])))
    return n, m, confidence


def aligned(before: Sequence[Paragraph], after: Sequence[Paragraph]) -> list[tuple[Sequence[Paragraph], Sequence[Paragraph], float]]:
    """Spans that correspond: equal texts in common order first, the best candidates in the gaps between."""
    anchors: list[tuple[int, int]] = []
    if not words.too_large(len(before), len(after), limits.MAX_ANCHOR_CELLS):
        anchors = [(i, j) for op, i, j in words.walk([x.text for x in before], [x.text for x in after]) if op == "="]
    out, i, j = [], 0, 0
    for to_i, to_j in [*anchors, (len(before), len(after))]:
        while i < to_i or j < to_j:
            if i == to_i or j == to_j:  # one side is left: a single span
                out.append((before[i:to_i], after[j:to_j], 1.0))
                i, j = to_i, to_j
            elif best := candidate(before[i:to_i], after[j:to_j]):
                n, m, confidence = best
                out.append((before[i : i + n], after[j : j + m], confidence))
                i, j = i + n, j + m
            else:
                out.append((before[i : i + 1], (), 1.0))
                i += 1
        if to_i < len(before) and to_j < len(after):
            out.append((before[to_i : to_i + 1], after[to_j : to_j + 1], 1.0))
            i, j = to_i + 1, to_j + 1
    return out


def classified(before: Sequence[Paragraph], after: Sequence[Paragraph], confidence: float) -> Block | None:
    """The review block of a pair of spans; None if nothing changed."""
    old, new = ([r for p in side for r in p.lines] for side in (before, after))
    if not old and not new:
        return None
    texts = tuple(words.flow([r.text for r in side]) for side in (old, new))
    kinds, places = (span_kind(before), span_kind(after)), tuple(boxes.around(r.box for r in side) for side in (old, new))
    if any("|" in t for t in texts):
        structure = "table-row"
    elif any(map(words.is_list_marker, texts)):
        structure = "list-item"
    else:
        structure = kinds[0] if kinds[0] == kinds[1] and kinds[0] else "paragraph"
    if not old or not new:
        kind = "removed" if old else "added"
    elif reflows(old, new):
        kind = "reflowed"
    elif texts[0] == texts[1]:
        if boxes.distance(*places) <= limits.POSITION_TOLERANCE and kinds[0] == kinds[1]:
            return None
        kind = "moved"
    else:
        kind = words.edit_kind(*texts)
    spots = focus(old[0], new[0]) if len(old) == len(new) == 1 else places
    owned = owned_texts(kind, *texts)
    diff = TextDiff() if kind in ("moved", "reflowed") else text_diff([r.text for r in old], [r.text for r in new], 0)
    roles = tuple(None if t is None else "body" for t in owned)
    return sided(Block("", kind, *owned, *places, *spots, structure, confidence, *roles, diff))


def review_blocks(before: Sequence[Run], after: Sequence[Run]) -> list[Block]:
    found = (classified(*pair) for pair in aligned(paragraphs(before), paragraphs(after)))
    return [replace(b, id=f"block-{k}") for k, b in enumerate((b for b in found if b), 1)]
