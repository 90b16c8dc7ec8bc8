"""Headers and footers: edge-band text that repeats over pages."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Sequence
from dataclasses import replace

from .. import limits
from ..functions import boxes, words
from .matching import Block
from .reading import Run

Evidence = dict[tuple[str, str], set[int]]


def evidence(pages: Iterable[tuple[int, Sequence[Run], float]]) -> Evidence:
    """Pages on which each (role, key) stands in the band; from (page, lines, page height)."""
    out: Evidence = defaultdict(set)
    for page, runs, height in pages:
        for r in runs:
            role = boxes.edge_role(r.box, height)
            key = words.role_key(r.text) if role else ""
            if role and len(key) <= limits.ROLE_LENGTH and sum(map(str.isalnum, key)) >= 4:
                out[role, key].add(page)
    return out


def repeated(text: str, role: str, known: Evidence) -> bool:
    own = words.role_key(text)
    return bool(own) and any(r == role and len(pages) >= 2 and f" {key} " in f" {own} " for (r, key), pages in known.items())


def annotated(block: Block, heights: tuple[float | None, float | None], known: tuple[Evidence, Evidence]) -> Block:
    """The block with its sides' roles; a header or footer carries over to the other side within the same band."""
    texts, places = (block.before_text, block.after_text), (block.before_box, block.after_box)
    bands = [boxes.edge_role(b, h) if b is not None and h is not None else None for b, h in zip(places, heights, strict=True)]
    found = [None if t is None else band if band and repeated(t, band, k) else "body" for t, band, k in zip(texts, bands, known, strict=True)]
    for a, b in ((0, 1), (1, 0)):
        if found[a] in ("header", "footer") and found[b] == "body" and bands[b] == found[a]:
            found[b] = found[a]
    return replace(block, before_role=found[0], after_role=found[1])
