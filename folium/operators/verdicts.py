"""Page statuses and warnings."""

from __future__ import annotations

from collections.abc import Sequence

from .. import limits
from .figures import FigureDiff
from .matching import PageText
from .pages import Pair

QUALITY_WARNINGS = {"empty": "text-unavailable", "partial": "text-partial", "suspect": "text-suspect"}


def status(pair: Pair, same_geometry: bool, visual_equal: bool | None, text_equal: bool | None, figures: Sequence[FigureDiff] = ()) -> str:
    """None: that evidence wasn't computed and says nothing."""
    if pair.moved:
        return "moved"
    if pair.after is None:
        return "deleted"
    if pair.before is None:
        return "inserted"
    same = same_geometry and visual_equal is not False and text_equal is not False and not figures
    return "equal" if same else "modified"


def warnings(pair: Pair, same_geometry: bool, confidence: float, visual_equal: bool | None, text: PageText | None, figures: Sequence[FigureDiff] = ()) -> list[str]:
    """In their fixed order; visual evidence that wasn't computed is noted last."""
    both = None not in (pair.before, pair.after)
    out = []
    if both and not same_geometry:
        out.append("page-geometry-changed")
    if both and confidence < limits.LOW_CONFIDENCE:
        sure = any(f.status in ("moved", "swapped") and f.confidence >= 0.9 for f in figures)
        out.append("content-reordered" if sure else "low-alignment-confidence")
    if text is not None:
        if visual_equal and not text.equal:
            out.append("semantic-visual-disagreement")
        if text.quality in QUALITY_WARNINGS:
            out.append(QUALITY_WARNINGS[text.quality])
        if text.diff.truncated:
            out.append("text-diff-truncated")
        if text.truncated:
            out.append("text-changes-truncated")
    return out if visual_equal is not None else [*out, "visual-not-computed"]
