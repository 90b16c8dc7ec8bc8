"""Options with eager checks, and errors with wire codes."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from . import limits
from .functions.words import SPACES, short_error
from .operators.raster import Options as RasterOptions


class ComparisonError(ValueError):
    """An error with a code for sinks that write ``{"error": {"code", "message"}}``."""

    def __init__(self, code: str, message: str):
        super().__init__(short_error(message))
        self.code = code

    def record(self) -> dict:
        return {"error": {"code": self.code, "message": str(self)}}


@dataclass(frozen=True)
class Limits:
    """None: no limit. Zero is an error."""

    input_bytes: int | None = 256 * 1024 * 1024
    pages: int | None = 1000
    page_pixels: int | None = 25_000_000


@dataclass(frozen=True)
class Options:
    mode: str = "visual"
    render: str = "full"
    page_matching: str = "index"
    reading_order: str = "auto"
    dpi: float = 144.0
    context_lines: int = 3
    raster: RasterOptions = field(default_factory=RasterOptions)
    limits: Limits = field(default_factory=Limits)

    def __post_init__(self) -> None:
        def need(ok: bool, what: str) -> None:
            if not ok:
                raise ComparisonError("invalid-options", what)

        need(math.isfinite(self.dpi) and self.dpi > 0, "dpi must be finite and above 0")
        need(self.mode in ("visual", "semantic"), "mode is visual or semantic")
        need(self.render in ("full", "none"), "render is full or none")
        need(self.render == "full" or self.mode == "semantic", "render none needs semantic mode")
        need(self.page_matching in ("index", "sequence"), "page_matching is index or sequence")
        need(self.reading_order in ("auto", "rows", "columns"), "reading_order is auto, rows or columns")
        need(0 <= self.context_lines <= limits.MAX_CONTEXT_LINES, f"context_lines is at most {limits.MAX_CONTEXT_LINES}")
        need(0 <= self.raster.max_shift <= 64, "max_shift is at most 64")
        need(self.raster.sample_step >= 1, "sample_step is at least 1")
        need(all(x is None or x > 0 for x in (self.limits.input_bytes, self.limits.pages, self.limits.page_pixels)), "a limit of zero")


def pixels_of(width: float, height: float, options: Options) -> tuple[int, int]:
    """A page's raster size, within the limit."""
    size = tuple(max(round(x * options.dpi / 72), 1) for x in (width, height))
    if options.limits.page_pixels is not None and size[0] * size[1] > options.limits.page_pixels:
        raise ComparisonError("page-pixels-exceeded", f"{size[0]} x {size[1]} pixels")
    return size


def set_edges(ids: Sequence[str], strategy: str = "baseline") -> list[tuple[int, int]]:
    """Edges of an ordered set of 2 to 64 revisions with distinct ids that aren't blank."""
    if not 2 <= len(ids) <= 64:
        raise ComparisonError("invalid-options", "a set has 2 to 64 revisions")
    if any(not SPACES.sub("", str(i)) for i in ids) or len(set(ids)) < len(ids):
        raise ComparisonError("invalid-options", "revision ids must be distinct and not blank")
    if strategy not in ("baseline", "adjacent"):
        raise ComparisonError("invalid-options", "strategy is baseline or adjacent")
    return [(0 if strategy == "baseline" else k - 1, k) for k in range(1, len(ids))]


def resolve_password(side: str | None, shared: str | None) -> str | None:
    """The side's own password wins over the shared one."""
    return side if side is not None else shared


def exit_code(equal: bool | None, failed: str | None = None, exit_on_difference: bool = True) -> int:
    """0 equal, 1 different, 2 error, 130 cancelled."""
    if failed:
        return 130 if failed == "cancelled" else 2
    return 0 if equal or not exit_on_difference else 1
