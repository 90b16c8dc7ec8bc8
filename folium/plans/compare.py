"""Comparing revisions: one Arrow function per edge, flat relations from its nested result.

A revision is one value, within the limit of pages, in one of three forms: page structs (PAGES_IN: size, runs, figures,
replaced characters, a raster if there is one), run structs of pages of one size, or a plain text, whose lines are set
eight a page. ``compared`` takes edges with both revisions and gives one row per page pair; ``text_changes``,
``text_blocks``, ``diff_lines``, ``review_stream``, ``review_rows``, ``regions`` and ``documents`` are selections of it.

An edge that cannot be compared (too many pages or pixels) gives one row with an error code, and no other edge fails
for it. A null revision has no pages; two revisions without pages give one row without a page pair, and are equal.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import words
from ..functions.boxes import Box
from ..operators import figures as fig
from ..operators import pages as pg
from ..operators import raster, review, roles, verdicts
from ..operators.matching import Block, PageText, Summary, compare_runs
from ..operators.reading import Fragment, Run, normalize
from ..operators.textdiff import TextDiff
from ..options import ComparisonError, Options, pixels_of

BOX = "struct<x:double,y:double,width:double,height:double>"
LINE = "struct<kind:string,before_line:int,after_line:int,text:string,marked:string>"
HUNKS = f"array<struct<before_start:int,after_start:int,lines:array<{LINE}>>>"
SIDES = f"before_text:string,after_text:string,before_bounds:{BOX},after_bounds:{BOX},before_focus_bounds:{BOX},after_focus_bounds:{BOX}"
CHANGE = f"struct<id:string,kind:string,{SIDES}>"
BLOCK = f"struct<id:string,kind:string,{SIDES},structure:string,confidence:double,before_role:string,after_role:string,changed_lines:int,truncated:boolean,hunks:{HUNKS}>"
REGION = "struct<id:string,x:int,y:int,width:int,height:int,changed_pixels:long,before_content_pixels:long,after_content_pixels:long>"
REVIEW = f"struct<id:string,kind:string,type:string,label:string,before_bounds:{BOX},after_bounds:{BOX},operation:string,members:array<string>,hunks:array<string>>"
FIGURE = f"struct<id:string,status:string,before_bounds:{BOX},after_bounds:{BOX},confidence:double>"
PAGE = (
    "pair_index:int,before_page:int,after_page:int,moved:boolean,status:string,quality:string,equal:boolean,before_chars:long,after_chars:long,"
    f"changes:array<{CHANGE}>,changes_truncated:boolean,changed_lines:int,diff_truncated:boolean,hunks:{HUNKS},blocks:array<{BLOCK}>,"
    f"changed_pixels:long,changed_ratio:double,dx:int,dy:int,confidence:double,regions:array<{REGION}>,figures:array<{FIGURE}>,warnings:array<string>,"
    f"before_width:double,before_height:double,after_width:double,after_height:double,before_pages:int,after_pages:int,review:array<{REVIEW}>"
)
RESULT = f"struct<error:string,message:string,pages:array<struct<{PAGE}>>>"
RUN = f"struct<page_index:int,text:string,bounds:{BOX},fragments:array<struct<text:string,bounds:{BOX}>>>"
PAGES_IN = (
    f"array<struct<page_index:int,width:double,height:double,replaced:int,runs:array<struct<text:string,bounds:{BOX},fragments:array<struct<text:string,bounds:{BOX}>>>>,"
    f"figures:array<struct<bounds:{BOX},content_hash:string>>,raster:struct<width:int,height:int,rgba:binary>>>"
)
#: How plain texts are set (see sources.bindings): lines a page, and the page's size.
LINES, SIZE = 8, (612.0, 152.0)


@dataclass
class Page:
    width: float
    height: float
    runs: list[Run] = field(default_factory=list)
    image: np.ndarray | None = None
    figures: list[fig.Figure] = field(default_factory=list)
    replaced: int = 0
    lines: list[Run] | None = None

    def text(self, order: str) -> list[Run]:
        if self.lines is None:
            self.lines = normalize(self.runs, order)
        return self.lines


def pairing(before: Sequence[Page], after: Sequence[Page], o: Options, identical: bool) -> list[pg.Pair]:
    if o.page_matching == "index" or identical:
        return pg.by_index(len(before), len(after))
    image = lambda p: character_raster([r.text for r in p.runs]) if p.image is None else p.image
    return pg.by_sequence(*([raster.fingerprint(image(p)) for p in side] for side in (before, after)))


def within_limits(before: Sequence[Page], after: Sequence[Page], o: Options) -> None:
    for side in (before, after):
        if o.limits.pages is not None and len(side) > o.limits.pages:
            raise ComparisonError("page-limit-exceeded", f"{len(side)} pages")
        if o.render == "full":
            for p in side:
                pixels_of(p.width, p.height, o)


def compare(before: Sequence[Page], after: Sequence[Page], o: Options, identical: bool = False) -> list[dict]:
    """One record per page pair. Where a page has no raster, visual evidence says nothing and figures still count."""
    within_limits(before, after, o)
    semantic = o.mode == "semantic"
    known = tuple(roles.evidence((k, p.text(o.reading_order), p.height) for k, p in enumerate(side)) for side in (before, after)) if semantic else ({}, {})
    out = []
    for k, pair in enumerate(pairing(before, after, o, identical)):
        old = before[pair.before] if pair.before is not None else None
        new = after[pair.after] if pair.after is not None else None
        same = bool(old and new and (old.width, old.height) == (new.width, new.height))
        text = page_text(old, new, o) if semantic else None
        if text:
            heights = tuple(p.height if p else None for p in (old, new))
            text.blocks = [roles.annotated(b, heights, known) for b in text.blocks]
        seen, found = None, []
        if o.render == "full":
            if all(p is None or p.image is not None for p in (old, new)):
                seen = visual(old, new, o.raster)
            if old and new and not (seen and seen.equal):
                found = fig.compare(old.figures, new.figures)
        verdict = verdicts.status(pair, same, seen and seen.equal, text and text.equal, found)
        notes = verdicts.warnings(pair, same, seen.alignment.confidence if seen else 1.0, seen and seen.equal, text, found)
        row = record(k, pair, verdict, text, seen, found, notes) | {"before_pages": len(before), "after_pages": len(after)}
        row |= {f"{side}_{name}": float(getattr(p, name)) for side, p in (("before", old), ("after", new)) if p for name in ("width", "height")}
        page, render = new or old, (seen.width, seen.height) if seen else (1, 1)
        shown = review.review(verdict, text.changes if text else [], found, seen.regions if seen else [], (page.width, page.height), render)
        out.append(row | {"review": [_review(r, text) for r in shown]})
    return out


def page_text(old: Page | None, new: Page | None, o: Options) -> PageText:
    """The semantic comparison of a page pair; replaced characters make the extraction suspect."""
    lines = [p.text(o.reading_order) if p else [] for p in (old, new)]
    summaries = tuple(Summary.of(x, p.replaced if p else 0) for x, p in zip(lines, (old, new), strict=True))
    return compare_runs(*lines, o.context_lines, summaries)


def visual(old: Page | None, new: Page | None, o: raster.Options) -> raster.RasterDiff:
    """A missing side is a white image of the other's size, without a search for a shift."""
    white = lambda p: np.full_like(p.image, 255)
    if old is None or new is None:
        o = raster.Options(o.channel_tolerance, o.changed_pixel_ratio, 0, o.sample_step, o.min_region_area)
    return raster.compare(old.image if old else white(new), new.image if new else white(old), o)


def is_equal(before: Sequence[Page], after: Sequence[Page], o: Options) -> bool:
    """Stops at the first pair that is one-sided, moved, of another size, or unequal; figures are not looked at."""
    within_limits(before, after, o)
    for pair in pairing(before, after, o, False):
        if pair.moved or None in (pair.before, pair.after):
            return False
        old, new = before[pair.before], after[pair.after]
        if (old.width, old.height) != (new.width, new.height):
            return False
        seen = o.render == "full" and old.image is not None and new.image is not None
        if seen and not visual(old, new, o.raster).equal:
            return False
        if o.mode == "semantic" and not compare_runs(old.text(o.reading_order), new.text(o.reading_order), o.context_lines).equal:
            return False
    return True


# --- records -----------------------------------------------------------------------------------------------------------


def _box(b: Box | None) -> dict | None:
    return None if b is None else dict(zip(("x", "y", "width", "height"), map(float, b), strict=True))


def _hunks(d: TextDiff) -> list[dict]:
    line = lambda x: {"kind": x.kind, "before_line": x.before_line, "after_line": x.after_line, "text": x.text, "marked": words.marked_line(x.text, x.spans)}
    return [{"before_start": h.before_start, "after_start": h.after_start, "lines": [line(x) for x in h.lines]} for h in d.hunks]


def _change(c) -> dict:
    return {
        "id": c.id, "kind": c.kind, "before_text": c.before_text, "after_text": c.after_text, "before_bounds": _box(c.before_box),
        "after_bounds": _box(c.after_box), "before_focus_bounds": _box(c.before_focus), "after_focus_bounds": _box(c.after_focus),
    }


def _block(b: Block) -> dict:
    own = {"structure": b.structure, "confidence": b.confidence, "before_role": b.before_role, "after_role": b.after_role}
    return _change(b) | own | {"changed_lines": b.diff.changed_lines, "truncated": b.diff.truncated, "hunks": _hunks(b.diff)}


def _review(r: review.ReviewChange, text: PageText | None) -> dict:
    hunks = [review.hunk_header(h) for h in review.hunks_for(r.members, text.diff.hunks)] if text and r.members else []
    return {
        "id": r.id, "kind": r.kind, "type": r.type, "label": r.label, "before_bounds": _box(r.before), "after_bounds": _box(r.after),
        "operation": r.operation or r.id, "members": [m.id for m in r.members], "hunks": hunks,
    }


def record(k: int, pair: pg.Pair, status: str, text: PageText | None, seen: raster.RasterDiff | None, figures: list, warnings: list[str]) -> dict:
    region = lambda r: {"id": r.id, "x": r.x, "y": r.y, "width": r.width, "height": r.height, "changed_pixels": r.changed, "before_content_pixels": r.before_content, "after_content_pixels": r.after_content}
    figure = lambda f: {"id": f.id, "status": f.status, "before_bounds": _box(f.before), "after_bounds": _box(f.after), "confidence": f.confidence}
    out = {"pair_index": k, "before_page": pair.before, "after_page": pair.after, "moved": pair.moved, "status": status, "warnings": warnings}
    out |= {"figures": [figure(f) for f in figures], "changed_pixels": 0, "changed_ratio": 0.0, "dx": 0, "dy": 0, "confidence": 1.0, "regions": []}
    if seen:
        out |= {"changed_pixels": seen.changed, "changed_ratio": seen.ratio, "dx": seen.alignment.dx, "dy": seen.alignment.dy, "confidence": seen.alignment.confidence, "regions": [region(r) for r in seen.regions]}
    if text:
        out |= {
            "quality": text.quality, "equal": text.equal, "before_chars": text.before.characters, "after_chars": text.after.characters,
            "changes": [_change(c) for c in text.changes], "changes_truncated": text.truncated, "changed_lines": text.diff.changed_lines,
            "diff_truncated": text.diff.truncated, "hunks": _hunks(text.diff), "blocks": [_block(b) for b in text.blocks],
        }
    return out


# --- DataFrames --------------------------------------------------------------------------------------------------------


def _arrow(ddl: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_type(_parse_datatype_string(ddl))


def page_runs(runs: Sequence[dict] | None) -> dict[int, list[Run]]:
    """Run structs by page, in their order."""
    box = lambda b: Box(b["x"], b["y"], b["width"], b["height"])
    out: dict[int, list[Run]] = {}
    for r in runs or ():
        parts = tuple(Fragment(f["text"], box(f["bounds"])) for f in r.get("fragments") or ())
        out.setdefault(r["page_index"], []).append(Run(r["text"], box(r["bounds"]), parts))
    return out


def revision(value: str | Sequence[dict] | None, size: tuple[float, float] = SIZE, image: bool = False) -> list[Page]:
    """The pages of a plain text, of run structs or of page structs.

    Pages of the first two have one size and, with ``image``, their character raster; page structs have their own.
    """
    if value and not isinstance(value, str) and "runs" in value[0]:
        return [page_of(p) for p in sorted(value, key=lambda p: p["page_index"])]
    if isinstance(value, str):
        by: dict[int, list[Run]] = {}
        for k, t in enumerate(value.split("\n")):
            by.setdefault(k // LINES, []).append(Run(t, Box(72.0, 10.0 + 16 * (k % LINES), 6.0 * len(t), 12.0)))
    else:
        by = page_runs(value)
    out = []
    for k in range(max(by, default=-1) + 1):
        p = Page(*size, by.get(k, []))
        p.replaced = sum(r.text.count("�") for r in p.runs)
        if image:
            p.image = character_raster([r.text for r in p.runs])
        out.append(p)
    return out


def page_of(p: dict) -> Page:
    """A page struct of PAGES_IN; its optional parts may be null or missing."""
    box = lambda b: Box(b["x"], b["y"], b["width"], b["height"])
    runs = [r | {"page_index": 0} for r in p["runs"] or ()]
    figures = [fig.Figure(box(f["bounds"]), f["content_hash"]) for f in p.get("figures") or ()]
    out = Page(p["width"], p["height"], page_runs(runs).get(0, []), None, figures, p.get("replaced") or 0)
    if r := p.get("raster"):
        out.image = np.frombuffer(r["rgba"], np.uint8).reshape(r["height"], r["width"], 4)
    return out


def character_raster(lines: Sequence[str], rows: int = LINES) -> np.ndarray:
    """A page's characters as grey pixels, at least 64 a row; white where there is none."""
    wide = max([64, *map(len, lines)])
    grey = np.full((max(rows, len(lines)), wide), 255, np.uint8)
    for y, line in enumerate(lines):
        points = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
        blank = np.array([c.isspace() for c in line], bool)
        grey[y, : len(points)] = np.where(blank, 255, points % 200)
    out = np.repeat(grey[:, :, None], 4, 2)
    out[:, :, 3] = 255
    return out


def runs_of(text: str | Column) -> Column:
    """A document's lines as run structs, eight a page."""
    c = F.col(text) if isinstance(text, str) else text
    box = lambda t, k: F.struct(F.lit(72.0).alias("x"), (10 + 16 * (k % 8)).cast("double").alias("y"), (6 * F.length(t)).cast("double").alias("width"), F.lit(12.0).alias("height"))
    return F.transform(F.split(c, "\n"), lambda t, k: F.struct(F.floor(k / 8).cast("int").alias("page_index"), t.alias("text"), box(t, k).alias("bounds")))


def spread(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edges dealt evenly: comparing costs far more than moving them, and few bytes would else end up in few tasks."""
    return edges.repartition(4 * int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def compared(edges: DataFrame, keys: Sequence[str], options: Options, size: tuple[float, float] = SIZE) -> DataFrame:
    """One row per page pair of every edge, or one with an error; edges carry ``keys`` and revisions ``before``, ``after``."""

    kind = _arrow(RESULT)

    def run(before: pa.Array, after: pa.Array) -> pa.Array:
        rows = []
        for a, b in zip(before, after, strict=True):
            sides = [revision(x.as_py(), size, options.render == "full") for x in (a, b)]
            try:
                rows.append({"pages": compare(*sides, options, identical=a == b)})
            except ComparisonError as e:
                rows.append({"error": e.code, "message": str(e)})
        return pa.array(rows, kind)

    r = spread(edges, keys).select(*keys, F.arrow_udf(run, RESULT)("before", "after").alias("r"))
    return r.select(*keys, F.col("r.error").alias("error"), F.col("r.message").alias("message"), F.explode_outer("r.pages").alias("p")).select(*keys, "p.*", "error", "message")


def equal_edges(edges: DataFrame, keys: Sequence[str], options: Options, size: tuple[float, float] = SIZE) -> DataFrame:
    """The fast path: one verdict per edge, null with an error code where there is none."""

    def run(before: pa.Array, after: pa.Array) -> pa.Array:
        rows = []
        for pair in zip(before, after, strict=True):
            try:
                rows.append({"equal": is_equal(*(revision(x.as_py(), size, options.render == "full") for x in pair), options)})
            except ComparisonError as e:
                rows.append({"error": e.code})
        return pa.array(rows, pa.struct([("equal", pa.bool_()), ("error", pa.string())]))

    return spread(edges, keys).select(*keys, F.arrow_udf(run, "struct<equal:boolean,error:string>")("before", "after").alias("r")).select(*keys, "r.*")


def text_changes(pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    return pages.select(*keys, "pair_index", F.posexplode("changes").alias("change_ordinal", "c")).select(*keys, "pair_index", "change_ordinal", "c.*")


def listed_changes(pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The changes that the inspector lists: the first of each page."""
    return text_changes(pages, keys).filter(F.col("change_ordinal") < review.MOST_LISTED)


def text_blocks(pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    return pages.select(*keys, "pair_index", "before_page", "after_page", F.posexplode("blocks").alias("block_ordinal", "b")).select(*keys, "pair_index", "before_page", "after_page", "block_ordinal", "b.*")


def diff_lines(pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    h = pages.select(*keys, "pair_index", F.posexplode("hunks").alias("hunk_ordinal", "h"))
    return h.select(*keys, "pair_index", "hunk_ordinal", F.posexplode("h.lines").alias("line_ordinal", "l")).select(*keys, "pair_index", "hunk_ordinal", "line_ordinal", "l.*")


def regions(pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    return pages.select(*keys, "pair_index", F.posexplode("regions").alias("region_index", "r")).select(*keys, "pair_index", "region_index", "r.*")


def review_stream(pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Blocks of pages that aren't equal, with ids and sides."""
    from ..functions import columns as C

    rows = text_blocks(pages.filter("status <> 'equal'"), keys).withColumnRenamed("id", "block_id")
    ident = F.concat(F.lit("page-"), "pair_index", F.lit("-"), "block_id")
    return rows.withColumn("id", ident).withColumn("side", C.review_side(F.col("kind")))


def review_rows(pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What a reviewer sees of each page: groups of text changes, figures, clusters of regions, or the page itself."""
    return pages.select(*keys, "pair_index", F.posexplode("review").alias("review_ordinal", "r")).select(*keys, "pair_index", "review_ordinal", "r.*")


def warning_set(pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The distinct warnings of every edge's pages."""
    return pages.select(*keys, F.explode("warnings").alias("warning")).distinct()


def documents(pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Verdict and totals of every edge (agg_document_equal, agg_document_text_diff, agg_viewer_totals); no verdict with an error."""
    differs = F.col("status") != "equal"
    return pages.groupBy(*keys).agg(
        F.when(F.max("error").isNull(), F.coalesce(F.every(~differs), F.lit(True))).alias("equal"), F.max("error").alias("error"),
        F.coalesce(F.max("before_pages"), F.lit(0)).alias("before_pages"), F.coalesce(F.max("after_pages"), F.lit(0)).alias("after_pages"), F.count_if(differs).alias("changed_pages"), F.coalesce(F.sum("changed_pixels"), F.lit(0)).alias("changed_pixels"),
        F.coalesce(F.sum(F.when(differs, F.col("changed_lines"))), F.lit(0)).alias("changed_lines"),
        F.coalesce(F.bool_or(differs & F.col("diff_truncated")), F.lit(False)).alias("truncated"),
        F.count_if(F.size("changes") > 0).alias("text_pages"), F.sum(F.greatest(F.size("hunks"), F.lit(0))).alias("hunks"),
    )
