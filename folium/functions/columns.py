"""The scalar functions and predicates as Spark columns: whole-stage code, no Python per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import limits
from .words import SPACE_CLASS

SPACE = f"[{SPACE_CLASS}]"
TOKEN = rf"[\p{{IsAlphabetic}}\p{{N}}_]+|[^{SPACE_CLASS}]"
MARKER = rf"^{SPACE}*(?:[-*•–—](?:{SPACE}|$)|(?:[0-9]+|[A-Za-z])[.)]{SPACE})"
NUMBER = "\u0002"


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def variant_key(text: Column) -> Column:
    return F.lower(squeezed(text))


def role_key(text: Column) -> Column:
    """Digit runs as #; the spaces before the numbers of a row of numbers move behind the row."""
    t = F.regexp_replace(squeezed(text), "[0-9]+", NUMBER)
    row = F.regexp_replace(F.regexp_replace(t, f"((?: *{NUMBER})* +{NUMBER}(?: *{NUMBER})*)", "$1 "), f" +{NUMBER}", NUMBER)
    t = F.when(F.contains(t, F.lit(f" {NUMBER}")), row).otherwise(t)  # most lines have no number behind a space
    return F.lower(F.trim(F.regexp_replace(F.replace(t, F.lit(NUMBER), F.lit("#")), " +", " ")))


def separator(left: Column, right: Column) -> Column:
    """What stands between two texts that aren't empty."""
    bound = F.substring(right, 1, 1).isin(*".,;:!?%)]}") | F.right(left, F.lit(1)).isin(*"([{")
    return F.when((left == "") | bound, "").otherwise(" ")


def joined(left: Column, right: Column) -> Column:
    return F.when(left == "", right).when(right == "", left).otherwise(F.concat(left, separator(left, right), right))


def flow(lines: Column) -> Column:
    """All lines joined: each line that isn't empty with what separates it from the one before, put together once."""
    some = F.filter(lines, lambda x: x != "")
    before = F.concat(F.array(F.lit("")), F.slice(some, F.lit(1), F.greatest(F.size(some) - 1, F.lit(0))))
    return F.array_join(F.zip_with(F.slice(before, F.lit(1), F.size(some)), some, lambda p, x: F.concat(separator(p, x), x)), "")


def is_list_marker(text: Column) -> Column:
    return text.rlike(MARKER)


def is_table_row(text: Column) -> Column:
    return F.contains(text, F.lit("|")) | F.contains(text, F.lit("\t"))


def short_error(text: Column) -> Column:
    return F.when(F.length(text) > 256, F.concat(F.substring(text, 1, 256), F.lit("..."))).otherwise(text)


def marked(text: Column, opening: str, closing: str) -> Column:
    """The marks around the part without outer white space; blank texts stay."""
    core = rf"(?s)^({SPACE}*)(.*?)({SPACE}*)\z"
    return F.when(squeezed(text) == "", text).otherwise(F.regexp_replace(text, core, f"$1{opening}$2{closing}$3"))


def reflows(before: Column, after: Column) -> Column:
    """Lines of equal tokens in all, otherwise broken; both are arrays of lines."""
    a, b = F.transform(before, tokens), F.transform(after, tokens)
    return (F.flatten(a) == F.flatten(b)) & (a != b)


def is_subsequence(source: Column, target: Column) -> Column:
    """Walk the target once; the accumulator counts the source's items met so far."""
    met = F.aggregate(target, F.lit(0), lambda n, x: n + F.when(F.try_element_at(source, n + 1) == x, 1).otherwise(0))
    return met == F.size(source)


# --- rectangles: structs of x, y, width, height ------------------------------------------------------------------------


def box(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(*[c.cast("double").alias(n) for c, n in zip((x, y, width, height), ("x", "y", "width", "height"), strict=True)])


def _right(b: Column) -> Column:
    return b.x + b.width


def _bottom(b: Column) -> Column:
    return b.y + b.height


def overlap(a: Column, b: Column) -> Column:
    zero = F.lit(0.0)
    return F.greatest(F.least(_right(a), _right(b)) - F.greatest(a.x, b.x), zero) * F.greatest(F.least(_bottom(a), _bottom(b)) - F.greatest(a.y, b.y), zero)


def area(a: Column) -> Column:
    return a.width * a.height


def distance(a: Column, b: Column) -> Column:
    dx, dy = (a.x + a.width / 2) - (b.x + b.width / 2), (a.y + a.height / 2) - (b.y + b.height / 2)
    return F.sqrt(dx * dx + dy * dy)


def overlap_share(a: Column, b: Column) -> Column:
    least = F.least(area(a), area(b))
    return F.when(least > 0, overlap(a, b) / least).otherwise(0.0)


def dimension_similarity(a: Column, b: Column) -> Column:
    return F.when(F.greatest(a, b) > 0, F.least(a, b) / F.greatest(a, b)).otherwise(1.0)


def line_distance(a: Column, b: Column) -> Column:
    return F.abs((a.y + a.height / 2) - (b.y + b.height / 2))


def block_geometry(a: Column, b: Column) -> Column:
    """1 where two boxes match by position, a half where they are near, else 0."""
    return F.when(positional(a, b), 1.0).when(distance(a, b) <= 3 * F.greatest(a.width, a.height, b.width, b.height), 0.5).otherwise(0.0)


def positional(a: Column, b: Column) -> Column:
    shared = overlap(a, b)
    return F.when(shared > 0, shared / (area(a) + area(b) - shared) >= 0.12).otherwise(distance(a, b) <= 1.5 * F.greatest(a.width, a.height, b.width, b.height))


def same_line(a: Column, b: Column) -> Column:
    least = F.greatest(F.least(a.height, b.height), F.lit(1.0))
    shared = F.greatest(F.least(_bottom(a), _bottom(b)) - F.greatest(a.y, b.y), F.lit(0.0))
    level = (shared / least >= 0.35) | (F.abs((a.y + a.height / 2) - (b.y + b.height / 2)) <= 0.7 * least)
    return level & (F.greatest(a.x - _right(b), b.x - _right(a), F.lit(0.0)) <= F.greatest(8 * least, F.lit(32.0)))


def close(a: Column, b: Column) -> Column:
    out = F.lit(True)
    for n in ("x", "y", "width", "height"):
        out = out & (F.abs(a[n] - b[n]) <= limits.POSITION_TOLERANCE)
    return out


def edge_role(b: Column, page_height: Column) -> Column:
    band = F.least(F.greatest(page_height * limits.ROLE_BAND, F.lit(limits.ROLE_LEAST_BAND)), page_height * limits.ROLE_MOST_BAND)
    top, bottom = b.y <= band, _bottom(b) >= page_height - band
    real = (page_height > 0) & (b.height > 0)
    return F.when(real & top & ~bottom, "header").when(real & bottom & ~top, "footer")


def slot_score(a: Column, b: Column) -> Column:
    share, apart = overlap_share(a, b), distance(a, b)
    small, large = F.least(area(a), area(b)), F.greatest(area(a), area(b))
    score = 0.65 * share + 0.2 * small / large + 0.15 * F.greatest(F.lit(0.0), 1 - apart / 64)
    return F.when((small > 0) & ((share >= 0.2) | (apart <= 64)) & (score >= 0.3), score)


def scaled(b: Column, render: tuple[float, float], page: tuple[float, float]) -> Column:
    sx, sy = page[0] / max(render[0], 1), page[1] / max(render[1], 1)
    clip = lambda c, low, high: F.least(F.greatest(c, low), F.lit(float(high)))
    x, y = clip(b.x * sx, F.lit(0.0), page[0]), clip(b.y * sy, F.lit(0.0), page[1])
    return box(x, y, clip(_right(b) * sx, x, page[0]) - x, clip(_bottom(b) * sy, y, page[1]) - y)


def focus_crop(b: Column, page: tuple[float, float]) -> Column:
    pad = F.least(F.greatest(0.08 * F.greatest(b.width, b.height), F.lit(32.0)), F.lit(96.0))
    x, y = F.greatest(b.x - pad, F.lit(0.0)), F.greatest(b.y - pad, F.lit(0.0))
    return box(x, y, F.least(_right(b) + pad, F.lit(float(page[0]))) - x, F.least(_bottom(b) + pad, F.lit(float(page[1]))) - y)


def bounds_key(b: Column) -> Column:
    return F.concat_ws(":", *[F.format_string("%.2f", b[n]) for n in ("x", "y", "width", "height")])


def page_pixels(points: Column, dpi: float) -> Column:
    return F.greatest(F.round(points * dpi / 72), F.lit(1)).cast("long")


def continues(last_text: Column, last: Column, text: Column, b: Column) -> Column:
    """Whether a line goes on with the block of the line before it."""
    height = F.greatest(last.height, b.height, F.lit(1.0))
    gap = F.abs((b.y + b.height / 2) - (last.y + last.height / 2))
    ends = last_text.rlike(rf"[.!?:;]{SPACE}*\z")
    across = F.least(_right(last), _right(b)) - F.greatest(last.x, b.x)
    return (
        ~is_table_row(last_text) & ~is_table_row(text) & ~is_list_marker(text)
        & (gap <= F.greatest(2.25 * height, F.lit(24.0))) & (~ends | (gap <= F.greatest(1.35 * height, F.lit(16.0))))
        & ((across > 0) | (F.abs(last.x - b.x) <= F.greatest(2.5 * height, F.lit(18.0))))
    )


def is_ink(r: Column, g: Column, b: Column) -> Column:
    return r * 2126 + g * 7152 + b * 722 < 2_450_000


def quality(before: Column, after: Column) -> Column:
    return (
        F.when((before == "suspect") | (after == "suspect"), "suspect").when((before == "empty") & (after == "empty"), "empty")
        .when((before == "empty") | (after == "empty"), "partial").otherwise("text")
    )


def review_side(kind: Column) -> Column:
    return F.when(kind == "added", "after").when(kind == "removed", "before").otherwise("both")


def visual_type(before: Column, after: Column) -> Column:
    return (
        F.when(before.isNull() | after.isNull(), "visual").when((before == 0) & (after > 0), "added")
        .when((after == 0) & (before > 0), "removed").otherwise("modified")
    )


def page_status(before: Column, after: Column, moved: Column, same: Column) -> Column:
    return (
        F.when(moved, "moved").when(after.isNull(), "deleted").when(before.isNull(), "inserted")
        .when(same, "equal").otherwise("modified")
    )


def merged_kind(kind: Column) -> Column:
    """As an aggregate: the kind if all agree, else diverged."""
    return F.when(F.count_distinct(kind) == 1, F.min(kind)).otherwise("diverged")
