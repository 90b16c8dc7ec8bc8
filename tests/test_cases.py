"""Small revisions with known results, from runs through the whole plan."""

import pytest

from folium.options import Limits, Options
from folium.plans.compare import PAGES_IN, compared, documents, text_changes

TEXT = dict(mode="semantic", render="none")


def box(x, y, w=40.0, h=12.0):
    return {"x": float(x), "y": float(y), "width": float(w), "height": float(h)}


def line(text, x=10, y=10, w=40, h=12, parts=()):
    return {"text": text, "bounds": box(x, y, w, h), "fragments": [{"text": t, "bounds": box(*b)} for t, *b in parts] or None}


def page(*runs, width=612.0, height=792.0, index=0, replaced=0, figures=()):
    return {"page_index": index, "width": width, "height": height, "replaced": replaced, "runs": list(runs), "figures": [{"bounds": box(*b), "content_hash": h} for h, *b in figures], "raster": None}


def compare(spark, before, after, **more):
    e = spark.createDataFrame([(0, before, after)], f"k int, before {PAGES_IN}, after {PAGES_IN}")
    return compared(e, ["k"], Options(**(TEXT | more)))


def one(spark, before, after, **more):
    return compare(spark, [page(*before)], [page(*after)], **more).first()


@pytest.mark.parametrize("before,after,quality,equal", [([], [], "empty", True), ([], [line("a")], "partial", False), ([line("a")], [line("a")], "text", True), ([line("  ")], [], "empty", True)])
def test_extraction_quality(spark, before, after, quality, equal):
    r = one(spark, before, after)
    assert (r.quality, r.equal) == (quality, equal) and ("text-unavailable" in r.warnings) == (quality == "empty") and r.warnings[-1] == "visual-not-computed"


def test_segments_are_joined_before_they_are_compared(spark):
    split = [line("Hello", 10, 10), line("world", 55, 10), line(".", 100, 10, 3), line("Next", 10, 60)]
    whole = [line("Hello world.", 10, 10, 93), line("Next", 10, 60)]
    r = one(spark, split, whole)
    assert r.equal and r.status == "equal" and r.before_chars == r.after_chars == len("Hello world.Next")


def test_columns_against_rows(spark):
    grid = [line("L1", 10, 10), line("R1", 420, 10), line("L2", 10, 60), line("R2", 420, 60)]
    texts = {o: [c.after_text for c in text_changes(compare(spark, [page()], [page(*grid)], reading_order=o), ["k"]).orderBy("change_ordinal").collect()] for o in ("auto", "rows", "columns")}
    assert texts["auto"] == texts["columns"] == ["L1", "L2", "R1", "R2"] and texts["rows"] == ["L1", "R1", "L2", "R2"]


def test_moved_text(spark):
    r = one(spark, [line("same words", 10, 10)], [line("same words", 70, 10)])
    assert [c.kind for c in r.changes] == ["moved"] and [b.kind for b in r.blocks] == ["moved"] and r.changed_lines == 0 and r.status == "modified"


def test_far_texts_do_not_match(spark):
    r = one(spark, [line("alpha", 10, 10)], [line("omega", 400, 700)])
    kinds = {c.kind: c for c in r.changes}
    assert set(kinds) == {"removed", "added"} and kinds["removed"].after_bounds is None and kinds["added"].before_bounds is None


def test_a_word_added_and_a_word_replaced(spark):
    r = one(spark, [line("Pay the bill", w=120)], [line("Pay the bill now", w=150)])
    assert [(c.kind, c.before_text, c.after_text) for c in r.changes] == [("added", None, "now")] and r.changed_lines == 2
    r = one(spark, [line("Pay the bill", w=120)], [line("Pay the debt", w=120)])
    assert [(c.kind, c.before_text, c.after_text) for c in r.changes] == [("modified", "Pay the bill", "Pay the debt")]


def test_focus_is_on_the_fragments_that_differ(spark):
    parts = lambda w: [("one", 10, 10, 30), (w, 50, 10, 30), ("three", 90, 10, 40)]
    r = one(spark, [line("one two three", w=120, parts=parts("two"))], [line("one ten three", w=120, parts=parts("ten"))])
    c = r.changes[0]
    assert (c.before_focus_bounds.x, c.before_focus_bounds.width, c.after_focus_bounds.x) == (50, 30, 50)


def test_lists_and_tables(spark):
    r = one(spark, [line("- first item", y=10), line("plain", y=200)], [line("- first thing", y=10), line("plain", y=200)])
    assert [b.structure for b in r.blocks] == ["list-item"]
    row = lambda x: line(f"a b {x}", w=200, parts=[("a", 10, 10, 10), ("b", 60, 10, 10), (x, 120, 10, 10)])
    assert [b.structure for b in one(spark, [row("c")], [row("d")]).blocks] == ["table-row"]


def test_a_split_line_is_reflowed(spark):
    r = one(spark, [line("one two three four", w=180)], [line("one two", y=10, w=80), line("three four", y=26, w=90)])
    assert [c.kind for c in r.changes] == ["reflowed"] and not r.hunks and [b.kind for b in r.blocks] == ["reflowed"]


def test_rewrapped_and_edited_text_is_one_word_hunk(spark):
    before = [line("the quick brown fox jumps", y=10, w=200), line("over the lazy dog today", y=26, w=190)]
    after = [line("the quick brown", y=10, w=120), line("fox leaps over the", y=26, w=150), line("lazy dog today", y=42, w=120)]
    r = one(spark, before, after)
    assert [len(h.lines) for h in r.hunks] == [2] and [x.kind for x in r.hunks[0].lines] == ["removed", "added"] and r.changed_lines == 2
    assert "[-jumps-]" in r.hunks[0].lines[0].marked and "{+leaps+}" in r.hunks[0].lines[1].marked


@pytest.mark.parametrize("context,lines", [(0, 2), (1, 4), (3, 4)])
def test_context(spark, context, lines):
    texts = lambda w: [line(t, y=10 + 60 * k, w=100) for k, t in enumerate(("first line", f"middle {w}", "last line"))]
    r = one(spark, texts("old"), texts("new"), context_lines=context)
    assert [len(h.lines) for h in r.hunks] == [lines] and r.changed_lines == 2


def test_oversize_pages_are_listed_up_to_the_limit(spark):
    side = lambda w: [line(f"{w} {k}", y=14 * k) for k in range(2100)]
    r = one(spark, side("old"), side("new"))
    assert not r.equal and r.diff_truncated and not r.changes_truncated and len(r.changes) == 2100
    assert {"text-diff-truncated"} <= set(r.warnings) and "text-changes-truncated" not in r.warnings


def test_repeated_headers_carry_over(spark):
    pages = lambda title: [page(line(f"Annual report {k + 1}", y=10, w=120), line(f"{title} {k}", y=400), index=k) for k in range(3)]
    rows = compare(spark, pages("body"), [page(line(f"Yearly report {k + 1}", y=10, w=120), line(f"body {k}", y=400), index=k) for k in range(3)]).collect()
    blocks = [b for r in rows for b in r.blocks]
    assert blocks and all((b.before_role, b.after_role) == ("header", "header") for b in blocks)


def test_pages_added_and_of_another_size(spark):
    rows = compare(spark, [page(line("a"))], [page(line("a"), width=600.0), page(line("b"), index=1)]).orderBy("pair_index").collect()
    assert [r.status for r in rows] == ["modified", "inserted"] and "page-geometry-changed" in rows[0].warnings
    d = documents(compare(spark, [page(line("a"))], [page(line("a"), width=600.0), page(line("b"), index=1)]), ["k"]).first()
    assert (d.equal, d.changed_pages, d.before_pages, d.after_pages) == (False, 2, 1, 2)


def test_figures_swap_places(spark):
    a, b = ("aa", 10, 10, 100, 50), ("bb", 10, 300, 100, 50)
    turned = [("bb", *a[1:]), ("aa", *b[1:])]
    e = dict(render="full", limits=Limits())
    rows = compare(spark, [page(line("t", y=500), figures=[a, b])], [page(line("t", y=500), figures=turned)], **e).collect()
    assert [f.status for f in rows[0].figures] == ["swapped", "swapped"] and rows[0].status == "modified"
    assert {r.operation for r in rows[0].review} == {"figure-swap-figure-1-figure-2"}
