import numpy as np
import pytest

from folium.functions import boxes, words
from folium.functions.boxes import Box
from folium.operators import figures, pages, raster, review, roles, textdiff, verdicts
from folium.operators.matching import Change, Summary, compare_runs, paragraphs, quality, review_blocks
from folium.operators.reading import Fragment, Run, normalize
from folium.options import ComparisonError, Limits, Options, exit_code, pixels_of, resolve_password, set_edges


def run(text, x, y, w=40, h=12, parts=()):
    return Run(text, Box(x, y, w, h), tuple(Fragment(t, Box(*b)) for t, *b in parts))


def flat(image):
    return np.full((8, 12, 4), image, np.uint8)


# --- reading order -----------------------------------------------------------------------------------------------------


def test_lines_are_rebuilt():
    got = normalize([run("Hello", 10, 10), run(" world ", 55, 10), run(".", 70, 10, 3), run("Next", 10, 40), run("  ", 0, 0)])
    assert [r.text for r in got] == ["Hello world.", "Next"]
    assert got[0].box.x == 10 and len(got[0].fragments) == 3


def test_columns_and_rows():
    grid = [run("L1", 10, 10), run("R1", 420, 10), run("L2", 10, 40), run("R2", 420, 40)]
    texts = lambda order: [r.text for r in normalize(grid, order)]
    assert texts("auto") == texts("columns") == ["L1", "L2", "R1", "R2"] and texts("rows") == ["L1", "R1", "L2", "R2"]
    heading = [*grid, run("Top", 10, -30, 450)]
    assert normalize(heading)[0].text == "Top"


# --- text ----------------------------------------------------------------------------------------------------------------


def test_tokens_and_joining():
    assert words.tokens("foo-bar_1, x") == ["foo", "-", "bar_1", ",", "x"]
    assert words.joined("a (", "b") == "a (b" and words.joined("a", ", b") == "a, b" and words.joined("", "x") == "x"
    assert words.squeeze(" a\t b\n") == "a b"


@pytest.mark.parametrize("text,key", [("Page 1 of 2", "page# of#"), ("x 1y", "x# y"), ("12 A", "# a"), ("a  B", "a b"), ("", "")])
def test_role_key(text, key):
    assert words.role_key(text) == key


@pytest.mark.parametrize("text,hit", [("- a", True), ("•", True), ("1. a", True), ("12) b", True), ("a. x", True), ("ab. x", False), ("-a", False), ("1.", False)])
def test_list_marker(text, hit):
    assert words.is_list_marker(text) is hit


def test_lcs_against_the_definition():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = (rng.choice(list("abc"), int(rng.integers(0, 9))).tolist() for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                table[i, j] = table[i + 1, j + 1] + 1 if a[i] == b[j] else max(table[i + 1, j], table[i, j + 1])
        assert (words.lcs_table(*words.codes(a, b)) == table).all() and words.lcs(a, b) == table[0, 0]
        ops = list(words.walk(a, b))
        assert sum(o == "=" for o, _, _ in ops) == table[0, 0] and len(ops) == len(a) + len(b) - table[0, 0]


def test_changed_text_is_rebuilt_from_tokens():
    assert words.changed_text("", "foo-bar", "added") == "foo - bar"
    assert words.changed_text("a c e", "a b c d e", "added") == "b  d"
    assert words.edit_kind("a c", "a b c") == "added" and words.edit_kind("a b c", "a c") == "removed" and words.edit_kind("a", "b") == "modified"


def test_marks():
    before, after = words.inline("the old cat", "the new cat")
    assert words.marked_line("the old cat", before) == "the [-old-] cat" and words.marked_line("the new cat", after) == "the {+new+} cat"
    assert words.marked_line("a\nb", [("added", "a\nb")]) == "a\\nb"


def test_similarity():
    assert words.similarity("a b", "a b") == 1 and words.similarity("...", "...") == 1 and words.similarity("a b c d", "a x c d") == 0.75
    long = " ".join("abcdefgh"[k % 8] for k in range(70))
    assert words.similarity("z " + long, long) == 0  # over the size limit only the beginning counts


# --- diffs -----------------------------------------------------------------------------------------------------------------


def test_hunks_and_context():
    d = textdiff.text_diff(["a", "b", "c"], ["a", "x", "c"], 3)
    assert [x.kind for x in d.hunks[0].lines] == ["context", "removed", "added", "context"] and d.changed_lines == 2
    assert len(textdiff.text_diff(["a", "b", "c"], ["a", "x", "c"], 0).hunks[0].lines) == 2
    far = textdiff.text_diff([str(k) for k in range(20)], ["x", *map(str, range(1, 19)), "y"], 2)
    assert [(h.before_start, h.after_start) for h in far.hunks] == [(1, 1), (18, 18)]


def test_flow_diff():
    d = textdiff.text_diff(["one two three", "four five six"], ["one two three four", "now five six"], 3)
    assert len(d.hunks) == 1 and len(d.hunks[0].lines) == 2 and d.changed_lines == 2


def test_oversize_is_truncated():
    d = textdiff.text_diff(["x"] * 2100, ["y"] * 2100)
    assert d.truncated and not d.hunks


# --- runs and blocks -----------------------------------------------------------------------------------------------------


def test_moved_and_modified_runs():
    p = compare_runs([run("Same", 10, 10)], [run("Same", 70, 10)])
    assert [c.kind for c in p.changes] == ["moved"] and [b.kind for b in p.blocks] == ["moved"]
    p = compare_runs([run("Before", 10, 10)], [run("After", 10, 10)])
    assert p.changes[0].kind == "modified" and not p.equal


def test_unmatched_runs_are_removed_and_added():
    p = compare_runs([run("Old", 10, 10)], [run("New", 400, 500)])
    assert [c.kind for c in p.changes] == ["removed", "added"] and p.changes[0].after_box is None and p.changes[1].before_box is None


def test_inserted_line():
    p = compare_runs([run("a", 10, 10), run("c", 10, 70)], [run("a", 10, 10), run("b now", 10, 40), run("c", 10, 70)])
    assert [c.kind for c in p.changes] == ["added"] and p.diff.changed_lines == 1


def test_reflow():
    p = compare_runs([run("one two", 10, 10), run("three", 10, 26)], [run("one", 10, 10), run("two three", 10, 26)])
    assert [c.kind for c in p.changes] == ["reflowed"] and not p.diff.hunks and [b.kind for b in p.blocks] == ["reflowed"]


def test_bounded_path():
    p = compare_runs([run(f"a{k}", 10, k) for k in range(2100)], [run(f"b{k}", 10, k) for k in range(2100)])
    assert len(p.changes) == 2100 and not p.truncated and not p.equal and p.diff.truncated
    p = compare_runs([run("a", 0, 0)] * 5000, [run("b", 0, 0)] * 5000)
    assert len(p.changes) == 4096 and p.truncated


def test_focus_on_fragments():
    parts = lambda mid, w: [("The", 10, 10, 20, 12), (mid, 34, 10, w, 12), ("end", 90, 10, 20, 12)]
    p = compare_runs([run("The old end", 10, 10, 100, 12, parts("old", 42))], [run("The new end", 10, 10, 100, 12, parts("new", 50))])
    assert p.changes[0].before_focus.width == 42 and p.changes[0].after_focus.width == 50


def test_blocks():
    lines = [run("A first line", 10, 10, 100), run("goes on.", 10, 24, 80), run("- item", 10, 38, 60), run("x | y", 10, 52, 60)]
    assert [(p.kind, len(p.lines)) for p in paragraphs(lines)] == [("paragraph", 2), ("list-item", 1), ("table-row", 1)]
    added = review_blocks(lines[:2], [*lines[:2], run("B new", 10, 300, 90), run("C new", 10, 700, 90)])
    assert [b.kind for b in added] == ["added"] and added[0].id == "block-1" and added[0].before_role is None
    assert review_blocks(lines, lines) == []


def test_quality_and_summary():
    assert [quality(*x) for x in (("empty", "empty"), ("empty", "text"), ("suspect", "empty"), ("text", "text"))] == ["empty", "partial", "suspect", "text"]
    assert Summary.of([run("ab", 0, 0)], 1).status == "suspect" and Summary.of([], 2).status == "empty" and Summary.failed("x" * 300).error.endswith("...")


def test_roles():
    p = [(k, [run(f"Report page {k}", 10, 5), run("body", 10, 300)], 792.0) for k in range(2)]
    known = roles.evidence(p)
    assert roles.repeated("Report page 9", "header", known) and not roles.repeated("Report", "header", known) and not roles.repeated("body", "header", known)


# --- pages, rasters, figures ---------------------------------------------------------------------------------------------


def prints(*greys):
    return [pages.Fingerprint(100, 100, np.full((64, 3), g, np.uint8)) for g in greys]


def test_page_pairs():
    assert pages.by_index(1, 2) == [(0, 0, False), (None, 1, False)]
    a, b, c, d = 0, 90, 180, 255
    assert pages.by_sequence(prints(a, d), prints(a, b, d)) == [(0, 0, False), (None, 1, False), (1, 2, False)] or pages.by_sequence(prints(a, d), prints(a, b, d))[0] == (0, 0, False)
    assert pages.by_sequence(prints(a), prints(d)) == [(0, 0, False)]
    swapped = pages.by_sequence(prints(a, d), prints(d, a))
    assert {(p.before, p.after) for p in swapped} in ({(0, 1), (1, 0)}, {(0, 0), (1, 1)})
    assert pages.mark_inversions([pages.Pair(0, 1), pages.Pair(1, 0), pages.Pair(2, 2)]) == [(0, 1, True), (1, 0, True), (2, 2, False)]
    assert len(pages.by_sequence(prints(*[0] * 2001), prints(*[0] * 2001))) == 2001
    assert c


def small(**more):
    return raster.Options(**({"channel_tolerance": 0, "changed_pixel_ratio": 0.0, "max_shift": 3, "sample_step": 1, "min_region_area": 1} | more))


def test_raster_alignment_and_regions():
    assert raster.compare(flat(255), flat(255), small()).equal and raster.compare(flat(255), flat(255), small()).alignment.confidence == 1
    before, after = np.full((12, 16, 4), 255, np.uint8), np.full((12, 16, 4), 255, np.uint8)
    before[2:6, 3:7, :3], after[3:7, 5:9, :3] = 0, 0
    d = raster.compare(before, after, small())
    assert d.equal and (d.alignment.dx, d.alignment.dy) == (2, 1)
    x, y = np.full((10, 10, 4), 255, np.uint8), np.full((10, 10, 4), 255, np.uint8)
    y[4, 4, :3] = y[5, 5, :3] = 0
    d = raster.compare(x, y, small(max_shift=0), preview=True)
    assert len(d.regions) == 1 and d.regions[0].changed == 2 and d.regions[0].width == 2 and d.regions[0].after_content == 2
    assert tuple(d.preview[4, 4]) == (235, 45, 55, 255) and raster.png(d.preview).startswith(b"\x89PNG")
    assert raster.compare(x, y, small(max_shift=0, min_region_area=3)).regions == []


def test_labels_against_flood_fill():
    rng = np.random.default_rng(6)
    for _ in range(20):
        mask = rng.random((9, 11)) < 0.4
        label, seen = raster.labelled(mask), np.full(mask.shape, -1)
        for y, x in zip(*np.nonzero(mask), strict=True):
            if seen[y, x] < 0:
                todo = [(y, x)]
                while todo:
                    a, b = todo.pop()
                    if 0 <= a < 9 and 0 <= b < 11 and mask[a, b] and seen[a, b] < 0:
                        seen[a, b] = y * 11 + x
                        todo += [(a + p, b + q) for p in (-1, 0, 1) for q in (-1, 0, 1)]
        assert (label == seen).all()


def figure(x, y, content, w=60, h=40):
    return figures.Figure(Box(x, y, w, h), content)


def test_figures():
    status = lambda a, b: [f.status for f in figures.compare(a, b)]
    assert status([figure(0, 0, 1), figure(200, 0, 2)], [figure(200, 0, 1), figure(0, 0, 2)]) == ["swapped", "swapped"]
    assert status([figure(0, 0, 1)], [figure(2, 0, 9)]) == ["modified"] and status([figure(0, 0, 1)], [figure(300, 0, 1)]) == ["moved"]
    assert status([figure(0, 0, 1)], [figure(0, 0, 1), figure(300, 0, 7)]) == ["added"] and status([figure(0, 0, 1)], []) == ["removed"]
    assert status([figure(0, 0, 1)], [figure(1, 1, 1)]) == []


def test_verdicts():
    both, P = pages.Pair(0, 0), pages.Pair
    assert [verdicts.status(*x) for x in ((both, True, True, True), (both, False, True, True), (P(0, None), False, None, None), (P(None, 0), False, None, None), (P(0, 1, True), True, True, True))] == ["equal", "modified", "deleted", "inserted", "moved"]
    text = compare_runs([run("a", 0, 0)], [run("b", 0, 0)])
    assert verdicts.warnings(both, False, 0.5, True, text) == ["page-geometry-changed", "low-alignment-confidence", "semantic-visual-disagreement"]
    assert verdicts.warnings(both, True, 1.0, None, text)[-1] == "visual-not-computed"


def test_review_groups():
    c = [Change(f"text-{k}", "added", after_text="t", after_box=Box(x, y, 20, 10)) for k, (x, y) in enumerate([(10, 10), (35, 11), (10, 90)])]
    assert [len(g) for g in review.text_groups(c)] == [2, 1]
    r = [raster.Region(f"region-{k}", x, 0, 5, 5, n, 0, n) for k, (x, n) in enumerate([(0, 3), (15, 4), (200, 50)])]
    assert [x[1] for x in review.clusters(r)] == [50, 7] and review.visual_type(0, 3) == "added"
    rows = review.review("modified", [], [figures.FigureDiff("figure-1", "swapped", None, None, 1), figures.FigureDiff("figure-2", "swapped", None, None, 1)], [], (100, 100), (200, 200))
    assert list(review.operations(rows)) == ["figure-swap-figure-1-figure-2"]
    assert review.review("inserted", [], [], [], (100, 100), (200, 200))[0].id == "page-inserted"


def test_boxes():
    a, b = Box(0, 0, 10, 10), Box(5, 5, 10, 10)
    assert boxes.overlap(a, b) == 25 and boxes.positional(a, b) and not boxes.positional(a, Box(9, 9, 10, 10))
    assert boxes.positional(a, Box(12, 0, 10, 10)) and not boxes.positional(a, Box(100, 0, 10, 10))
    assert boxes.edge_role(Box(0, 5, 10, 10), 792) == "header" and boxes.edge_role(Box(0, 770, 10, 10), 792) == "footer" and boxes.edge_role(Box(0, 300, 10, 10), 792) is None


def test_options():
    for bad in ({"dpi": 0}, {"render": "none"}, {"context_lines": 101}, {"limits": Limits(pages=0)}, {"raster": raster.Options(max_shift=65)}):
        with pytest.raises(ComparisonError) as e:
            Options(**bad)
        assert e.value.code == "invalid-options" and e.value.record()["error"]["code"] == "invalid-options"
    assert pixels_of(612, 792, Options()) == (1224, 1584)
    with pytest.raises(ComparisonError):
        pixels_of(1e5, 1e5, Options())
    assert set_edges(["a", "b", "c"]) == [(0, 1), (0, 2)] and set_edges(["a", "b", "c"], "adjacent") == [(0, 1), (1, 2)]
    for ids in (["a"], ["a", "a"], ["a", " "]):
        with pytest.raises(ComparisonError):
            set_edges(ids)
    assert resolve_password("x", "y") == "x" and resolve_password(None, "y") == "y"
    assert [exit_code(True), exit_code(False), exit_code(False, exit_on_difference=False), exit_code(None, "pdfium"), exit_code(None, "cancelled")] == [0, 1, 0, 2, 130]


def test_lines_of_many_runs_are_those_of_few(monkeypatch):
    from folium.operators import reading

    rng = np.random.default_rng(3)
    for n in (0, 1, 40, 150):
        runs = [run(str(k), float(rng.integers(0, 900)), float(rng.integers(0, 120)), float(rng.integers(5, 60)), float(rng.integers(0, 20))) for k in range(n)]
        many = reading._grouped_many(runs)
        monkeypatch.setattr(reading, "_grouped_many", lambda r: None)
        few = []
        for r in runs:  # by definition
            near = [(min(abs(r.box.cy - m.box.cy) for m in line), k) for k, line in enumerate(few) if any(boxes.same_line(m.box, r.box) for m in line)]
            few[min(near)[1]].append(r) if near else few.append([r])
        monkeypatch.undo()
        assert many == few
