import os

from folium import render
from folium.functions.boxes import Box
from folium.operators.reading import Run
from folium.options import Options
from folium.plans.compare import Page, compare, compared, documents, is_equal, review_stream, runs_of
from folium.plans.sets import change_operations
from folium.streaming.series import adjacent, against_baseline

TEXT = Options(mode="semantic", render="none")


def page(*lines):
    return Page(612, 152, [Run(t, Box(72, 10 + 16 * k, 6 * len(t), 12)) for k, t in enumerate(lines)])


def test_compare_and_render():
    before, after = [page("alpha beta", "gamma"), page("same")], [page("alpha new beta", "gamma"), page("same"), page("more")]
    got = compare(before, after, TEXT)
    assert [p["status"] for p in got] == ["modified", "equal", "inserted"]
    text = render.diff_text(got, "a", "b")
    assert text.startswith("--- a\n+++ b\n@@ page 1 before=1 after=1 status=modified @@\n@@ block page-0-block-1 kind=added side=after structure=Paragraph before=1 after=1 @@\n")
    assert "+alpha {+new+} beta" in text and "@@ page 3 before=- after=3 status=inserted @@" in text
    assert "[after] +alpha {+new+} beta" in render.diff_text(got, "a", "b", sided=True)
    assert render.diff_text(compare(before, before, TEXT), "a", "b") == ""
    assert is_equal(before, before, TEXT) and not is_equal(before, after, TEXT)


def test_set_text():
    line = {"kind": "added", "marked": "new"}
    change = {
        "id": "change-1", "kind": "added", "source": "text", "page_index": 0, "anchors": [{"revision_id": "b", "state": "introduced", "text": "new"}],
        "comparisons": [{"from": "a", "to": "b", "hunks": [{"before_start": 1, "after_start": 1, "lines": [line]}]}],
    }
    text = render.set_text([("a", "A"), ("b", "B")], [change])
    assert text.splitlines() == ["=== [a] A ===", "=== [b] B ===", "@@ change change-1 kind=added source=text page=1 revisions=b @@", "@@ -1 +1 @@", "[b] +new"]
    assert render.set_text([], []) == ""


def test_frames_and_sinks(spark, tmp_path):
    e = spark.createDataFrame([(1, 2, "a line\nb line", "a line\nc line"), (3, 4, "x", "x"), (5, 6, None, "x")], "from_id long, to_id long, before string, after string")
    p = compared(e.select("from_id", "to_id", runs_of("before").alias("before"), runs_of("after").alias("after")), ("from_id", "to_id"), TEXT)
    d = {r.from_id: r for r in documents(p, ("from_id", "to_id")).collect()}
    assert not d[1].equal and d[1].changed_lines == 2 and d[3].equal and not d[5].equal
    assert review_stream(p, ("from_id",)).filter("from_id = 3").count() == 0
    render.write_json(documents(p, ("from_id",)), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3
    render.write_previews(spark.createDataFrame([(0, bytearray(b"x"))], "pair_index int, png binary"), str(tmp_path / "p"))
    assert os.listdir(tmp_path / "p") == ["page-0001.png"]


def test_change_operations(spark):
    rows = [("s", 0, "a", "b", "one line", "one line\ntwo new"), ("s", 1, "b", "c", "one line\ntwo new", "one line")]
    e = spark.createDataFrame(rows, "set_id string, edge_index int, from_revision string, to_revision string, before string, after string")
    keys = ("set_id", "edge_index", "from_revision", "to_revision")
    ops = change_operations(compared(e.select(*keys, runs_of("before").alias("before"), runs_of("after").alias("after")), keys, TEXT)).collect()
    assert {o.kind for o in ops} == {"added", "removed"} and all(len(o.anchors) == 1 for o in ops)


def test_adjacent_stream(spark, tmp_path):
    schema = "conv_id long, turn long, text string"
    q = adjacent(spark.readStream.schema(schema).json(str(tmp_path))).writeStream.outputMode("append").format("memory").queryName("series").start()
    try:
        for k, rows in enumerate([[(1, 0, "a"), (1, 1, "a\nb"), (2, 0, "x")], [(1, 2, "a\nb"), (2, 1, "y")], [(2, 0, "late"), (2, 2, "y")]]):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / f"d{k}"))
            for f in os.listdir(tmp_path / f"d{k}"):
                if f.startswith("part"):
                    os.rename(tmp_path / f"d{k}" / f, tmp_path / f"{k}.json")
            q.processAllAvailable()
        got = sorted((r.set_id, r.to_turn, r.from_turn, r.equal, r.changed_lines, r.late) for r in spark.table("series").collect())
    finally:
        q.stop()
    assert got == [(1, 1, 0, False, 1, False), (1, 2, 1, True, 0, False), (2, 0, None, None, None, True), (2, 1, 0, False, 2, False), (2, 2, 1, True, 0, False)]


def test_baseline_stream(spark, tmp_path):
    schema = "conv_id long, turn long, text string"
    spark.createDataFrame([(1, 1, "a\nc"), (1, 2, "a"), (2, 1, None)], schema).write.json(str(tmp_path / "d"))
    base = spark.createDataFrame([(1, 0, "a"), (2, 0, "x")], schema)
    stream = spark.readStream.schema(schema).json(str(tmp_path / "d"))
    q = against_baseline(stream, base).writeStream.outputMode("append").format("memory").queryName("baseline").start()
    try:
        q.processAllAvailable()
        got = sorted((r.set_id, r.to_turn, r.from_turn, r.equal, r.changed_lines) for r in spark.table("baseline").collect())
    finally:
        q.stop()
    assert got == [(1, 1, 0, False, 1), (1, 2, 0, True, 0), (2, 1, 0, False, 2)]
    assert adjacent(stream, idle=60_000).isStreaming
