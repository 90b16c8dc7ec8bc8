"""Files, bytes and sets through the entry points, and the command line."""

import json

import pytest

import folium
from folium import __main__ as cli
from folium import api
from folium.functions.boxes import Box
from folium.operators.reading import Run


def pdf(pages):
    """Pages of (width, height, [(bytes, x, y)], [(image bytes, x, y)])."""
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"]
    kids = []
    for w, h, lines, images in pages:
        names = []
        for data, _, _ in images:
            objects.append(b"<< /Type /XObject /Subtype /Image /Length %d >>\nstream\n%s\nendstream" % (len(data), data))
            names.append(len(objects))
        body = b"".join(b"q 100 0 0 50 %d %d cm /Im%d Do Q\n" % (x, y, n) for n, (_, x, y) in zip(names, images, strict=True))
        body += b"\n".join(b"BT /F1 18 Tf %d %d Td (%s) Tj ET" % (x, y, t) for t, x, y in lines)
        objects.append(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(body), body))
        refs = b" ".join(b"/Im%d %d 0 R" % (n, n) for n in names)
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %d %d] /Contents %d 0 R /Resources << /Font << /F1 3 0 R >> /XObject << %s >> >> >>" % (w, h, len(objects), refs))
        kids.append(len(objects))
    objects[1] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, o) for k, o in enumerate(objects, 1)) + b"%%EOF"


BEFORE = pdf([(612, 792, [(b"First line", 72, 700)], [(b"one", 72, 300)]), (612, 792, [(b"Second page", 72, 700)], []), (612, 792, [(b"Third", 72, 700)], [])])
AFTER = pdf([(612, 792, [(b"First line", 72, 700)], [(b"one", 300, 100)]), (500, 792, [(b"Second page", 72, 700)], []), (612, 792, [(b"Third \x81", 72, 700)], [])])


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("pdf")
    for name, data in (("before", BEFORE), ("after", AFTER), ("bad", b"no")):
        (d / f"{name}.pdf").write_bytes(data)
    return {k: str(d / f"{k}.pdf") for k in ("before", "after", "bad")}


def test_sizes_figures_and_suspect_text_reach_the_comparison(spark, files):
    got = {r.pair_index: r for r in folium.compare(spark, files["before"], files["after"]).collect()}
    assert [f.status for f in got[0].figures] == ["moved"] and got[0].status == "modified"
    assert "page-geometry-changed" in got[1].warnings and got[1].status == "modified"
    assert got[2].quality == "suspect" and "text-suspect" in got[2].warnings
    assert (got[1].before_width, got[1].after_width) == (612, 500) and all(r.error is None for r in got.values())
    assert [r.label for r in got[0].review] == ["Figure moved"]
    same = folium.compare(spark, files["before"], files["before"]).collect()
    assert {r.status for r in same} == {"equal"}
    assert [(r.equal, r.error) for r in folium.is_equal(spark, files["before"], files["after"]).collect()] == [(False, None)]
    assert folium.is_equal(spark, files["before"], files["before"]).first().equal


def test_errors_are_rows(spark, files):
    assert folium.compare(spark, files["before"], files["bad"]).first().error == "pdfium"
    assert folium.is_equal(spark, files["bad"], files["before"]).first()[2:] == (None, "pdfium")
    few = folium.Options(mode="semantic", limits=folium.Limits(pages=2))
    assert folium.compare(spark, files["before"], files["after"], few).first().error == "page-limit-exceeded"
    small = folium.Options(mode="semantic", limits=folium.Limits(page_pixels=10))
    assert folium.compare(spark, files["before"], files["after"], small).first().error == "page-pixels-exceeded"
    tiny = folium.Options(mode="semantic", limits=folium.Limits(input_bytes=10))
    assert folium.compare(spark, files["before"], files["after"], tiny).first().error == "input-too-large"


def test_a_relation_of_bytes(spark):
    rows = spark.createDataFrame([(1, BEFORE, AFTER), (2, BEFORE, BEFORE), (3, BEFORE, b"no")], "k long, before binary, after binary")
    got = {r.k: r for r in api.totals(api.compare_edges(api.bytes_edges(rows), ["k"], folium.Options(mode="semantic")), ["k"]).collect()}
    assert not got[1].equal and got[2].equal and got[3].equal is None and got[3].error == "pdfium"


def test_a_set_of_files(spark, files):
    rows = folium.revisions(spark, [files["before"], files["after"]])
    ids = sorted((r.revision_id for r in rows.select("revision_id").collect()), reverse=True)
    result = folium.compare_set(rows, ids)
    assert not result.verdict().first().equal and {r.page_count for r in result.revisions().collect()} == {3}
    kinds = {(r.source, r.kind) for r in result.changes().collect()}
    assert ("text", "modified") in kinds or ("text", "added") in kinds
    result.close()


def test_command_line(spark, files, tmp_path, capsys):
    a, b = files["before"], files["after"]
    assert cli.main(["equal", a, a], spark) == 0 and json.loads(capsys.readouterr().out) == {"equal": True}
    assert cli.main(["equal", a, b], spark) == 1 and cli.main(["equal", a, b, "--exit-zero"], spark) == 0
    capsys.readouterr()
    assert cli.main(["diff", a, b], spark) == 1
    out = capsys.readouterr().out
    assert out.startswith(f"--- {a}\n+++ {b}\n@@ page 2") and cli.main(["diff", a, a], spark) == 0
    assert cli.main(["compare", a, b, "--output", str(tmp_path / "o")], spark) == 1
    assert len(json.loads((tmp_path / "o").read_text())["pages"]) == 3
    capsys.readouterr()
    assert cli.main(["series", a, b], spark) == 1 and capsys.readouterr().out.startswith("=== [before]")
    assert cli.main(["compare", a, files["bad"]], spark) == 2 and json.loads(capsys.readouterr().err)["error"]["code"] == "pdfium"
    assert cli.main(["compare", a], spark) == 2


def test_kernels_by_name():
    runs = [Run("b", Box(10, 40, 20, 12)), Run("a", Box(10, 10, 20, 12))]
    assert [r.text for r in folium.normalize_text(runs)] == ["a", "b"]
    assert folium.compare_runs(runs, runs).equal and not folium.compare_runs(runs, runs[:1]).equal
    with pytest.raises(AttributeError):
        folium.nothing  # noqa: B018
