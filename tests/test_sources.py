import zlib

import pytest

from folium.options import ComparisonError, Limits, Options
from folium.plans.compare import runs_of
from folium.plans.session import DocumentSet, PreviewCache, Session
from folium.sources.pdf import Reader, read_pdf


def pdf(pages, flate=False, image=b"pixels"):
    """A small file: each page a list of (text, x, y)."""
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>", b"<< /Type /XObject /Subtype /Image /Length %d >>\nstream\n%s\nendstream" % (len(image), image)]
    kids = []
    for lines in pages:
        body = b"q 100 0 0 50 72 600 cm /Im1 Do Q\n" + b"\n".join(b"BT /F1 18 Tf %d %d Td (%s) Tj ET" % (x, y, t.encode("cp1252").replace(b"(", b"\\(")) for t, x, y in lines)
        packed = zlib.compress(body) if flate else body
        objects.append(b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(packed), b" /Filter /FlateDecode" if flate else b"", packed))
        objects.append(b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R /Resources << /Font << /F1 3 0 R >> /XObject << /Im1 4 0 R >> >> >>" % len(objects))
        kids.append(len(objects))
    objects[1] = b"<< /Type /Pages /MediaBox [0 0 612 792] /Count %d /Kids [%s] >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, o) for k, o in enumerate(objects, 1)) + b"%%EOF"


@pytest.mark.parametrize("flate", [False, True])
def test_reader(flate):
    r = Reader(pdf([[("Hello, world-wide (x", 72, 700)], [("é", 72, 700)]], flate))
    w, h, runs, figures, bad = r.page(0)
    assert (w, h, bad) == (612, 792, 0) and len(r.pages) == 2
    assert runs[0].text == "Hello, world-wide (x" and [f.text for f in runs[0].fragments] == ["Hello", ",", "world-wide", "(", "x"]
    assert runs[0].box.x == 72 and 70 < runs[0].box.y < 92 and figures[0][0] == (72, 142, 100, 50)
    assert r.page(1)[2][0].text == "é"


def test_read_pdf(spark, tmp_path):
    (tmp_path / "one.pdf").write_bytes(pdf([[("a b", 72, 700)]]))
    (tmp_path / "two.pdf").write_bytes(pdf([[("a c", 72, 700)], [("d", 72, 700)]]))
    (tmp_path / "bad.pdf").write_bytes(b"no")
    (tmp_path / "locked.pdf").write_bytes(pdf([[]]) + b"/Encrypt 9 0 R")
    got = {(r.revision_id, r.page_index): r for r in read_pdf(spark, str(tmp_path)).collect()}
    assert got["one", 0].runs[0].text == "a b" and len(got["two", 1].figures) == 1
    assert got["bad", None].error == "pdfium" and got["locked", None].error == "password-required"
    assert {r.error for r in read_pdf(spark, str(tmp_path), Limits(input_bytes=1)).collect()} == {"input-too-large"}
    with pytest.raises(ComparisonError):
        Reader(b"%PDF-1.4 nothing")


def test_sessions(spark):
    rows = [("a", "one line\nsecond"), ("b", "one line\nchanged"), ("c", "one line\nsecond")]
    r = spark.createDataFrame(rows, "revision_id string, text string").select("revision_id", runs_of("text").alias("runs"))
    s = DocumentSet(r, ["a", "b", "c"], Options(mode="semantic", render="none"))
    assert {(x.from_revision, x.to_revision): x.status for x in s.pages().collect()} == {("a", "b"): "modified", ("a", "c"): "equal"}
    one = s.session("a", "b")
    assert s.session("a", "b") is one and not one.run(lambda d: d.first().equal, one.equal()) and one.pages() is one.pages()
    with pytest.raises(ComparisonError):
        s.session("a", "a")
    image = one.preview(("a", "b"), 0)
    assert image.startswith(b"\x89PNG") and one.preview(("a", "b"), 0) == image and (one.previews.hits, one.previews.misses) == (1, 1)
    for bad in (lambda: one.preview(("a", "b"), 5), lambda: one.preview(("a", "b"), 0, "side")):
        with pytest.raises(ComparisonError):
            bad()
    assert set(one.progress()) == {"completed", "total"}
    one.cancel()
    one.close()
    assert isinstance(one, Session)


def test_cache_evicts_by_bytes():
    c = PreviewCache(10)
    for k in "abc":
        c.get(k, lambda: b"12345")
    assert list(c.files) == ["b", "c"] and c.evictions == 1 and c.held == 10
    c.get("big", lambda: b"x" * 11)
    assert "big" not in c.files
