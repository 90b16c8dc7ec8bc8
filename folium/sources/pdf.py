"""A small PDF reader: positioned text and image figures of files with simple fonts, as Spark relations.

It reads plain and Flate streams, the page tree with inherited boxes, text operators with matrices, and image XObjects.
Widths are Helvetica's for every font without its own /Widths. It renders nothing and opens no encrypted file: both are
reported as errors with codes. Any other producer of the same relations can stand in its place.
"""

from __future__ import annotations

import hashlib
import re
import string
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boxes, words
from ..functions.boxes import Box
from ..operators.reading import Fragment, Run
from ..options import ComparisonError, Limits

# Advance widths of Helvetica for the codes 32 to 126, in thousandths.
WIDTHS = (
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556,
    1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556,
    333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
)

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)endobj", re.S)
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<<|>>|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s<>\[\]()/%]*|[-+]?\d*\.?\d+|[A-Za-z'\"*]+\d?|%[^\r\n]*", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
Matrix = tuple[float, float, float, float, float, float]
UNIT: Matrix = (1, 0, 0, 1, 0, 0)


def times(a: Matrix, b: Matrix) -> Matrix:
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def _string(token: bytes) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        octal = lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _ESCAPES.get(m[1], b"" if m[1] in b"\r\n" else m[1])
        raw = re.sub(rb"\\([0-7]{1,3}|.)", octal, token[1:-1], flags=re.S)
    return raw.decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")


class Reader:
    """One file's pages."""

    def __init__(self, data: bytes):
        if not data.startswith(b"%PDF"):
            raise ComparisonError("pdfium", "not a PDF file")
        if re.search(rb"/Encrypt\b", data):
            raise ComparisonError("password-required", "the file is encrypted")
        self.objects = {int(n): body for n, body in _OBJECT.findall(data)}
        root = next((b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog\b", b)), None)
        if root is None:
            raise ComparisonError("pdfium", "no catalog")
        self.pages = list(self._walk(self._ref(root, b"Pages"), b""))

    def _ref(self, body: bytes, key: bytes) -> bytes:
        m = re.search(rb"/" + key + rb"\s+(\d+)\s+\d+\s+R", body)
        return self.objects.get(int(m[1]), b"") if m else b""

    def _walk(self, node: bytes, box: bytes) -> Iterator[tuple[bytes, bytes]]:
        m = re.search(rb"/MediaBox\s*(\[[^\]]*\])", node)
        box = m[1] if m else box
        kids = re.search(rb"/Kids\s*\[([^\]]*)\]", node)
        if not kids:
            yield node, box
            return
        for n in re.findall(rb"(\d+)\s+\d+\s+R", kids[1]):
            yield from self._walk(self.objects.get(int(n), b""), box)

    @staticmethod
    def stream(body: bytes) -> bytes:
        m = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", body, re.S)
        if not m:
            return b""
        return zlib.decompressobj().decompress(m[1]) if re.search(rb"/FlateDecode", body[: m.start()]) else m[1]

    def content(self, page: bytes) -> bytes:
        m = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", page)
        refs = re.findall(rb"(\d+)\s+\d+\s+R", m[1]) if m else []
        return b"\n".join(self.stream(self.objects.get(int(n), b"")) for n in refs)

    def named(self, page: bytes, kind: bytes) -> dict[bytes, bytes]:
        """Resources of a kind by name."""
        source = self._ref(page, b"Resources") or page
        m = re.search(rb"/" + kind + rb"\s*<<(.*?)>>", source, re.S)
        pairs = re.findall(rb"/([^\s/<>]+)\s+(\d+)\s+\d+\s+R", m[1] if m else self._ref(source, kind))
        return {name: self.objects.get(int(n), b"") for name, n in pairs}

    def page(self, k: int) -> tuple[float, float, list[Run], list[tuple[Box, int]], int]:
        """(width, height, runs, figures, replacement characters)."""
        node, box = self.pages[k]
        x0, y0, x1, y1 = (float(v) for v in re.findall(rb"[-+]?\d*\.?\d+", box or b"0 0 612 792")[:4])
        width, height = x1 - x0, y1 - y0
        fonts, images = self.named(node, b"Font"), self.named(node, b"XObject")
        runs, figures = [], []
        for kind, value, matrix in self._shown(self.content(node), fonts):
            if kind == "text":
                run = place(value, matrix, x0, y0, height)
                if run:
                    runs.append(run)
            elif (body := images.get(value)) is not None and re.search(rb"/Subtype\s*/Image\b", body):
                w, h = abs(matrix[0]) + abs(matrix[2]), abs(matrix[1]) + abs(matrix[3])
                low = min(matrix[4], matrix[4] + matrix[0], matrix[4] + matrix[2]), min(matrix[5], matrix[5] + matrix[1], matrix[5] + matrix[3])
                if w > 1 and h > 1:
                    figures.append((Box(low[0] - x0, height - (low[1] - y0) - h, w, h), content_hash(self.stream(body))))
        return width, height, runs, figures, sum(r.text.count("�") for r in runs)

    def _shown(self, content: bytes, fonts: dict[bytes, bytes]) -> Iterator[tuple]:
        """('text', characters, matrix) and ('image', name, matrix) in drawing order; characters are (text, x, width)."""
        stack: list[Matrix] = []
        ctm, tm, line = UNIT, UNIT, UNIT
        size, leading, gap, space, scale, rise, widths = 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, {}
        operands: list = []
        for token in _TOKEN.findall(content):
            first = token[:1]
            if first == b"%":
                continue
            if first in b"(<[/]>" or first in b"+-.0123456789":
                operands.append(token)
                continue
            op = token.decode("latin-1")
            number = [float(x) for x in operands if x[:1] in b"+-.0123456789"]
            if op == "q":
                stack.append(ctm)
            elif op == "Q" and stack:
                ctm = stack.pop()
            elif op == "cm" and len(number) == 6:
                ctm = times(tuple(number), ctm)
            elif op == "BT":
                tm = line = UNIT
            elif op == "Tf" and number:
                size = number[-1]
                widths = self._widths(fonts.get(operands[-2][1:], b"")) if len(operands) > 1 else {}
            elif op in ("Td", "TD") and len(number) == 2:
                leading = -number[1] if op == "TD" else leading
                tm = line = times((1, 0, 0, 1, *number), line)
            elif op == "Tm" and len(number) == 6:
                tm = line = tuple(number)
            elif op == "T*":
                tm = line = times((1, 0, 0, 1, 0, -leading), line)
            elif op in ("TL", "Tc", "Tw", "Ts", "Tz") and number:
                leading, gap, space, rise, scale = {"TL": (number[0], gap, space, rise, scale), "Tc": (leading, number[0], space, rise, scale), "Tw": (leading, gap, number[0], rise, scale), "Ts": (leading, gap, space, number[0], scale), "Tz": (leading, gap, space, rise, number[0] / 100)}[op]
            elif op in ("Tj", "TJ", "'", '"'):
                if op in "'\"":
                    tm = line = times((1, 0, 0, 1, 0, -leading), line)
                at, shown = 0.0, []
                for x in operands:
                    if x[:1] in b"(<" and x != b"<<":
                        for c in _string(x):
                            w = (widths.get(ord(c), WIDTHS[ord(c) - 32] if 32 <= ord(c) < 127 else 556) / 1000 * size + gap + (space if c == " " else 0)) * scale
                            shown.append((c, at, w))
                            at += w
                    elif op == "TJ" and x[:1] in b"+-.0123456789":
                        at -= float(x) / 1000 * size * scale
                yield "text", shown, times((1, 0, 0, 1, 0, rise), times(tm, ctm)) + (size,)
                tm = times((1, 0, 0, 1, at, 0), tm)
            elif op == "Do" and operands:
                yield "image", operands[-1][1:], ctm
            operands = []

    @staticmethod
    def _widths(font: bytes) -> dict[int, float]:
        first, listed = re.search(rb"/FirstChar\s+(\d+)", font), re.search(rb"/Widths\s*\[([^\]]*)\]", font)
        return {int(first[1]) + k: float(w) for k, w in enumerate(listed[1].split())} if first and listed else {}


def content_hash(data: bytes) -> int:
    """64 bits that are only ever compared for equality."""
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "big")


_ALONE = set(string.punctuation) - set("'-")


def place(shown: list[tuple[str, float, float]], matrix: tuple, x0: float, y0: float, height: float) -> Run | None:
    """A run with word fragments; a mark other than ' and - is a fragment of its own."""
    *m, size = matrix
    sx, sy = abs(m[0]) or 1.0, abs(m[3]) or 1.0
    top, tall = height - (m[5] - y0) - size * sy * 0.75, size * sy
    groups: list[list] = []
    last = " "
    for c, at, w in shown:
        if not words.SPACES.match(c):
            box = Box(m[4] - x0 + at * sx, top, w * sx, tall)
            if not groups or words.SPACES.match(last) or c in _ALONE or last in _ALONE:
                groups.append([c, box])
            else:
                groups[-1] = [groups[-1][0] + c, boxes.union(groups[-1][1], box)]
        last = c
    text = words.squeeze("".join(c for c, _, _ in shown))
    if not text:
        return None
    return Run(text, boxes.around(b for _, b in groups), tuple(Fragment(t, b) for t, b in groups))


BOX = "struct<x:double,y:double,width:double,height:double>"
PAGES = (
    f"path string, revision_id string, page_index int, width double, height double, replaced int, error string, message string,"
    f"runs array<struct<text:string,bounds:{BOX},fragments:array<struct<text:string,bounds:{BOX}>>>>, figures array<struct<bounds:{BOX},content_hash:string>>"
)


def page_structs(data: bytes, limits: Limits) -> dict:
    """A file's pages as structs, or its error and message."""
    box = lambda b: {"x": b.x, "y": b.y, "width": b.width, "height": b.height}
    try:
        r = Reader(data)
        if limits.pages is not None and len(r.pages) > limits.pages:
            raise ComparisonError("page-limit-exceeded", f"{len(r.pages)} pages")
        pages = []
        for k in range(len(r.pages)):
            w, h, runs, figures, bad = r.page(k)
            shown = [{"text": x.text, "bounds": box(x.box), "fragments": [{"text": f.text, "bounds": box(f.box)} for f in x.fragments]} for x in runs]
            pages.append({"page_index": k, "width": w, "height": h, "replaced": bad, "runs": shown, "figures": [{"bounds": box(b), "content_hash": f"{c:016x}"} for b, c in figures]})
        return {"pages": pages}
    except ComparisonError as e:
        return {"error": e.code, "message": str(e)}
    except (ValueError, zlib.error, IndexError, RecursionError) as e:
        return {"error": "text-extraction", "message": words.short_error(str(e))}


def _rows(path: str, data: bytes, limits: Limits) -> Iterator[dict]:
    own = {"path": path, "revision_id": re.sub(r"\.[^./]*$", "", path.rsplit("/", 1)[-1]) or path}
    found = page_structs(data, limits)
    if "pages" not in found:
        yield own | found
    for page in found.get("pages", ()):
        yield own | page


def read_pdf(spark: SparkSession, path: str, limits: Limits = Limits()) -> DataFrame:
    """One row per page of every file under ``path``; files that fail give one row with a code."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(PAGES))
    files = spark.read.format("binaryFile").load(path)
    large = F.lit(False) if limits.input_bytes is None else F.col("length") > limits.input_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, data, over in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                rows = [{"path": p, "revision_id": p, "error": "input-too-large", "message": p}] if over else list(_rows(p, data.as_py(), limits))
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("path", F.when(~large, F.col("content")).alias("content"), large.alias("large")).mapInArrow(run, PAGES)
