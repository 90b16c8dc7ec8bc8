"""Media columns: payloads stored as progressive JPEG, read back scan by scan.

Reading. A progressive file spreads each coefficient over scans: bands of the spectrum (spectral selection) and bit
planes (successive approximation). ``decode`` accumulates all scans into one coefficient array per component, for any
progressive Huffman file with up to four components: interleaved or single DC scans, AC bands with end-of-band runs,
refinements and restart intervals. ``rgb`` dequantises, inverse-transforms in numpy, upsamples chroma and gives a
full-resolution RGB tensor. All arithmetic is on whole numbers, so equal files give equal tensors on any machine.

Where a scan's Huffman table gives every symbol the same number of bits together with its extra bits, symbols stand at
fixed strides and the whole scan is decoded by array operations; other scans are decoded symbol by symbol.

Writing. The format's unit is the coefficient: payload byte b becomes the AC coefficient of eight bits whose extra bits
are b (b from 128 on, b - 255 below) or the DC coefficient b - 128, 64 bytes a block, luma blocks first, in 4:2:0.
Six kinds of scans write them: DC without its last bit, two AC bands without theirs, then the last bits of DC and AC.
Huffman tables are chosen so that all strides are fixed. Blocks beyond the payload hold byte 32; a comment has its length.

Edge cases: null and empty texts are 192 spaces; equal texts give equal files; the largest payload has about 6 GB; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes

UNIT = 192
PAD = 32


@lru_cache(1)
def zigzag() -> np.ndarray:
    """Natural place (row * 8 + column) of each coefficient in file order."""
    return np.array(sorted(range(64), key=lambda n: (sum(divmod(n, 8)), n // 8 if sum(divmod(n, 8)) % 2 else n % 8)))


# --- Huffman tables ---------------------------------------------------------------------------------------------------


@dataclass
class Table:
    """Canonical codes: ``symbols`` in order, ``lengths`` of their codes."""

    symbols: list[int]
    lengths: list[int]

    def segment(self, kind: int, number: int) -> bytes:
        counts = bytes(self.lengths.count(n) for n in range(1, 17))
        body = bytes([kind << 4 | number]) + counts + bytes(self.symbols)
        return b"\xff\xc4" + struct.pack(">H", 2 + len(body)) + body

    def codes(self) -> list[int]:
        out, code, last = [], 0, 0
        for n in self.lengths:
            code <<= n - last
            out.append(code)
            code, last = code + 1, n
        return out

    def by_code(self) -> dict[tuple[int, int], int]:
        return {(n, c): s for n, c, s in zip(self.lengths, self.codes(), self.symbols, strict=True)}

    def stride(self) -> int:
        """Bits of every symbol with its extra bits, if all agree and no symbol skips coefficients; else 0."""
        if any(s >> 4 or s > 15 for s in self.symbols):
            return 0
        total = {n + s for n, s in zip(self.lengths, self.symbols, strict=True)}
        return total.pop() if len(total) == 1 and max(total | {0}) <= 16 else 0

    def values(self, stride: int) -> np.ndarray:
        """The number that each pattern of ``stride`` bits means; out of range: no code."""
        return _values(tuple(self.symbols), tuple(self.lengths), stride)

    def _pattern_values(self, stride: int) -> np.ndarray:
        out = np.full(1 << stride, 1 << 20, np.int32)
        for n, c, s in zip(self.lengths, self.codes(), self.symbols, strict=True):
            extra = np.arange(1 << s)
            out[(c << s) + extra] = np.where(extra >= (1 << s >> 1), extra, extra - (1 << s) + 1) if s else 0
        return out


@lru_cache(64)
def _values(symbols: tuple[int, ...], lengths: tuple[int, ...], stride: int) -> np.ndarray:
    return Table(list(symbols), list(lengths))._pattern_values(stride)


DC_TABLE = Table([7, 6, 5, 4, 3, 2, 1, 0], [1, 2, 3, 4, 5, 6, 7, 8])
AC_TABLE = Table([7], [1])
END_TABLE = Table([0], [1])
BANDS = ((1, 5), (6, 63))


# --- writing ---------------------------------------------------------------------------------------------------------


def _stuff(bits: np.ndarray) -> bytes:
    pad = -len(bits) % 8
    return np.packbits(np.concatenate([bits, np.ones(pad, np.uint8)]) if pad else bits).tobytes().replace(b"\xff", b"\xff\x00")


def _scan(components: list[tuple[int, int]], band: tuple[int, int], high: int, low: int, data: bytes) -> bytes:
    body = bytes([len(components)]) + b"".join(bytes(c) for c in components) + bytes([*band, high << 4 | low])
    return b"\xff\xda" + struct.pack(">H", 2 + len(body)) + body + data


def _dc_codes() -> np.ndarray:
    """The eight bits that mean each difference from -127 to 127."""
    of = {int(v): k for k, v in enumerate(DC_TABLE.values(8)) if v < 1 << 20}
    return np.array([of[d] for d in range(-127, 128)], np.uint8)


_DC_CODES = _dc_codes()


def encode(payload: bytes) -> bytes:
    """A progressive 4:2:0 JPEG that holds the payload in its coefficients."""
    units = max(1, -(-len(payload) // 384))
    wide = max(math.ceil(math.sqrt(units)), -(-units // 4095))
    tall = -(-units // wide)
    n = wide * tall
    data = np.full(n * 384, PAD, np.uint8)
    data[: len(payload)] = np.frombuffer(payload, np.uint8)
    blocks = data.reshape(-1, 64)
    planes = (blocks[: 4 * n], blocks[4 * n : 5 * n], blocks[5 * n :])
    # luma blocks in raster order of the block grid, and in the order of interleaved units
    grid = np.arange(4 * n).reshape(tall, 2, wide, 2).transpose(0, 2, 1, 3).reshape(n, 4)
    dc = [p[:, 0].astype(np.int32) - 128 for p in planes]
    units_dc = np.concatenate([dc[0][grid], dc[1][:, None], dc[2][:, None]], 1)
    half = units_dc >> 1
    steps = np.concatenate([np.diff(half[:, :4].ravel(), prepend=0).reshape(n, 4), np.diff(half[:, 4], prepend=0)[:, None], np.diff(half[:, 5], prepend=0)[:, None]], 1)
    out = [
        b"\xff\xd8\xff\xe0\x00\x10JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00",
        b"\xff\xfe" + struct.pack(">HQ", 10, len(payload)),
        b"\xff\xdb\x00\x43\x00" + b"\x01" * 64,
        b"\xff\xc2" + struct.pack(">HBHHB", 17, 8, tall * 16, wide * 16, 3) + b"\x01\x22\x00\x02\x11\x00\x03\x11\x00",
        DC_TABLE.segment(0, 0) + AC_TABLE.segment(1, 0) + END_TABLE.segment(1, 1),
        _scan([(1, 0), (2, 0), (3, 0)], (0, 0), 0, 1, _DC_CODES[steps.ravel() + 127].tobytes()),
    ]
    for c, p in enumerate(planes, 1):
        for a, b in BANDS:
            out.append(_scan([(c, 0)], (a, b), 0, 1, (p[:, a : b + 1] >> 1).tobytes()))  # code 0, then seven extra bits
    out.append(_scan([(1, 0), (2, 0), (3, 0)], (0, 0), 1, 0, _stuff((units_dc & 1).astype(np.uint8).ravel())))
    for c, p in enumerate(planes, 1):
        bits = np.zeros((len(p), 64), np.uint8)  # code 0: the band has ended, then a correction for each coefficient
        bits[:, 1:] = (p[:, 1:] & 1) ^ (p[:, 1:] < 128)
        out.append(_scan([(c, 1)], (1, 63), 1, 0, _stuff(bits.ravel())))
    return b"".join(out) + b"\xff\xd9"


# --- reading ---------------------------------------------------------------------------------------------------------


@dataclass
class Component:
    number: int
    h: int
    v: int
    quant: int
    wide: int = 0  # blocks with padding to whole units
    tall: int = 0
    own_wide: int = 0  # blocks of a scan of its own
    own_tall: int = 0
    blocks: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), np.int32))


@dataclass
class Image:
    width: int
    height: int
    components: list[Component]
    quants: dict[int, np.ndarray]
    comment: bytes = b""


class _Bits:
    """One restart interval's bits, read one after another; zeros follow the end."""

    def __init__(self, data: bytes):
        self.bits, self.at = np.unpackbits(np.frombuffer(data, np.uint8)).tolist(), 0

    def one(self) -> int:
        self.at += 1
        return self.bits[self.at - 1] if self.at <= len(self.bits) else 0

    def some(self, n: int) -> int:
        out = 0
        for _ in range(n):
            out = out << 1 | self.one()
        return out

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.one()
            if (n, code) in codes:
                return codes[n, code]
        raise ValueError("no such Huffman code")

    def signed(self, n: int) -> int:
        x = self.some(n)
        return x if not n or x >> n - 1 else x - (1 << n) + 1


_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7]")


def _entropy_end(data: bytes, at: int) -> int:
    """Where the scan's data end: the next marker that is no stuffing and no restart."""
    return _MARKER.search(data, at).start()


def decode(data: bytes) -> Image:
    """Accumulate all scans of a progressive file into coefficients, in file order of each block."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    image, tables, quants, restart, comment, at = None, {}, {}, 0, b"", 2
    while True:
        while data[at + 1] == 0xFF:
            at += 1
        marker = data[at + 1]
        if marker == 0xD9:
            break
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide, n = body[0] >> 4, 64 * (1 + (body[0] >> 4))
                quants[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                counts, n = body[1:17], sum(body[1:17])
                tables[body[0]] = Table(list(body[17 : 17 + n]), [k for k, c in enumerate(counts, 1) for _ in range(c)])
                body = body[17 + n :]
        elif marker == 0xC2:
            _, height, width, n = struct.unpack(">BHHB", body[:6])
            parts = [Component(c, f >> 4, f & 15, q) for c, f, q in struct.iter_unpack("BBB", body[6 : 6 + 3 * n])]
            mh, mv = max(p.h for p in parts), max(p.v for p in parts)
            units_wide, units_tall = -(-width // (8 * mh)), -(-height // (8 * mv))
            for p in parts:
                p.wide, p.tall = units_wide * p.h, units_tall * p.v
                p.own_wide, p.own_tall = -(-(-(-width * p.h // mh)) // 8), -(-(-(-height * p.v // mv)) // 8)
                p.blocks = np.zeros((p.wide * p.tall, 64), np.int32)
            image = Image(width, height, parts, quants)
        elif marker in (0xC0, 0xC1, 0xC3) or 0xC5 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("not a progressive Huffman file")
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xFE:
            comment = body
        elif marker == 0xDA:
            if image is None:
                raise ValueError("a scan without a frame")
            end = _entropy_end(data, at)
            _read_scan(image, tables, body, data[at:end], restart)
            at = end
    if image is None:
        raise ValueError("no frame")
    image.comment = comment
    return image


def _order(image: Image, parts: list[Component]) -> tuple[list[np.ndarray], int]:
    """Block numbers of each component, one row per unit of the scan; units."""
    if len(parts) == 1:
        p = parts[0]
        rows = (np.arange(p.own_tall)[:, None] * p.wide + np.arange(p.own_wide)).reshape(-1, 1)
        return [rows], len(rows)
    wide, tall = parts[0].wide // parts[0].h, parts[0].tall // parts[0].v
    return [np.arange(p.wide * p.tall).reshape(tall, p.v, wide, p.h).transpose(0, 2, 1, 3).reshape(wide * tall, -1) for p in parts], wide * tall


def _read_scan(image: Image, tables: dict[int, Table], head: bytes, data: bytes, restart: int) -> None:
    n = head[0]
    chosen = [(next(p for p in image.components if p.number == head[1 + 2 * k]), head[2 + 2 * k]) for k in range(n)]
    first, last, bits = head[1 + 2 * n : 4 + 2 * n]
    high, low = bits >> 4, bits & 15
    order, units = _order(image, [p for p, _ in chosen])
    if not restart and _read_strided(chosen, tables, order, first, last, high, low, data):
        return
    pieces, at = [], 0
    while (m := _next_restart(data, at)) >= 0:
        pieces.append(data[at:m])
        at = m + 2
    pieces.append(data[at:])
    step = restart or units
    for k, piece in enumerate(pieces):
        reader = _Bits(piece.replace(b"\xff\x00", b"\xff"))
        rows = range(k * step, min(units, (k + 1) * step))
        if first == 0:
            _dc(chosen, tables, order, rows, high, low, reader)
        else:
            _ac(chosen[0][0].blocks, order[0][rows.start : rows.stop, 0], tables[16 | chosen[0][1] & 15], first, last, high, low, reader)


def _next_restart(data: bytes, at: int) -> int:
    while (at := data.find(b"\xff", at)) >= 0:
        if at + 1 < len(data) and 0xD0 <= data[at + 1] <= 0xD7:
            return at
        at += 2
    return -1


def _read_strided(chosen: list, tables: dict[int, Table], order: list[np.ndarray], first: int, last: int, high: int, low: int, data: bytes) -> bool:
    """Decode the scan by array operations if its symbols stand at fixed strides."""
    data = data.replace(b"\xff\x00", b"\xff")
    per = [o.shape[1] for o in order]
    if first == 0 and high:
        bits = np.unpackbits(np.frombuffer(data, np.uint8), count=sum(o.size for o in order)).reshape(-1, sum(per))
        for (p, _), o, b in zip(chosen, order, np.split(bits, np.cumsum(per)[:-1], axis=1), strict=True):
            p.blocks[o.ravel(), 0] |= b.ravel().astype(np.int32) << low
        return True
    if first == 0:
        using = {t >> 4 for _, t in chosen}
        table = tables[using.pop()] if len(using) == 1 else None
        if table is None or not (stride := table.stride()):
            return False
        steps = _strides(data, stride, sum(o.size for o in order), table).reshape(-1, sum(per))
        for (p, _), o, s in zip(chosen, order, np.split(steps, np.cumsum(per)[:-1], axis=1), strict=True):
            p.blocks[o.ravel(), 0] = np.cumsum(s.ravel()) << low
        return True
    (part, t), rows, band = chosen[0], order[0][:, 0], last - first + 1
    table = tables[16 | t & 15]
    if not high:
        if 0 in table.symbols or not (stride := table.stride()):
            return False
        part.blocks[rows, first : last + 1] = _strides(data, stride, len(rows) * band, table).reshape(-1, band) << low
        return True
    if table.symbols != [0]:
        return False
    now = part.blocks[rows, first : last + 1]
    if not now.all():
        return False
    n = table.lengths[0]
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=len(rows) * (n + band)).reshape(len(rows), n + band)[:, n:]
    part.blocks[rows, first : last + 1] = now + np.where(now > 0, bits, -bits.astype(np.int32)) * (1 << low)
    return True


def _strides(data: bytes, stride: int, n: int, table: Table) -> np.ndarray:
    if stride == 8:
        patterns = np.frombuffer(data, np.uint8, n)
    else:
        bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * stride).reshape(n, stride)
        patterns = bits @ (1 << np.arange(stride)[::-1])
    out = table.values(stride)[patterns]
    if n and out.max() == 1 << 20:
        raise ValueError("no such Huffman code")
    return out


def _dc(chosen: list, tables: dict[int, Table], order: list[np.ndarray], rows: range, high: int, low: int, reader: _Bits) -> None:
    codes = [tables[t >> 4].by_code() if not high else {} for _, t in chosen]
    before = [0] * len(chosen)
    for u in rows:
        for k, (p, _) in enumerate(chosen):
            for block in order[k][u]:
                if high:
                    p.blocks[block, 0] |= reader.one() << low
                else:
                    before[k] += reader.signed(reader.symbol(codes[k]))
                    p.blocks[block, 0] = before[k] << low


def _ac(blocks: np.ndarray, rows: np.ndarray, table: Table, first: int, last: int, high: int, low: int, reader: _Bits) -> None:
    codes, ended, unit = table.by_code(), 0, 1 << low
    for row in rows:
        b, k = blocks[row], first
        while k <= last and not ended:
            symbol = reader.symbol(codes)
            run, size = symbol >> 4, symbol & 15
            if not size and run < 15:
                ended = (1 << run) + reader.some(run)
                break
            new = 0
            if size:
                new = (reader.signed(size) if not high else (1 if reader.one() else -1)) * unit
            while k <= last:  # pass ``run`` zero coefficients, correcting those known before
                if high and b[k]:
                    if reader.one():
                        b[k] += unit if b[k] > 0 else -unit
                elif run:
                    run -= 1
                else:
                    break
                k += 1
            if k <= last:
                if new:
                    b[k] = new
                k += 1
        if ended:
            if high:
                for j in range(k, last + 1):
                    if b[j] and reader.one():
                        b[j] += unit if b[j] > 0 else -unit
            ended -= 1


@lru_cache(1)
def _basis() -> np.ndarray:
    """64 x 64 inverse transform in 8192ths, from file order to pixels; whole numbers, exact in doubles."""
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    a = np.cos((2 * x + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)
    return np.round(np.einsum("ux,vy->uvxy", a, a).reshape(64, 64)[zigzag()] * 8192)


def plane(p: Component, quant: np.ndarray) -> np.ndarray:
    """Samples 0 to 255 of one component at its own resolution."""
    exact = (p.blocks * quant).astype(np.float64) @ _basis()
    pixels = np.clip((exact.astype(np.int64) + 4096 >> 13) + 128, 0, 255).astype(np.uint8)
    return pixels.reshape(p.tall, p.wide, 8, 8).transpose(0, 2, 1, 3).reshape(p.tall * 8, p.wide * 8)


def rgb(image: Image) -> np.ndarray:
    """The full-resolution tensor (height, width, 3); chroma samples are repeated; one component is grey."""
    mh, mv = max(p.h for p in image.components), max(p.v for p in image.components)
    full = []
    for p in image.components[:3]:
        x = plane(p, image.quants[p.quant])
        full.append(np.repeat(np.repeat(x, mv // p.v, 0), mh // p.h, 1)[: image.height, : image.width])
    if len(full) < 3:
        return np.repeat(full[0][:, :, None], 3, 2)
    y, cb, cr = full[0].astype(np.int32), full[1].astype(np.int32) - 128, full[2].astype(np.int32) - 128
    y = (y << 16) + 32768
    out = np.empty((*y.shape, 3), np.uint8)
    for k, x in enumerate((y + 91881 * cr, y - 22554 * cb - 46802 * cr, y + 116130 * cb)):
        out[:, :, k] = np.clip(x >> 16, 0, 255)
    return out


def payload_of(image: Image) -> bytes:
    """What ``encode`` was given, from the coefficients and the comment's length."""
    blocks = np.concatenate([p.blocks for p in image.components])
    data = np.where(blocks > 0, blocks, blocks + 255).astype(np.uint8)
    data[:, 0] = blocks[:, 0] + 128
    return data.tobytes()[: struct.unpack(">Q", image.comment)[0]]


def pad(text: bytes) -> bytes:
    size = max(UNIT, -(-len(text) // UNIT) * UNIT)
    return text + bytes([PAD]) * (size - len(text))


def features(tensor: np.ndarray) -> str:
    """Size, mean of each channel in hundredths, and the mean step between neighbours, as whole numbers."""
    h, w, _ = tensor.shape
    means = tensor.reshape(-1, 3).sum(0, dtype=np.int64) * 100 // (h * w)
    green = tensor[:, :, 1].astype(np.int16)
    step = int(np.abs(np.diff(green, axis=1)).sum(dtype=np.int64)) * 100 // (h * max(w - 1, 1))
    return f"{w}x{h} rgb {means[0]} {means[1]} {means[2]} step {step}"


def store(docs: DataFrame) -> DataFrame:
    """doc_id and media: each whole text as a stored file."""

    def run(text: pa.Array) -> pa.Array:
        return pa.array([encode(pad(x.as_py() or b"")) for x in text], pa.binary())

    return docs.select("doc_id", F.arrow_udf(run, "binary")(text_bytes()).alias("media"), F.octet_length(text_bytes()).cast("long").alias("n_bytes"))


def tensors(media: DataFrame, column: str = "media") -> DataFrame:
    """All columns and rgb struct<height, width, data>: the full-resolution tensor of each file, row by row."""
    kind = "struct<height:int,width:int,data:binary>"

    def run(files: pa.Array) -> pa.Array:
        rows = []
        for f in files:
            t = rgb(decode(f.as_py())) if f.is_valid else None
            rows.append(None if t is None else {"height": t.shape[0], "width": t.shape[1], "data": t.tobytes()})
        return pa.array(rows, pa.struct([("height", pa.int32()), ("width", pa.int32()), ("data", pa.binary())]))

    return media.withColumn("rgb", F.arrow_udf(run, kind)(F.col(column)))


DIGEST = pa.struct([("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("tensor_sha256", pa.string())])


def _digests(files: pa.Array) -> pa.Array:
    rows = []
    for f in files:
        data = f.as_py()
        image = decode(data)
        payload, tensor = payload_of(image), rgb(image)
        rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), features(tensor), *tensor.shape[:2], hashlib.sha256(tensor.tobytes()).hexdigest()))
    return pa.array([dict(zip([x.name for x in DIGEST], r, strict=True)) for r in rows], DIGEST)


def media_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and what is read back from each stored file: its payload, and its tensor as ``tensors`` stores it."""
    kind = "struct<payload_bytes:long,payload_sha256:string,tail_crc32:long,media_bytes:long,media_sha256:string,feature:string,height:int,width:int,tensor_sha256:string>"
    read = store(docs).select("doc_id", "n_bytes", F.arrow_udf(_digests, kind)("media").alias("d"))
    return read.select("doc_id", "n_bytes", "d.*")
