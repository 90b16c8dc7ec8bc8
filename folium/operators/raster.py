"""Raster comparison: fingerprints, alignment, changed pixels, regions, previews. Images are (height, width, 4) bytes."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

import numpy as np

from .. import limits
from .pages import Fingerprint, ink


@dataclass(frozen=True)
class Options:
    channel_tolerance: int = 8
    changed_pixel_ratio: float = 0.0002
    max_shift: int = 8
    sample_step: int = 8
    min_region_area: int = 12


@dataclass
class Alignment:
    dx: int = 0
    dy: int = 0
    confidence: float = 1.0


@dataclass
class Region:
    id: str
    x: int
    y: int
    width: int
    height: int
    changed: int
    before_content: int
    after_content: int


@dataclass
class RasterDiff:
    equal: bool
    width: int
    height: int
    changed: int
    ratio: float
    alignment: Alignment
    regions: list[Region] = field(default_factory=list)
    preview: np.ndarray | None = None


def fingerprint(image: np.ndarray, side: int = limits.FINGERPRINT_SIDE) -> Fingerprint:
    """side x side point samples; an image without pixels is white."""
    h, w = image.shape[:2]
    if not h or not w:
        return Fingerprint(w, h, np.full((side * side, 3), 255, np.uint8))
    k = np.arange(side)
    return Fingerprint(w, h, image[(k * h // side)[:, None], k * w // side, :3].reshape(-1, 3))


def on_canvas(image: np.ndarray, width: int, height: int, dx: int = 0, dy: int = 0) -> np.ndarray:
    """The canvas pixel (x, y) shows the image's (x + dx, y + dy), white where there is none."""
    out = np.full((height, width, 4), 255, np.uint8)
    h, w = image.shape[:2]
    x0, x1, y0, y1 = max(0, -dx), min(width, w - dx), max(0, -dy), min(height, h - dy)
    if x0 < x1 and y0 < y1:
        out[y0:y1, x0:x1] = image[y0 + dy : y1 + dy, x0 + dx : x1 + dx]
    return out


def changed(a: np.ndarray, b: np.ndarray, tolerance: int) -> np.ndarray:
    return (np.abs(a.astype(np.int16) - b) > tolerance).any(-1)


def align(before: np.ndarray, after: np.ndarray, width: int, height: int, o: Options) -> Alignment:
    """The shift with the fewest sampled mismatches; ties go to the smaller shift, then dy, then dx."""
    s, step = o.max_shift, o.sample_step
    old = on_canvas(before, width, height)[::step, ::step].astype(np.int16)
    wide = on_canvas(after, width + 2 * s, height + 2 * s, -s, -s)  # white around: every shift is a view
    scores = {}
    for dy in range(-s, s + 1):
        for dx in range(-s, s + 1):
            new = wide[s + dy : s + dy + height : step, s + dx : s + dx + width : step]
            scores[dx, dy] = int((np.abs(old - new) > o.channel_tolerance).any(-1).sum())
    (dx, dy), best = min(scores.items(), key=lambda x: (x[1], abs(x[0][0]) + abs(x[0][1]), x[0][1], x[0][0]))
    worst = max(scores.values())
    return Alignment(dx, dy, 1.0 if not old.size or not worst else float(np.clip(1 - best / worst, 0, 1)))


def labelled(mask: np.ndarray) -> np.ndarray:
    """8-connected components: every changed pixel gets its component's first pixel in row-major order; others -1."""
    h, w = mask.shape
    label = np.where(mask, np.arange(h * w).reshape(h, w), h * w)
    while True:  # minima spread along rows and columns in both directions, then to diagonal neighbours
        before = label.copy()
        padded = np.pad(label, 1, constant_values=h * w)
        for dy in (0, 1, 2):
            for dx in (0, 1, 2):
                np.minimum(label, padded[dy : dy + h, dx : dx + w], out=label, where=mask)
        roots = np.append(label.ravel(), h * w)
        jump = roots[roots]
        while (jump != roots).any():  # jump to the root's root
            roots, jump = jump, jump[jump]
        label = roots[:-1].reshape(h, w)
        if (label == before).all():
            return np.where(mask, label, -1)


def regions(mask: np.ndarray, before_ink: np.ndarray, after_ink: np.ndarray, least: int) -> list[Region]:
    """Components of at least ``least`` pixels, numbered by their first pixel."""
    label = labelled(mask)
    ys, xs = np.nonzero(label >= 0)
    roots, k = np.unique(label[ys, xs], return_inverse=True)
    out = []
    area = np.bincount(k, minlength=len(roots))
    content = [np.bincount(k, i[ys, xs], minlength=len(roots)).astype(int) for i in (before_ink, after_ink)]
    low_x, low_y = np.full(len(roots), 1 << 30), np.full(len(roots), 1 << 30)
    high_x, high_y = np.full(len(roots), -1), np.full(len(roots), -1)
    for at, low, high in ((xs, low_x, high_x), (ys, low_y, high_y)):
        np.minimum.at(low, k, at)
        np.maximum.at(high, k, at)
    for r in range(len(roots)):
        if area[r] >= least:
            box = (int(low_x[r]), int(low_y[r]), int(high_x[r] - low_x[r] + 1), int(high_y[r] - low_y[r] + 1))
            out.append(Region(f"region-{len(out) + 1}", *box, int(area[r]), int(content[0][r]), int(content[1][r])))
    return out


def compare(before: np.ndarray, after: np.ndarray, o: Options = Options(), preview: bool = False) -> RasterDiff:
    """Align, mark changed pixels, gather regions; a few changed pixels still count as equal."""
    height, width = max(before.shape[0], after.shape[0]), max(before.shape[1], after.shape[1])
    a = align(before, after, width, height, o)
    old, new = on_canvas(before, width, height), on_canvas(after, width, height, a.dx, a.dy)
    mask = changed(old, new, o.channel_tolerance)
    n = int(mask.sum())
    ratio = n / mask.size if mask.size else 0.0
    found = regions(mask, ink(old), ink(new), o.min_region_area) if n else []
    return RasterDiff(ratio <= o.changed_pixel_ratio, width, height, n, ratio, a, found, faded(old, mask) if preview else None)


def faded(image: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Changed pixels in red on a faded page; white if nothing changed."""
    if not mask.any():
        return np.full(image.shape, 255, np.uint8)
    out = (image // 3 + 170).astype(np.uint8)
    out[..., 3] = 255
    out[mask] = (235, 45, 55, 255)
    return out


def png(image: np.ndarray) -> bytes:
    """A PNG file of an RGBA image."""
    h, w = image.shape[:2]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = np.concatenate([np.zeros((h, 1), np.uint8), image.reshape(h, -1)], 1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
