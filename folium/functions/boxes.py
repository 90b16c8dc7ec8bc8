"""Rectangles: (x, y, width, height), y downwards."""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import reduce
from typing import NamedTuple

from .. import limits


class Box(NamedTuple):
    x: float
    y: float
    width: float
    height: float

    @property
    def right(self) -> float:
        return self.x + self.width

    @property
    def bottom(self) -> float:
        return self.y + self.height

    @property
    def cx(self) -> float:
        return self.x + self.width / 2

    @property
    def cy(self) -> float:
        return self.y + self.height / 2

    @property
    def area(self) -> float:
        return self.width * self.height


def union(a: Box, b: Box) -> Box:
    x, y = min(a.x, b.x), min(a.y, b.y)
    return Box(x, y, max(a.right, b.right) - x, max(a.bottom, b.bottom) - y)


def around(boxes: Iterable[Box]) -> Box | None:
    boxes = list(boxes)
    return reduce(union, boxes) if boxes else None


def distance(a: Box, b: Box) -> float:
    return math.hypot(a.cx - b.cx, a.cy - b.cy)


def overlap(a: Box, b: Box) -> float:
    """Area of the intersection."""
    return max(min(a.right, b.right) - max(a.x, b.x), 0) * max(min(a.bottom, b.bottom) - max(a.y, b.y), 0)


def overlap_share(a: Box, b: Box) -> float:
    """Intersection over the smaller area."""
    least = min(a.area, b.area)
    return overlap(a, b) / least if least > 0 else 0.0


def positional(a: Box, b: Box) -> bool:
    """Intersecting boxes match from an IoU of 0.12, disjoint ones within 1.5 of the largest dimension."""
    shared = overlap(a, b)
    if shared > 0:
        return shared / (a.area + b.area - shared) >= 0.12
    return distance(a, b) <= 1.5 * max(a.width, a.height, b.width, b.height)


def same_line(a: Box, b: Box) -> bool:
    """Enough vertical overlap, or close centres; and no wide horizontal gap."""
    least = max(min(a.height, b.height), 1.0)
    shared = max(min(a.bottom, b.bottom) - max(a.y, b.y), 0.0)
    if shared / least < 0.35 and abs(a.cy - b.cy) > 0.7 * least:
        return False
    return max(a.x - b.right, b.x - a.right, 0.0) <= max(8 * least, 32.0)


def close(a: Box, b: Box) -> bool:
    return all(abs(p - q) <= limits.POSITION_TOLERANCE for p, q in zip(a, b, strict=True))


def edge_role(box: Box, page_height: float) -> str | None:
    """header in the top band only, footer in the bottom band only."""
    if page_height <= 0 or box.height <= 0:
        return None
    band = min(max(page_height * limits.ROLE_BAND, limits.ROLE_LEAST_BAND), page_height * limits.ROLE_MOST_BAND)
    top, bottom = box.y <= band, box.bottom >= page_height - band
    return None if top == bottom else "header" if top else "footer"


def slot_score(a: Box, b: Box) -> float | None:
    """How likely two figures fill the same slot; None below the bounds."""
    if a.area <= 0 or b.area <= 0:
        return None
    share, apart = overlap_share(a, b), distance(a, b)
    if share < 0.2 and apart > 64:
        return None
    score = 0.65 * share + 0.2 * min(a.area, b.area) / max(a.area, b.area) + 0.15 * max(0.0, 1 - apart / 64)
    return score if score >= 0.3 else None
