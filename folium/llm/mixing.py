"""Mixing sources to target weights by Pfair scheduling.

Each source's rows form blocks of BLOCK rows. With weight w its j-th block (from 0) is released in slot floor(j / w)
and due by slot ceil((j + 1) / w); in every slot the released block with the earliest deadline runs. As the weights
sum to 1 this meets all deadlines, and after any number of slots a source is less than one block away from its share.

Weights are exact fractions, so this holds for the target weights over any length. When a source runs out, the others
share its weight: windows are those of the fluid schedule in which that happens. Slots are simulated in ranges of
RANGE, each a task of its own, since the state at a range's start follows from the windows around it. No row is dropped
or repeated: the operator decides the order. Sources are those of the table, in any number; their names and
counts are the only thing that reaches the driver.

Edge cases: a null source is a source of its own; a source without a target weight gets the smallest given one; rows
that are equal keep one position each; an empty table gives an empty result; clashing columns are left as they are.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, free_name
from .ranks import ranked, salts_for

BLOCK = 16
GRID = 1000
#: Slots that one task simulates, and slots that are looked back over at a time.
RANGE, SCAN = 32_768, 65_536


def grid_weights(weights: list[Fraction], grid: int = GRID) -> list[int]:
    """Whole parts of ``grid`` in proportion to the weights, at least 1 each, by largest remainders.

    With ``period`` and ``phases`` a schedule by rounded weights; the operator uses ``Schedule``.
    """
    if len(weights) > grid:
        raise ValueError(f"more than {grid} sources")
    total = sum(weights)
    exact = [w * grid / total for w in weights]
    parts = [max(1, int(x)) for x in exact]
    while sum(parts) != grid:
        step = 1 if sum(parts) < grid else -1
        k = max((k for k in range(len(parts)) if step > 0 or parts[k] > 1), key=lambda k: (step * (exact[k] - parts[k]), -k))
        parts[k] += step
    return parts


def period(parts: list[int]) -> list[int]:
    """Which source runs in each of sum(parts) slots: earliest deadline first among released blocks, ties by source."""
    grid = sum(parts)
    waiting: list[tuple[int, int, int]] = [(0, k, 0) for k in range(len(parts))]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []  # deadline, source, block
    out = []
    for slot in range(grid):
        while waiting and waiting[0][0] <= slot:
            _, k, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * grid // parts[k]), k, j))
        _, k, j = heapq.heappop(ready)
        out.append(k)
        if j + 1 < parts[k]:
            heapq.heappush(waiting, ((j + 1) * grid // parts[k], k, j + 1))
    return out


def phases(counts: list[int], weights: list[Fraction], block: int = BLOCK) -> list[dict]:
    """The schedule as phases; in each, source k's blocks from ``first[k]`` run in slots start + period * GRID + ...

    Each phase ends with the last block of the source (or sources) that runs out first.
    """
    left = [-(-c // block) for c in counts]
    done, start, out = [0] * len(counts), 0, []
    while alive := [k for k, n in enumerate(left) if n]:
        table = period(grid_weights([weights[k] for k in alive]))
        places = [[s for s, x in enumerate(table) if x == i] for i in range(len(alive))]
        last = [(left[k] - 1) // len(p) * len(table) + p[(left[k] - 1) % len(p)] for k, p in zip(alive, places, strict=True)]
        end = min(last) + 1
        phase = {"start": start, "grid": len(table), "sources": {}}
        for k, p in zip(alive, places, strict=True):
            ran = end // len(table) * len(p) + sum(s < end % len(table) for s in p)
            if ran:
                phase["sources"][k] = (done[k], done[k] + ran, p)
            done[k], left[k] = done[k] + ran, left[k] - ran
        out.append(phase)
        start += end
    return out


class Schedule:
    """The schedule of any number of sources under exact weights, computable from any slot on.

    Source k has counts[k] blocks. In the fluid schedule all unfinished sources are served at once in proportion to their
    weights; source k is through at time counts[k] / w in the measure in which each gets w a unit. Block j's window is
    that of its fluid service, rounded outwards to slots. Between two ends of sources slots are linear in that measure,
    so windows follow from whole numbers of any length, and nothing is rounded.
    """

    def __init__(self, counts: list[int], weights: list[Fraction]):
        common = math.lcm(*[w.denominator for w in weights])
        self.n, self.w = counts, [int(w * common) for w in weights]
        self.order = sorted(range(len(counts)), key=lambda k: Fraction(counts[k], self.w[k]))
        self.gone, self.rate = [0], [sum(self.w)]  # per stretch: blocks of the sources that have ended, weights of the others
        for k in self.order:
            self.gone.append(self.gone[-1] + counts[k])
            self.rate.append(self.rate[-1] - self.w[k])
        self.rank = {k: i for i, k in enumerate(self.order)}
        self.slots = sum(counts)

    def edge(self, k: int, j: int) -> tuple[int, int]:
        """Floor and ceiling of the slot at which the fluid schedule is through with j blocks of source k."""
        w, low, high = self.w[k], 0, self.rank[k]
        while low < high:
            mid = (low + high) // 2
            i = self.order[mid]
            low, high = (low, mid) if j * self.w[i] <= self.n[i] * w else (mid + 1, high)
        whole, part = divmod(j * self.rate[low], w)
        return self.gone[low] + whole, self.gone[low] + whole + (part > 0)

    def fluid(self, slot: int) -> list[tuple[int, bool]]:
        """Per source: whole blocks served by the fluid schedule before ``slot``, and if a part of the next one is."""
        low, high = 0, len(self.order) - 1
        while low < high:
            mid = (low + high) // 2
            i = self.order[mid]
            low, high = (low, mid) if (slot - self.gone[mid]) * self.w[i] <= self.n[i] * self.rate[mid] else (mid + 1, high)
        out = []
        for k, w in enumerate(self.w):
            whole, part = divmod(w * (slot - self.gone[low]), self.rate[low]) if self.rank[k] >= low else (self.n[k], 0)
            out.append((whole, part > 0))
        return out

    def done(self, slot: int) -> list[int]:
        """Blocks of each source that earliest deadline first has run before ``slot``, without running it from 0.

        Blocks that are due are done; open are those, at most one a source, whose window holds slots on both sides. Among
        the open blocks from some priority downwards as many are done as the blocks above left slots free for:
        the most, over all slots a, of such blocks released before a less E(a), with E(a) = blocks released before a - a.
        """
        at = self.fluid(slot)
        done = [whole for whole, _ in at]
        windows = [(self.edge(k, done[k] + 1)[1], k, self.edge(k, done[k])[0]) for k, (_, part) in enumerate(at) if part]
        if sum(done) == slot:
            return done
        marks = np.unique([r for _, _, r in windows])
        least = self._least_excess(marks.tolist(), slot)
        free, ran = -least, 0
        for _, k, release in sorted(windows, reverse=True):
            free[np.searchsorted(marks, release) :] += 1
            if free.max() > ran:
                ran += 1
                done[k] += 1
        if sum(done) != slot:
            raise RuntimeError("the schedule does not add up")
        return done

    def _least_excess(self, marks: list[int], end: int) -> np.ndarray:
        """The smallest E(a) of a in (marks[i], marks[i + 1]], the last up to ``end``."""
        out, before = np.full(len(marks), np.iinfo(np.int64).max), self._released(marks[0])
        excess = sum(before) - marks[0]
        for a in range(marks[0], end, SCAN):
            b = min(a + SCAN, end)
            after, new = self._released(b), np.zeros(b - a, np.int64)
            for k, (x, y) in enumerate(zip(before, after, strict=True)):
                for j in range(x, y):
                    new[self.edge(k, j)[0] - a] += 1
            e = excess + np.cumsum(new - 1)  # of a + 1, ..., b
            np.minimum.at(out, np.searchsorted(marks, np.arange(a, b), side="right") - 1, e)
            before, excess = after, int(e[-1])
        return out

    def _released(self, slot: int) -> list[int]:
        return [whole + part for whole, part in self.fluid(slot)]

    def run(self, start: int, end: int) -> Iterator[tuple[int, int, int, int]]:
        """(source, block, release, deadline) of slots ``start`` to ``end``; ties of deadlines by source."""
        return self.run_from(self.done(start), start, end)

    def run_from(self, done: list[int], start: int, end: int) -> Iterator[tuple[int, int, int, int]]:
        waiting = [(self.edge(k, j)[0], k, j) for k, j in enumerate(done) if j < self.n[k]]
        heapq.heapify(waiting)
        ready: list[tuple[int, int, int, int, int]] = []  # deadline, source, block, release, next release
        for slot in range(start, min(end, self.slots)):
            while waiting and waiting[0][0] <= slot:
                release, k, j = heapq.heappop(waiting)
                after, deadline = self.edge(k, j + 1)
                heapq.heappush(ready, (deadline, k, j, release, after))
            deadline, k, j, release, after = heapq.heappop(ready)
            yield k, j, release, deadline
            if j + 1 < self.n[k]:
                heapq.heappush(waiting, (after, k, j + 1))


def _scheduled(plan: Schedule, names: list, rows: list[int], block: int):
    """From first slots of ranges to the blocks that run there; ``at``: the position of a block's first row."""
    short = [n * block - c for n, c in zip(plan.n, rows, strict=True)]  # rows that a source's last block lacks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for start in (x for batch in batches for x in batch.column(0).to_pylist()):
            done = plan.done(start)
            at = start * block - sum(s for s, d, n in zip(short, done, plan.n, strict=True) if d == n)
            found = []
            for slot, (k, j, release, deadline) in enumerate(plan.run_from(done, start, start + RANGE), start):
                found.append((names[k], j, release, deadline, slot, at))
                at += block - short[k] * (j + 1 == plan.n[k])
            kinds = [pa.string(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=["of", "number", "release", "deadline", "slot", "at"])

    return run


def tempered(counts: dict, power: float = 0.5) -> dict:
    """Default targets: each source's share to the given power, the usual tempering of uneven sources."""
    return {k: Fraction(c**power) for k, c in counts.items()}


def mixed(docs: DataFrame, targets: dict[str | None, float] | None = None, block: int = BLOCK, source_col: str = "source") -> DataFrame:
    """Per row of ``docs``: doc_id, source, source_rank, block, release, deadline (of the block), slot, position.

    ``position`` runs gapless from 0 over all rows.
    """
    spark = docs.sparkSession
    h = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).otherwise(F.xxhash64(F.monotonically_increasing_id()))  # rows without an id spread too
    rows = checkpoint(docs.select("doc_id", F.col(source_col).alias("source"), h.alias("h")))
    by = {r[0]: r[1] for r in rows.groupBy("source").count().collect()}
    names = sorted(by, key=lambda s: (s is not None, s))
    if targets is None:
        weights = tempered(by)
    else:
        given = {s: Fraction(str(w)) for s, w in targets.items() if w and w > 0}  # as written: 0.1 is a tenth
        least = min(given.values(), default=Fraction(1))
        weights = {s: given.get(s, least) for s in names}
    counts = [by[s] for s in names]
    ranks, _ = ranked(rows, "source", ["h", "doc_id"], F.col("h"), "source_rank", salts_for(sum(counts)))

    plan = Schedule([-(-c // block) for c in counts], [weights[s] for s in names])
    starts = spark.range(0, plan.slots, RANGE, max(1, min(-(-plan.slots // RANGE), 1000)))
    schedule = starts.mapInArrow(_scheduled(plan, names, counts, block), "of string, number long, release long, deadline long, slot long, at long")
    blocks = ranks.withColumn("block", F.expr(f"source_rank div {block}"))
    timed = blocks.join(schedule, F.expr("source <=> of and block = number"))
    return timed.select("doc_id", "source", "source_rank", "block", "release", "deadline", "slot", F.expr(f"at + source_rank % {block}").alias("position"))


def in_mixed_order(docs: DataFrame, targets: dict[str | None, float] | None = None) -> DataFrame:
    """All rows of ``docs`` with all their columns, dealt by ranges of the mixed position and sorted by it."""
    key, at = free_name(docs, "mixed_id"), free_name(docs, "mixed_at")
    spots = mixed(docs, targets).select(F.col("doc_id").alias(key), F.col("position").alias(at))
    once = spots.groupBy(key).agg(F.min(at).alias(at))  # rows that share an id stand together
    placed = docs.join(once, F.col("doc_id").eqNullSafe(F.col(key)))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartitionByRange(parts, at).sortWithinPartitions(at).select(*[F.col(f"`{c}`") for c in docs.columns])
