"""Best-fit packing by the linear grouping scheme, on a histogram of lengths.

Texts are tokenised once; a document longer than a sequence is cut into full pieces behind a first, shorter one. A
full piece is a sequence by itself. What is left has lengths below SEQUENCE, so its histogram has fewer than SEQUENCE
entries whatever the input, and the driver packs that histogram:

1. Large lengths (TRIALS) are sorted downwards and cut into groups of equal cardinality; each is rounded up to its
   group's largest length (linear grouping).
2. Over the few group sizes the configurations (multisets that fit) are optimised by column generation: a revised
   simplex for the covering program, priced by an integer knapsack over the capacity. Solutions are rounded down and
   the rest is covered by best fit among the same sizes.
3. The actual documents replace the rounded ones group by group: the configurations' bins take them in order of length.
4. The shorter documents are put best-fit, longest first, into the room that remains, in runs of equal bins.

Every step moves runs of equal bins, not single documents, so the driver's work depends on the number of distinct
lengths alone. A piece finds its sequence from its rank among the pieces of its length, computed with salted prefix sums.

Edge cases: a null or empty text is one piece, the end token; ties in length are ranked by hash, then id and piece;
repeated rows are packed as often as they occur; an empty table gives an empty result; other columns are not read;
a control string of the vocabulary inside a text is its one id, as the library has it.
"""

from __future__ import annotations

import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint, free_name, text_bytes
from .ranks import ranked, salts_for

SEQUENCE = 1024
END = 2
#: (shortest large length, groups) that are tried; the fewest sequences win.
TRIALS = ((256, 48), (342, 64), (512, 64))
#: Chunks between spaces whose ids a worker remembers, and their longest length.
REMEMBER, REMEMBER_CHARS = 600_000, 48
LATIN = "\u0250"


@lru_cache(1)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(1)
def _ranks(path: str):
    """The same vocabulary for the quicker of the two libraries, if the file's merges rank by id; else None."""
    import json

    import public_tokenizers
    import tiktoken

    model = json.load(open(path, encoding="utf-8"))["model"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"][a + b] for a, b in merges]
    if made != sorted(made) or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return None
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    ranks = {bytes(byte[c] for c in token): k for token, k in model["vocab"].items() if all(c in byte for c in token) and not token.startswith("<|")}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Token ids of whole texts as little-endian 32-bit bytes.

    The byte-level pattern never joins what stands before a single space with what follows it, if neither side is
    white space: the space begins the next token. So texts are cut there, and the ids of a chunk, which the library
    makes once, are remembered. A text with other runs of white space around a space goes to the library as a whole.
    """

    def __init__(self, path: str):
        self.t, self.quick, self.known = _tokenizer(path), _ranks(path), {}
        added = self.t.get_added_tokens_decoder().values()
        self.special = [t.content for t in added]  # control strings are found in the text before anything else
        self.marks = {m: self._ids(m) for m in ",.;:!?"}

    def _ids(self, text: str) -> bytes:
        return np.array(self.t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, text: str) -> bytes:
        return array("I", self.quick.encode_ordinary(text)).tobytes() if self.quick else self._ids(text)

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return self._ids(text)
        head, *rest = text.split(" ")
        if not head or head[-1].isspace():
            return self._ids(text)
        out = list(map(self.known.get, rest))
        if None in out:
            for k in [k for k, ids in enumerate(out) if ids is None]:
                chunk = rest[k]
                if not chunk or chunk[0].isspace() or chunk[-1].isspace() and k + 1 < len(rest):
                    return self._ids(text)
                out[k] = self._learn(chunk)
        return b"".join([self._word(head), *out])

    def _learn(self, chunk: str) -> bytes:
        """The ids of a space and the chunk. Latin letters, then at most one mark, are one or two tokens' worth of pattern."""
        ids = self.known.get(chunk)
        if ids is not None:
            return ids
        mark = chunk[-1] if chunk[-1] in self.marks else ""
        stem = chunk[:-1] if mark else chunk
        if self.quick and stem.isalpha() and max(stem) < LATIN:
            if mark and (ids := self.known.get(stem)) is not None:
                ids += self.marks[mark]
            else:
                ids = array("I", self.quick._encode_single_piece(f" {stem}".encode())).tobytes()
                if mark:
                    self._remember(stem, ids)
                    ids += self.marks[mark]
        else:
            ids = self._word(" " + chunk)
        self._remember(chunk, ids)
        return ids

    def _remember(self, chunk: str, ids: bytes) -> None:
        if len(chunk) <= REMEMBER_CHARS and not chunk[-1].isspace():
            if len(self.known) >= REMEMBER:
                self.known.clear()
            self.known[chunk] = ids


def cut(n: int, size: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones, behind a shorter first one if n is no multiple of the size."""
    first = n % size
    return ([(0, first)] if first else []) + [(s, size) for s in range(first, n, size)]


def _pieces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path)
        for batch in batches:
            rows = []
            for doc, text, at in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                ids = encode((text.as_py() or b"").decode("utf-8", "replace")) + END.to_bytes(4, "little")
                rows += [(doc, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)]), at) for k, (s, n) in enumerate(cut(len(ids) // 4))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names=[*NAMES, "row_place"])

    return run


NAMES = ["doc_id", "piece", "start", "length", "ids_crc32"]
TYPES = [pa.int64(), pa.int32(), *[pa.int64()] * 4]


def pieces(docs: DataFrame, tokenizer: str, place: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every text; row_place if a column ``place`` is named."""
    kept = F.lit(None).cast("long") if place is None else F.col(place)
    rows = docs.select(F.col("doc_id").cast("long"), text_bytes().alias("b"), kept.alias("row_place"))
    found = rows.mapInArrow(_pieces(tokenizer), "doc_id long, piece int, start long, length long, ids_crc32 long, row_place long")
    return found if place is not None else found.drop("row_place")


# --- packing of a histogram ------------------------------------------------------------------------------------------


def knapsack(sizes: np.ndarray, values: np.ndarray, room: int) -> np.ndarray:
    """How many of each size make the most valuable multiset within ``room``."""
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    for r in range(1, room + 1):
        fit = np.flatnonzero(sizes <= r)
        best[r], took[r] = best[r - 1], -1
        if len(fit):
            gain = values[fit] + best[r - sizes[fit]]
            k = int(np.argmax(gain))
            if gain[k] > best[r] + 1e-12:
                best[r], took[r] = gain[k], fit[k]
    out, r = np.zeros(len(sizes), int), room
    while r > 0:
        if took[r] < 0:
            r -= 1
        else:
            out[took[r]] += 1
            r -= sizes[took[r]]
    return out


def configurations(sizes: np.ndarray, need: np.ndarray, room: int = SEQUENCE, rounds: int = 600) -> list[tuple[np.ndarray, int]]:
    """(configuration, times) that together hold ``need`` items of each size, nearly as few as can be."""
    m = len(sizes)
    columns = np.diag(room // sizes).astype(float)  # one size a bin
    inverse, level = np.diag(1 / np.diag(columns)), need / np.diag(columns)
    for _ in range(rounds):
        dual = inverse.sum(0)
        new = knapsack(sizes, dual, room)
        if new @ dual <= 1 + 1e-7:
            break
        into = inverse @ new
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(into > 1e-9, level / into, np.inf)
        k = int(np.argmin(ratio))
        level = level - ratio[k] * into
        level[k] = ratio[k]
        level = np.maximum(level, 0)
        row = inverse[k] / into[k]
        inverse = inverse - np.outer(into, row)
        inverse[k] = row
        columns[:, k] = new
    times = np.floor(level + 1e-9).astype(int)
    out = [(columns[:, k].astype(int), int(times[k])) for k in range(m) if times[k]]
    left = np.maximum(need - columns.astype(int) @ times, 0)
    while left.any():  # at most m sizes are short by few items: fill bins downwards
        one, r = np.zeros(m, int), room
        for k in np.argsort(-sizes, kind="stable"):
            n = min(int(left[k]), r // int(sizes[k]))
            one[k], r = n, r - n * int(sizes[k])
        again = int(min(left[k] // one[k] for k in np.flatnonzero(one)))
        out.append((one, again))
        left = left - one * again
    return out


class Runs:
    """Bins in runs: each run is some number of equal bins with their (length, first rank) slots."""

    def __init__(self) -> None:
        self.by_room: dict[int, list[tuple[int, tuple]]] = defaultdict(list)
        self.given: dict[int, int] = defaultdict(int)

    def add(self, count: int, slots: tuple, room: int) -> None:
        if count:
            self.by_room[room].append((count, slots))

    def take(self, length: int, count: int) -> int:
        """First rank of the next ``count`` pieces of this length."""
        first = self.given[length]
        self.given[length] += count
        return first


def pack(histogram: dict[int, int], room: int = SEQUENCE, trials: tuple = TRIALS) -> list[tuple[int, tuple]]:
    """Runs (count, ((length, first rank), ...)) that hold every piece of the histogram once: the best of the trials."""
    found = [pack_once(histogram, room, large * room // SEQUENCE, groups) for large, groups in trials]
    return min(found, key=lambda runs: sum(n for n, _ in runs))


def pack_once(histogram: dict[int, int], room: int, large: int, groups: int) -> list[tuple[int, tuple]]:
    """The scheme with one bound of large lengths and one number of groups."""
    runs = Runs()
    big = sorted((n for n in histogram if n >= large), reverse=True)
    total = sum(histogram[n] for n in big)
    if total:
        each = -(-total // groups)
        group: list[list[list[int]]] = [[]]  # per group [length, count], longest first
        space = each
        for n in big:
            c = histogram[n]
            while c:
                part = min(c, space)
                group[-1].append([n, part])
                c, space = c - part, space - part
                if not space:
                    group.append([])
                    space = each
        merged: dict[int, list[list[int]]] = {}
        for g in group:
            if g:
                merged.setdefault(g[0][0], []).extend(g)
        group = list(merged.values())
        sizes, need = np.array([g[0][0] for g in group]), np.array([sum(c for _, c in g) for g in group])
        for config, times in configurations(sizes, need, room):
            kinds = [k for k in range(len(group)) for _ in range(config[k])]
            while times:  # bins that get the same actual lengths are one run
                use: list[int | None] = []
                at: dict[int, int] = defaultdict(int)
                for k in kinds:  # the next documents of the group, each slot its own part of the group's list
                    use.append(group[k][0][0] if group[k] else None)
                for k in kinds:
                    at[k] += 1
                step = min([times] + [group[k][0][1] // at[k] for k in at if group[k] and group[k][0][1] >= at[k]])
                tight = {k for k in at if group[k] and group[k][0][1] < at[k]}
                if tight:  # the end of a length: one bin, slot by slot
                    step, use = 1, []
                    for k in kinds:
                        use.append(group[k][0][0] if group[k] else None)
                        if group[k]:
                            group[k][0][1] -= 1
                            if not group[k][0][1]:
                                group[k].pop(0)
                else:
                    for k, n in at.items():
                        if group[k]:
                            group[k][0][1] -= step * n
                            if not group[k][0][1]:
                                group[k].pop(0)
                lengths = [n for n in use if n is not None]
                if lengths:
                    slots = tuple((n, runs.take(n, step)) for n in lengths)
                    runs.add(step, slots, room - sum(lengths))
                times -= step
    for n in sorted((n for n in histogram if n < large), reverse=True):
        left = histogram[n]
        while left:
            r = min((r for r, held in runs.by_room.items() if r >= n and held), default=None)
            if r is None:  # no open bin has room: new bins of as many as fit
                fit = room // n
                bins, rest = divmod(left, fit)
                if bins:
                    runs.add(bins, tuple((n, runs.take(n, bins)) for _ in range(fit)), room - fit * n)
                if rest:
                    runs.add(1, tuple((n, runs.take(n, 1)) for _ in range(rest)), room - rest * n)
                break
            count, slots = runs.by_room[r].pop()
            used = min(count, left)
            if used < count:  # the run splits: the ranks of its later bins begin further on
                runs.by_room[r].append((count - used, tuple((x, f + used) for x, f in slots)))
            runs.add(used, (*slots, (n, runs.take(n, used))), r - n)
            left -= used
    return [run for r in sorted(runs.by_room) for run in runs.by_room[r]]


def in_order(docs: DataFrame) -> DataFrame:
    """The rows with ``row_place``: a long that grows along them as they were written or, where they aren't a plain
    read of files, as they stand in the partitions."""
    name = free_name(docs, "row_place")
    try:
        file, row = F.col("_metadata.file_name"), F.col("_metadata.row_index")
        part = F.regexp_extract(file, r"part-(\d+)", 1)
        return docs.select("*", (F.when(part == "", 0).otherwise(part).cast("long") * (1 << 40) + row).alias(name))
    except AnalysisException:
        return docs.withColumn(name, F.monotonically_increasing_id())


def packed_in_order(docs: DataFrame, tokenizer: str, room: int = SEQUENCE) -> DataFrame:
    """``packed`` with ``place``: sequences sorted by it follow the order of ``docs``, each by the first of its pieces."""
    ordered = in_order(docs)
    rows = packed(ordered, tokenizer, room, ordered.columns[-1])
    piece_at = F.col("row_place").cast("decimal(38,0)") * (1 << 31) + F.col("piece")  # a row has fewer than 2**31 pieces
    return rows.withColumn("place", F.min(piece_at).over(Window.partitionBy("sequence_id"))).drop("row_place")


def packed(docs: DataFrame, tokenizer: str, room: int = SEQUENCE, place: str | None = None) -> DataFrame:
    """Every piece with sequence_id and offset: the pieces of a sequence stand gapless from 0 and fill at most ``room``.

    ``place``: a long column of ``docs`` that pieces keep, as ``row_place``.
    """
    spark = docs.sparkSession
    rows = checkpoint(pieces(docs, tokenizer, place))
    count = rows.count()
    salt = F.xxhash64("doc_id", "piece", "ids_crc32")
    ranks, totals = ranked(rows.withColumn("h", salt), "length", ["h", "doc_id", "piece"], F.col("h"), "rank", salts_for(count))
    histogram = {r.length: r.n for r in totals.collect()}  # at most ``room`` rows
    full = histogram.pop(room, 0)
    cells, sequence = [(room, 0, full, 0, 0)], full
    for bins, slots in pack(histogram, room):
        offset = 0
        for length, first in slots:
            cells.append((length, first, first + bins, sequence, offset))
            offset += length
        sequence += bins
    places = spark.createDataFrame(cells, "cell_length long, first long, end long, sequence long, offset long")
    # one row per slot of a run; runs follow from the distinct lengths (below ``room``), not from the input's size
    joined = ranks.join(F.broadcast(places), F.expr("length = cell_length and rank >= first and rank < end"))
    return joined.select(*NAMES, F.expr("sequence + rank - first").alias("sequence_id"), "offset", *["row_place"][: place is not None])
