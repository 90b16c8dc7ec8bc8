"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A text's fingerprint takes, bit by bit, the majority of the XXH64 values of its 3-word shingles. Two fingerprints link
at RADIUS = 3 or fewer differing bits. Equal fingerprints fold into one row first, so copies never form pairs.

Search: a radius of 3 is odd, so its half is 1 on each side with one bit left over. The 64 bits are cut into BLOCKS
blocks and one block at a time is erased: a pair within 3 bits that differs at all has a block with a differing bit,
and with that block erased the rest differs in at most 2 bits, so that the balls of radius 1 around both rests meet.
Each distinct fingerprint emits for each block its rest and all variants of the rest at one bit; equal variants meet,
and a pair that meets is verified on all 64 bits. No pair within the radius can be missed. Variants travel packed, as
one array per task and shard of the variants' hash, and the number of shards follows the number of fingerprints.

Where few fingerprints meet, all of them are compared; where more than SMALL meet, a breadth-first walk compares them
and gives one link per newly reached fingerprint, so a dense group of m gives m - 1 links there, not m * m / 2.

Components: alternating large-star and small-star steps over the links of distinct fingerprints, each step written
with checkpoint(), until nothing changes.

Edge cases: null and empty texts have no words and fingerprint zero, linked like any other; fewer than three words
make one shingle; repeated rows each get their row; a null doc_id never is a component_id unless the whole
component has none; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, free_name, text_bytes

RADIUS = 3
SHINGLE = 3
SEED = 42
BLOCKS = 3
#: Variants of one shard, about; the fewest shards; fingerprints that are packed together (their numbers have 16 bits).
SHARD_ROWS, LEAST_SHARDS, PACK_ROWS = 2_000_000, 32, 32_768
SMALL = 8


def fingerprint(text: bytes) -> int:
    """The fingerprint of one text as an unsigned 64-bit number."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if n <= SHINGLE:
        return h(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, n)
    stops = np.cumsum(sizes + 1) - 1
    starts, ends = (stops - sizes)[: n - SHINGLE + 1].tolist(), stops[SHINGLE - 1 :].tolist()
    votes = np.zeros(64, np.int64)
    for at in range(0, len(starts), 65536):  # bounded memory for texts of any length
        some = [h(joined[a:b], SEED) for a, b in zip(starts[at : at + 65536], ends[at : at + 65536], strict=True)]
        votes += np.unpackbits(np.array(some, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n - SHINGLE + 1).tobytes(), "big")


def _fingerprints(text: pa.Array) -> pa.Array:
    return pa.array(np.array([fingerprint(x.as_py() or b"") for x in text], np.uint64).view(np.int64))


def fingerprints(text: Column) -> Column:
    """The fingerprint of each text, given as UTF-8 bytes, as a signed long with the same bits."""
    return F.arrow_udf(_fingerprints, T.LongType())(text)


def blocks() -> list[tuple[int, int]]:
    """(first bit, bits) of each block."""
    edges = [64 * k // BLOCKS for k in range(BLOCKS + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def variants(fps: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(block, keys): for each erased block an array of rests, then of rests with one bit turned, one row per variant."""
    for k, (first, bits) in enumerate(blocks()):
        mask = np.uint64((1 << 64) - 1 ^ ((1 << bits) - 1) << first)
        turn = np.array([0] + [1 << i for i in range(64) if not first <= i < first + bits], np.uint64)
        yield k, (fps & mask)[None, :] ^ turn[:, None]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _emit(shards: int):
    """Variants in arrays, one for each pack of fingerprints, block and shard that has some; sorted once per block."""

    def pack(fps: np.ndarray) -> pa.RecordBatch:
        out: list[tuple] = []
        for k, keys in variants(fps):
            shard = ((_mix(keys.ravel() + np.uint64(k)) >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)
            owner = np.tile(np.arange(len(fps)), len(keys))
            bit = np.repeat(turned_bits(k), len(fps))
            order = np.argsort(shard * PACK_ROWS + owner, kind="stable")
            shard, owner, bit = shard[order], owner[order].astype(np.uint16), bit[order]
            first = np.r_[True, shard[1:] != shard[:-1]]
            fresh = first | np.r_[True, owner[1:] != owner[:-1]]  # each fingerprint once in an array, then its variants
            who, number = fps[owner[fresh]], np.cumsum(fresh) - 1
            starts = np.flatnonzero(first)
            short = (number - np.repeat(number[starts], np.diff(np.r_[starts, len(shard)]))).astype(np.uint16)
            for at, end in itertools.pairwise([*starts.tolist(), len(shard)]):
                mine = who[number[at] : number[end - 1] + 1]
                out.append((int(shard[at]), k, np.uint32(len(mine)).tobytes() + mine.tobytes() + short[at:end].tobytes() + bit[at:end].tobytes()))
        kinds = (pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["shard", "block", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            count += len(held[-1])
            while count >= PACK_ROWS:
                every = np.concatenate(held)
                yield pack(every[:PACK_ROWS])
                held, count = [every[PACK_ROWS:]], count - PACK_ROWS
        if count:
            yield pack(np.concatenate(held))

    return run


def turned_bits(block: int) -> np.ndarray:
    """The bit that each variant of ``variants`` has turned; 64: none."""
    first, bits = blocks()[block]
    return np.array([64] + [i for i in range(64) if not first <= i < first + bits], np.uint8)


def _unpack(packed: bytes, block: int) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(packed, np.uint32, 1)[0])
    fps = np.frombuffer(packed, np.uint64, n, 4)
    count = (len(packed) - 4 - 8 * n) // 3
    own = fps[np.frombuffer(packed, np.uint16, count, 4 + 8 * n)]
    bit = np.frombuffer(packed, np.uint8, count, 4 + 8 * n + 2 * count)
    first, bits = blocks()[block]
    turn = np.where(bit < 64, np.uint64(1) << np.minimum(bit, 63).astype(np.uint64), np.uint64(0))
    return (own & np.uint64((1 << 64) - 1 ^ ((1 << bits) - 1) << first)) ^ turn, own


def links(keys: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Verified links (lower, higher) among fingerprints with equal keys; connected as all verified pairs would be."""
    order = np.lexsort((own, keys))
    keys, own = keys[order], own[order]
    new = np.r_[True, (keys[1:] != keys[:-1]) | (own[1:] != own[:-1])]
    keys, own = keys[new], own[new]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    found = [np.empty((0, 2), np.uint64)]
    small = np.repeat(sizes <= SMALL, sizes)
    for d in range(1, SMALL):
        hit = np.flatnonzero((keys[d:] == keys[:-d]) & small[d:])
        close = hit[np.bitwise_count(own[hit] ^ own[hit + d]) <= RADIUS]
        found.append(np.stack([own[close], own[close + d]], 1))
    for k in np.flatnonzero(sizes > SMALL):
        found.append(walk(own[starts[k] : starts[k] + sizes[k]]))
    return np.unique(np.concatenate(found), axis=0)


def walk(fps: np.ndarray) -> np.ndarray:
    """A spanning forest of the links among distinct fingerprints, breadth first."""
    rest, out = fps, []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            one = queue.pop()
            near = np.bitwise_count(rest ^ one) <= RADIUS
            if near.any():
                reached = rest[near]
                out.append(np.stack([np.minimum(reached, one), np.maximum(reached, one)], 1))
                queue.extend(reached)
                rest = rest[~near]
    return np.concatenate(out) if out else np.empty((0, 2), np.uint64)


def _meet(group: pd.DataFrame) -> pd.DataFrame:
    found = []
    for block, rows in group.groupby("block"):
        parts = [_unpack(x, int(block)) for x in rows["packed"]]
        found.append(links(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])))
    pairs = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.uint64)
    return pd.DataFrame({"a": pairs[:, 0].view(np.int64), "b": pairs[:, 1].view(np.int64)})


def near_links(distinct: DataFrame, count: int) -> DataFrame:
    """Links (a, b) between the distinct fingerprints in column fp; their components are those of all pairs within RADIUS."""
    per = sum(65 - bits for _, bits in blocks())
    shards = max(LEAST_SHARDS, -(-count * per // SHARD_ROWS))
    packed = distinct.select("fp").mapInArrow(_emit(shards), "shard int, block int, packed binary")
    return packed.groupBy("shard").applyInPandas(_meet, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node that it reaches.

    Large-star: every node's larger neighbours attach to its smallest neighbour. Small-star: its smaller neighbours
    do. Minima are pre-aggregated, so a hub's edges never sit in one task; the join by node may be split by AQE.
    """
    edges = checkpoint(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    before = None
    while True:  # the steps settle after about the logarithm of the longest path
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("x"), "m").union(down.select("u", "m"))
        edges = checkpoint(small.filter("x <> m").select(F.col("m").alias("a"), F.col("x").alias("b")).distinct())
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select("a", "a").distinct())


def _rooted(distinct: DataFrame, *columns: str) -> DataFrame:
    """The distinct fingerprints of column fp with ``columns`` and the root of their component."""
    linked = components(near_links(distinct, distinct.count()))
    return distinct.join(linked, distinct["fp"] == linked["node"], "left").select("fp", *columns, F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that it reaches)."""
    prints = checkpoint(docs.select("doc_id", fingerprints(text_bytes()).alias("fp")))
    roots = _rooted(checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("first"))), "first")
    names = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    table = roots.join(names, "root").select("fp", "component_id")
    return prints.join(table, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near-copies: of each component the row with the smallest doc_id, exactly one.

    Ids may be null (they come last) or repeat: a row is known by its id and the hash of its other columns too.
    """
    key, row, n, own = (free_name(docs, stem) for stem in ("kept_id", "kept_hash", "kept_rows", "row_hash"))
    cells = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind]
    whole = F.xxhash64(*cells, *[c.isNull() for c in cells])  # a null alone leaves the hash as it is
    prints = docs.select("doc_id", whole.alias("h"), fingerprints(text_bytes()).alias("fp")).groupBy("fp", "doc_id", "h").agg(F.count("*").alias("n"))
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h", "fp", "n")
    roots = _rooted(checkpoint(prints.groupBy("fp").agg(F.min(first).alias("first"))), "first")
    found = roots.groupBy("root").agg(F.min("first").alias("f"))
    keep = checkpoint(found.select(F.col("f.doc_id").alias(key), F.col("f.h").alias(row), F.col("f.n").alias(n)))
    known = docs.withColumn(own, whole)
    same = F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(own) == F.col(row))
    kept = known.join(keep.filter(F.col(n) == 1), same, "left_semi")
    if not keep.filter(F.col(n) > 1).isEmpty():
        kept = kept.unionByName(known.join(keep.filter(F.col(n) > 1), same, "left_semi").dropDuplicates(["doc_id", own]))
    return kept.drop(own)
