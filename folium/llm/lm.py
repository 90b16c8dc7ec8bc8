"""Language-model scores from a bigram trie in Elias-Fano form.

Model: P(w | v) = (c(v, w) + MU * P1(w)) / (c(v) + MU) with P1(w) = c(w) / (N + 1), and 1 / (N + 1) for the class of
unknown words; it sums to one. A text is its words and an end; the word before a text's first is an end.

Because that numerator needs only what is known about w and the denominator only what is known about v, the trie
is reversed (word, then what stands before it) and cut into shards by the word's hash. The number of shards follows the
number of tokens, so a shard's memory stays bounded while the model grows with the corpus; no level of it is broadcast.
A heavy word (a quarter of a shard's tokens or more) is cut further, by what stands before it; its count, which no
single shard then knows, comes from the first pass, which counts words. At most HEAVY_WORDS words are treated so.

1. Words are counted, for N, V and the heavy words.
2. Batches of texts are packed: each distinct pair of a batch once, for its shard, with its training count. A batch's
   token numbers travel along with one of its pieces.
3. A shard adds the counts and writes its trie as a memory-mapped file: level 1 the words, pointers into level 2,
   level 2 what stands before, all three as Elias-Fano sequences, with 16-bit codes of the smoothed numerators. Then it
   answers each piece: find the word, take its range from the pointers, find the successor of the context within that
   range; a code for each pair and a count for each word go back.
4. A batch lays out its pairs as in step 2, reads the answers off and adds them up by text.

What is shuffled is in proportion to the tokens: a piece exists only where a batch has pairs of a shard, and nothing is
sent per text and shard. Words are known by 64-bit hashes, contexts below a word by 32 bits of theirs.

Edge cases: a null or empty text is just the end token; without training texts all words are unknown and base_score
uses N = V = 0; repeated rows are scored, and counted, as often as they occur; a null id counts as empty text for its
fold; one very long text may fill a batch by itself; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import os
import tempfile
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, text_bytes

MU = 20.0
FOLDS = 10
BATCH_TOKENS = 1 << 22
SHARD_TOKENS, LEAST_SHARDS = 2_000_000, 32
#: The most words that are cut over shards; only a word with more than the HEAVY_WORDS-th part of all tokens is heavy.
HEAVY_WORDS = 200_000
#: Distinct words that a worker counts before it hands them on.
COUNT_WORDS = 1 << 20
#: Tokens of a batch that are sorted or summed at a time, and pieces that are handed on at a time.
STEP_TOKENS, STEP_PIECES = 1 << 17, 4
END = b"\n"  # no word holds it
#: Smoothed values (decimal logarithms) are kept in steps of 1 / STEPS from LOWEST on.
STEPS, LOWEST = 2047.0, -16.0


class EliasFano:
    """A sorted sequence: low bits packed, high bits as unary gaps in a bit vector with a rank directory."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.bits, self.low, self.high, self.ones = n, bits, low, high, ones

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        values, n = values.astype(np.uint64), len(values)
        bits = min(63, max(0, (universe // max(n, 1)).bit_length() - 1))
        low = np.zeros(n * bits // 64 + 2, np.uint64)
        if bits and n:
            part, at = values & np.uint64((1 << bits) - 1), np.arange(n, dtype=np.uint64) * np.uint64(bits)
            word, off = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, part << off)
            np.bitwise_or.at(low, word + 1, np.where(off > 0, part >> (np.uint64(64) - np.maximum(off, np.uint64(1))), np.uint64(0)))
        at = (values >> np.uint64(bits)) + np.arange(n, dtype=np.uint64)
        size = (int(universe) >> bits) + n + 2
        high = np.zeros(size // 64 + 2, np.uint64)
        np.bitwise_or.at(high, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.uint64)]).astype(np.uint64)
        return cls(n, bits, low, high, ones)

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n, self.bits, len(self.low), len(self.high)], np.uint64), self.low, self.high, self.ones]

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.bits)
        word, off = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        up = np.where(off > 0, self.low[word + 1] << (np.uint64(64) - np.maximum(off, np.uint64(1))), np.uint64(0))
        return ((self.low[word] >> off) | up) & np.uint64((1 << self.bits) - 1)

    def _select(self, k: np.ndarray, zeros: bool) -> np.ndarray:
        """Positions of the k-th (from 0) ones or zeros of the bit vector."""
        before = np.arange(len(self.ones), dtype=np.uint64) * np.uint64(64) - self.ones if zeros else self.ones
        word = np.searchsorted(before, k, side="right") - 1
        bits, left = (~self.high[word] if zeros else self.high[word]), k - before[word]
        at = np.zeros(len(k), np.uint64)
        for half in (32, 16, 8, 4, 2, 1):
            h = np.uint64(half)
            count = np.bitwise_count(bits & np.uint64((1 << half) - 1)).astype(np.uint64)
            over = left >= count
            left, at = np.where(over, left - count, left), np.where(over, at + h, at)
            bits = np.where(over, bits >> h, bits)
        return word.astype(np.uint64) * np.uint64(64) + at

    def access(self, i: np.ndarray) -> np.ndarray:
        i = i.astype(np.uint64)
        return ((self._select(i, False) - i) << np.uint64(self.bits)) | self._lows(i)

    def successor(self, x: np.ndarray, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Index of the first value >= x within [begin, end) of the sequence; ``end`` if there is none."""
        x = x.astype(np.uint64)
        h = x >> np.uint64(self.bits)
        lo = np.where(h > 0, self._select(np.maximum(h, np.uint64(1)) - np.uint64(1), True) + np.uint64(1), np.uint64(0)) - h
        hi = self._select(h, True) - h
        lo, hi = lo.astype(np.int64), hi.astype(np.int64)
        if begin is not None:
            lo, hi = np.maximum(lo, begin), np.minimum(hi, end)
        want = x & np.uint64((1 << self.bits) - 1)
        while True:
            open_ = lo < hi
            if not open_.any():
                return lo
            mid = (lo + hi) // 2
            less = self._lows(np.minimum(mid, max(self.n - 1, 0))) < want
            lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)


def code(values: np.ndarray) -> np.ndarray:
    return np.clip(np.round((values - LOWEST) * STEPS), 0, 65535).astype(np.uint16)


def value(codes: np.ndarray) -> np.ndarray:
    return codes.astype(np.float64) / STEPS + LOWEST


class Trie:
    """Level 1: words; level 2: what stands before each, as the word's rank and the context's code in one number."""

    def __init__(self, path: str):
        self.map = np.memmap(path, np.uint64, "r")
        self.at = 0
        self.words, self.pointers, self.pairs = self._sequence(), self._sequence(), self._sequence()
        self.counts = self._take(self.words.n)
        self.unseen = self._take(-(-self.words.n // 4)).view(np.uint16)[: self.words.n]
        self.seen = self._take(-(-self.pairs.n // 4)).view(np.uint16)[: self.pairs.n]

    def _take(self, n: int) -> np.ndarray:
        self.at += int(n)
        return np.asarray(self.map[self.at - int(n) : self.at])

    def _sequence(self) -> EliasFano:
        n, bits, low, high = (int(x) for x in self._take(4))
        return EliasFano(n, bits, self._take(low), self._take(high), self._take(high + 1))

    @staticmethod
    def write(path: str, words: np.ndarray, counts: np.ndarray, pairs: np.ndarray, pair_counts: np.ndarray, total: int) -> None:
        """words: sorted hashes; pairs: sorted (rank << 32 | code); counts are those of training texts, all above 0."""
        pointers = np.searchsorted(pairs, np.arange(len(words) + 1, dtype=np.uint64) << np.uint64(32))
        first = counts.astype(np.float64) / (total + 1)
        smooth = first[(pairs >> np.uint64(32)).astype(np.int64)]
        pad = lambda x: np.concatenate([x, np.zeros(-len(x) % 4, np.uint16)]).view(np.uint64)
        with open(path, "wb") as f:
            for sequence in (EliasFano.of(words, 1 << 64), EliasFano.of(pointers, len(pairs) + 1), EliasFano.of(pairs, max(len(words), 1) << 32)):
                for part in sequence.parts():
                    f.write(part.tobytes())
            f.write(counts.astype(np.uint64).tobytes())
            f.write(pad(code(np.log10(MU * first))).tobytes())
            f.write(pad(code(np.log10(pair_counts + MU * smooth))).tobytes())

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, known) of each hash."""
        if not self.words.n:
            return np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        at = np.minimum(self.words.successor(words), self.words.n - 1)
        return at, self.words.access(at) == words

    def above(self, rank: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, found) of each context below the word of that rank: a successor search within the word's range."""
        begin, end = self.pointers.access(rank).astype(np.int64), self.pointers.access(rank + 1).astype(np.int64)
        key = (rank.astype(np.uint64) << np.uint64(32)) | codes.astype(np.uint64)
        at = self.pairs.successor(key, begin, end)
        inside = at < end
        place = np.where(inside, at, 0)
        return place, inside & (self.pairs.access(place) == key)


# --- counting words ------------------------------------------------------------------------------------------------


def _arrow(**columns: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in columns.values()], names=list(columns))


def _count(limit: int):
    """(word's hash, count) of each distinct word of a partition's training texts, ends included; and all tokens, without a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taught, every = Counter(), 0

        def counted() -> pa.RecordBatch:
            words = np.fromiter(map(xxhash.xxh64_intdigest, taught), np.uint64, len(taught)).view(np.int64)
            return _arrow(word=(words, pa.int64()), n=(list(taught.values()), pa.int64()))

        for batch in batches:
            for train, text in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                found = text.as_py().lower().split()
                found.append(END)
                every += len(found)
                if train:
                    taught.update(found)
                if len(taught) >= limit:
                    yield counted()
                    taught.clear()
        if taught:
            yield counted()
        yield _arrow(word=([None], pa.int64()), n=([every], pa.int64()))

    return run


def _sums(heavy: int):
    """Of word counts: a row of sums a partition, without a word, and the words of more than ``heavy`` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taught = every = distinct = 0
        for batch in batches:
            word, n = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            is_word = word.is_valid().to_numpy(zero_copy_only=False)
            taught, every, distinct = taught + int(n[is_word].sum()), every + int(n[~is_word].sum()), distinct + int(is_word.sum())
            many = is_word & (n > heavy)
            if many.any():
                zero = np.zeros(int(many.sum()), np.int64)
                yield _arrow(word=(word.filter(pa.array(many)), pa.int64()), n=(n[many], pa.int64()), every=(zero, pa.int64()), words=(zero, pa.int64()))
        yield _arrow(word=([None], pa.int64()), n=([taught], pa.int64()), every=([every], pa.int64()), words=([distinct], pa.int64()))

    return run


# --- packing the texts ---------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Cut:
    """How pairs are dealt to shards: heavy words' sorted hashes, their counts and over how many cells each is spread."""

    shards: int
    heavy: np.ndarray
    counts: np.ndarray
    cells: np.ndarray

    def shard(self, words: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """The shard of each pair of hashes."""
        cell = np.zeros(len(words), np.uint64)
        if len(self.heavy):
            at = np.minimum(np.searchsorted(self.heavy, words), len(self.heavy) - 1)
            hit = np.flatnonzero(self.heavy[at] == words)
            cell[hit] = (contexts[hit] >> np.uint64(32)) % self.cells[at[hit]]
        x = words + cell * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return (((x >> np.uint64(32)) * np.uint64(self.shards)) >> np.uint64(32)).astype(np.int64)


def _ranges(ids: np.ndarray, words: int) -> Iterator[tuple[int, int]]:
    """Ranges of word numbers with some STEP_TOKENS tokens each; a word with more has all of its own in one."""
    many = np.zeros(words, np.int64)
    for a in range(0, len(ids), STEP_TOKENS):
        many += np.bincount(ids[a : a + STEP_TOKENS], minlength=words)
    cuts = np.searchsorted(np.cumsum(many), np.arange(STEP_TOKENS, len(ids) + STEP_TOKENS, STEP_TOKENS)) + 1
    return itertools.pairwise([0, *np.unique(np.minimum(cuts, words)).tolist()])


class Layout:
    """The distinct pairs of a batch, by shard, then word; of token numbers (0: an end) and the hash of each number.

    It is made of a range of words after another: sorted at once, a batch's tokens would take several times their memory.
    With ``train`` it counts, for packing, the training tokens of each pair; without, it knows the place of each token's pair.
    """

    def __init__(self, ids: np.ndarray, hashes: np.ndarray, cut: Cut, train: np.ndarray | None = None):
        pair_of, at = np.empty(len(ids) if train is None else 0, np.uint32), 0
        words, contexts, shards, many = [], [], [], []
        for begin, end in _ranges(ids, len(hashes)):
            here = np.flatnonzero((ids >= begin) & (ids < end))
            before = ids[here - 1]
            before[here == 0] = 0
            pairs, pair = np.unique(ids[here].astype(np.int64) * len(hashes) + before, return_inverse=True)
            word, context = pairs // len(hashes), pairs % len(hashes)
            words.append(word.astype(np.uint32))
            contexts.append(context.astype(np.uint32))
            shards.append(cut.shard(hashes[word], hashes[context]).astype(np.uint32))
            if train is None:
                pair_of[here] = pair + at
            else:
                many.append(np.bincount(pair, train[here], len(pairs)).astype(np.uint32))
            at += len(pairs)
        order = np.argsort(np.concatenate(shards), kind="stable")

        def dealt(parts: list[np.ndarray]) -> np.ndarray:
            whole = np.concatenate(parts)
            parts.clear()
            return whole[order]

        self.word, self.context, self.shard = dealt(words), dealt(contexts), dealt(shards)
        if train is None:
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            for a in range(0, len(ids), STEP_TOKENS):
                pair_of[a : a + STEP_TOKENS] = place[pair_of[a : a + STEP_TOKENS]]
            self.place = pair_of
        else:
            self.many = dealt(many)
        #: where a word begins within its shard
        self.first = np.flatnonzero(np.r_[True, (self.word[1:] != self.word[:-1]) | (self.shard[1:] != self.shard[:-1])])


def _squeeze(ids: np.ndarray) -> bytes:
    return pa.compress(ids.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def _unsqueeze(squeezed: memoryview, tokens: int) -> np.ndarray:
    plane = pa.decompress(pa.py_buffer(squeezed), 4 * tokens, codec="zstd")
    return np.ascontiguousarray(np.frombuffer(plane, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _pack_batch(batch: int, docs: list[tuple], ids: np.ndarray, index: dict[bytes, int], cut: Cut) -> pa.RecordBatch:
    """One row per shard that has pairs of the batch; one of them, another for each batch, carries the batch itself. Empties the index."""
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, index), np.uint64, len(index))
    index.clear()
    meta = np.array([(d or 0, d is None, t) for d, t in docs], np.int64).tobytes()
    squeezed = _squeeze(ids)
    state = b"".join([np.array([len(ids), len(hashes), len(docs), len(squeezed)], np.int64).tobytes(), hashes.tobytes(), meta, squeezed])
    del meta, squeezed
    lay = Layout(ids, hashes, cut, np.repeat(np.array([t for _, t in docs], bool), np.diff(np.flatnonzero(ids == 0), prepend=-1)))
    starts = np.flatnonzero(np.r_[True, lay.shard[1:] != lay.shard[:-1]])
    low = (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    words = np.searchsorted(lay.first, np.r_[starts, len(lay.word)])
    packed, sizes, carrier = bytearray(), [0], ((batch >> 32) + batch) % len(starts)
    for k, (a, b) in enumerate(itertools.pairwise(np.r_[starts, len(lay.word)].tolist())):
        first = lay.first[words[k] : words[k + 1]]
        head = np.array([len(first), b - a], np.uint32)
        for x in (head, hashes[lay.word[first]], np.diff(np.r_[first, b]).astype(np.uint32), low[lay.context[a:b]], lay.many[a:b]):
            packed += x.tobytes()
        sizes.append(len(packed))
    offsets = pa.array(sizes, pa.int32())
    pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, offsets.buffers()[1], pa.py_buffer(packed)])
    states = [state if k == carrier else b"" for k in range(len(starts))]
    return _arrow(shard=(lay.shard[starts].astype(np.int32), pa.int32()), batch=([batch] * len(starts), pa.int64()), packed=(pieces, pa.binary()), state=(states, pa.binary()))


def _pack(cut: Cut, batch_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = itertools.count(TaskContext.get().partitionId() << 32)
        fresh = lambda: defaultdict(itertools.count(1).__next__, {END: 0})
        docs, ids, index = [], array("I"), fresh()

        def pieces() -> Iterator[pa.RecordBatch]:
            out = _pack_batch(next(number), docs, np.frombuffer(ids, np.uint32), index, cut)
            for k in range(0, out.num_rows, STEP_PIECES):
                yield out.slice(k, STEP_PIECES)

        for batch in batches:
            for doc, train, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                found = text.as_py().lower().split()
                if docs and len(ids) + len(found) >= batch_tokens:
                    yield from pieces()
                    docs, ids, index = [], array("I"), fresh()
                found.append(END)
                docs.append((doc, train))
                ids.extend(map(index.__getitem__, found))
        if docs:
            del batch, text  # the batch's texts are not needed any more
            yield from pieces()

    return run


# --- the shards and their answers ----------------------------------------------------------------------------------


def _unpack(packed: bytes) -> tuple[np.ndarray, ...]:
    """(words, pairs per word, contexts, training counts) of a piece."""
    words, pairs = (int(x) for x in np.frombuffer(packed, np.uint32, 2))
    at, out = 8, []
    for kind, n in ((np.uint64, words), (np.uint32, words), (np.uint32, pairs), (np.uint32, pairs)):
        out.append(np.frombuffer(packed, kind, n, at))
        at += np.dtype(kind).itemsize * n
    return tuple(out)


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their summed values."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[new], np.add.reduceat(values, new) if len(new) else values


def _trie(pieces: list[bytes], cut: Cut, total: int) -> Trie:
    """The memory-mapped trie of a shard's pieces."""
    heads, sums = [], []
    for piece in pieces:
        words, per_word, _, n = _unpack(piece)
        heads.append(words)
        sums.append(np.add.reduceat(n.astype(np.int64), np.cumsum(per_word.astype(np.int64)) - per_word))
    words, counts = _summed(np.concatenate(heads), np.concatenate(sums))
    del heads, sums
    if len(cut.heavy):  # this shard has only some of what stands before a heavy word
        at = np.minimum(np.searchsorted(cut.heavy, words), len(cut.heavy) - 1)
        counts = np.where(cut.heavy[at] == words, cut.counts[at], counts)
    words, counts = words[counts > 0], counts[counts > 0]
    keys, values = [], []
    for piece in pieces:
        own, per_word, contexts, n = _unpack(piece)
        use = n > 0
        keys.append((np.repeat(np.searchsorted(words, own), per_word)[use].astype(np.uint64) << np.uint64(32)) | contexts[use])
        values.append(n[use].astype(np.int64))
    pairs, pair_counts = _summed(np.concatenate(keys), np.concatenate(values))
    del keys, values
    handle, path = tempfile.mkstemp(suffix=".trie")
    os.close(handle)
    try:
        Trie.write(path, words, counts, pairs, pair_counts, total)
        return Trie(path)
    finally:
        os.unlink(path)  # the mapping outlives the name, and nothing stays behind


def _answer(cut: Cut, total: int):
    unknown = code(np.log10(np.array([MU / (total + 1)])))[0]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        trie = _trie(list(group["packed"]), cut, total)
        out = []
        for packed in group["packed"]:
            words, per_word, contexts, _ = _unpack(packed)
            rank, known = trie.find(words)
            counts = np.where(known, trie.counts[rank] if trie.words.n else 0, 0).astype(np.uint64)
            plain = np.where(known, trie.unseen[rank] if trie.words.n else 0, unknown).astype(np.uint16)
            codes, ask = np.repeat(plain, per_word), np.repeat(known, per_word)
            if ask.any():
                place, found = trie.above(np.repeat(rank, per_word)[ask], contexts[ask])
                got = codes[ask]
                got[found] = trie.seen[place[found]]
                codes[ask] = got
            out.append(counts.tobytes() + codes.tobytes())
        return group[["batch", "shard", "state"]].assign(words=[int(np.frombuffer(x, np.uint32, 1)[0]) for x in group["packed"]], answer=out)

    return run


def _total(cut: Cut, total: int, distinct: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("shard")
        state = next(x for x in group["state"] if x)
        tokens, words, docs, size = (int(x) for x in np.frombuffer(state, np.int64, 4))
        hashes, meta = np.frombuffer(state, np.uint64, words, 32), np.frombuffer(state, np.int64, 3 * docs, 32 + 8 * words).reshape(-1, 3)
        ids = _unsqueeze(memoryview(state)[-size:], tokens)
        lay = Layout(ids, hashes, cut)
        counts, codes = np.zeros(words), np.empty(len(lay.word), np.uint16)
        at = pair = 0
        for n, answer in zip(group["words"], group["answer"], strict=True):
            counts[lay.word[lay.first[at : at + n]]] = np.frombuffer(answer, np.uint64, n)
            got = np.frombuffer(answer, np.uint16, -1, 8 * n)
            codes[pair : pair + len(got)] = got
            at, pair = at + n, pair + len(got)
        if (at, pair) != (len(lay.first), len(lay.word)):
            raise RuntimeError("a batch's answers do not fit its pairs")
        ends = np.flatnonzero(ids == 0)
        starts = np.r_[0, ends[:-1] + 1]
        known, base, under = counts > 0, np.log10(counts + 0.1) - np.log10(total + 0.1 * (distinct + 1)), np.log10(counts + MU)
        n_known, base_score, score = np.empty(docs, np.int64), np.empty(docs), np.empty(docs)
        steps = np.flatnonzero(np.diff(starts // STEP_TOKENS, prepend=-1))
        for i, j in itertools.pairwise(np.r_[steps, docs].tolist()):  # whole texts, whose sums so do not depend on the steps
            some = slice(starts[i], ends[j - 1] + 1)
            by_text = lambda x: np.add.reduceat(x, starts[i:j] - starts[i])  # noqa: B023, E731
            n_known[i:j] = by_text(known[ids[some]].astype(np.int64))
            base_score[i:j] = by_text(base[ids[some]])
            score[i:j] = by_text(value(codes[lay.place[some]]) - under[np.r_[0, ids[some][:-1]]])
        return pd.DataFrame(
            {
                "doc_id": pd.arrays.IntegerArray(meta[:, 0].copy(), meta[:, 1] != 0),
                "held_out": meta[:, 2] == 0,
                "n_tokens": ends + 1 - starts,
                "n_known": n_known,
                "train_tokens": np.full(docs, total),
                "base_score": base_score,
                "score": score,
            }
        )

    return run


def lm_scores(docs: DataFrame, folds: int = FOLDS, shard_tokens: int = SHARD_TOKENS, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Fold 0 is held out."""
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(F.col("doc_id").cast("long"), (crc % folds != 0).alias("train"), text_bytes().alias("b"))
    words = rows.mapInArrow(_count(COUNT_WORDS), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    sums = checkpoint(words.mapInArrow(_sums(shard_tokens // 4), "word long, n long, every long, words long"))
    total, every, distinct = sums.filter("word is null").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "every", "words")]).first()
    # fewer than HEAVY_WORDS words can have so large a part of all tokens
    heavy = sums.filter(F.col("word").isNotNull() & (F.col("n") > total // HEAVY_WORDS)).toPandas()
    hashes, counts = heavy["word"].to_numpy(np.int64).view(np.uint64), heavy["n"].to_numpy(np.int64)
    order = np.argsort(hashes)
    cut = Cut(max(LEAST_SHARDS, -(-every // shard_tokens)), hashes[order], counts[order], -(-4 * counts[order] // shard_tokens).astype(np.uint64))
    packed = rows.mapInArrow(_pack(cut, batch_tokens), "shard int, batch long, packed binary, state binary")
    answers = packed.groupBy("shard").applyInPandas(_answer(cut, total), "batch long, shard int, state binary, words long, answer binary")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return answers.groupBy("batch").applyInPandas(_total(cut, total, distinct), schema)
