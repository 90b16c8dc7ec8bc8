import collections
import math
import os
import tempfile
import tracemalloc
import zlib

import numpy as np
import pytest

from folium.llm import lm


@pytest.mark.parametrize("n,universe", [(0, 10), (1, 1 << 64), (7, 8), (500, 600), (1000, 1 << 40), (300, 1 << 64)])
def test_elias_fano(n, universe):
    rng = np.random.default_rng(n)
    values = np.sort(np.array([int(x) for x in rng.integers(0, min(universe, (1 << 63) - 1), n)], np.uint64))
    ef = lm.EliasFano.of(values, universe)
    if n:
        assert (ef.access(np.arange(n)) == values).all()
        ask = np.concatenate([values, np.maximum(values, np.uint64(1)) - np.uint64(1), rng.integers(0, min(universe, (1 << 63) - 1), 50).astype(np.uint64)])
        assert (ef.successor(ask) == np.searchsorted(values, ask)).all()


def test_trie_round_trip():
    words, counts = np.array([5, 900, 1 << 63], np.uint64), np.array([2, 1, 4])
    pairs = np.array([1, 7, (1 << 32) | 7, (2 << 32) | 0, (2 << 32) | 9], np.uint64)
    handle, path = tempfile.mkstemp()
    os.close(handle)
    lm.Trie.write(path, words, counts, pairs, np.array([1, 1, 1, 2, 2]), 7)
    t = lm.Trie(path)
    os.unlink(path)
    rank, known = t.find(np.array([5, 6, 900, 1 << 63], np.uint64))
    assert known.tolist() == [True, False, True, True] and t.counts.tolist() == [2, 1, 4]
    place, found = t.above(np.array([0, 0, 1, 2, 2]), np.array([7, 9, 1, 0, 10]))
    assert found.tolist() == [True, False, False, True, False] and place[0] == 1


def scores(rows):
    held = [zlib.crc32(str(i if i is not None else "").encode()) % 10 == 0 for i, _ in rows]
    texts = [(t or "").encode().lower().split() for _, t in rows]
    uni, pair, ends = collections.Counter(), collections.Counter(), 0
    for h, t in zip(held, texts, strict=True):
        if not h:
            ends += 1
            uni.update([*t, None])
            pair.update(zip(["<s>", *t], [*t, None], strict=True))
    total, distinct, out = sum(uni.values()), len(uni), []
    for h, t in zip(held, texts, strict=True):
        tokens = [*t, None]
        base = sum(math.log10((uni[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in tokens)
        p = sum(math.log10((pair[v, w] + lm.MU * max(uni[w], 1) / (total + 1)) / ((ends if v == "<s>" else uni[v]) + lm.MU)) for v, w in zip(["<s>", *t], tokens, strict=True))
        out.append((h, len(tokens), sum(uni[w] > 0 for w in tokens), total, base, p))
    return out


@pytest.mark.parametrize("batch_tokens,shard_tokens", [(lm.BATCH_TOKENS, lm.SHARD_TOKENS), (30, 16), (500, 200)])
def test_scores_against_brute_force(spark, batch_tokens, shard_tokens):
    rng = np.random.default_rng(8)
    rows = [(k, " ".join(rng.choice(["a", "B", "cc", "d,", "É"], int(rng.integers(0, 30))))) for k in range(60)] + [(7, "a a a"), (None, None), (11, "unseen words only"), (99, "a " * 5000)]
    d = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string")
    scored = lm.lm_scores(d, batch_tokens=batch_tokens, shard_tokens=shard_tokens)
    got = sorted(((r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in scored.collect()))
    want = sorted(scores(rows))
    for g, w in zip(got, want, strict=True):
        assert g[:4] == w[:4] and abs(g[4] - w[4]) < 1e-6 and abs(g[5] - w[5]) < 0.001 * w[1] + 1e-6
    assert lm.lm_scores(d.limit(0)).count() == 0


def test_a_heavy_word_is_spread_and_pieces_are_few():
    rng = np.random.default_rng(3)
    index = {lm.END: 0} | {f"w{k}".encode(): k for k in range(1, 3000)}
    ids = np.where(rng.random(60_000) < 0.3, 1, rng.integers(1, 3000, 60_000))
    ids[-1] = 0
    hashes = np.fromiter(map(lm.xxhash.xxh64_intdigest, index), np.uint64, len(index))
    plain = lm.Cut(64, np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint64))
    heavy = lm.Cut(64, hashes[1:2], np.array([18_000]), np.array([80], np.uint64))
    before, after = (np.bincount(lm.Layout(ids, hashes, c).shard, minlength=64) for c in (plain, heavy))
    assert before.max() > 3 * before.mean() and after.max() < 2 * after.mean()
    out = lm._pack_batch(0, [(5, True)], np.r_[ids[:3], 0], index, lm.Cut(10_000, *[np.empty(0, np.uint64)] * 3))
    assert out.num_rows <= 4


def hard_batch(n, words=5000):
    """Token numbers of texts with one very frequent word; as in a batch, every number occurs and the last token is an end."""
    rng = np.random.default_rng(4)
    ids = np.where(rng.random(n) < 0.3, 7, np.minimum(rng.zipf(1.2, n) - 1, words - 1)).astype(np.uint32)
    ids[: words - 1], ids[-1] = np.arange(1, words), 0
    return ids, rng.integers(0, 1 << 63, words).astype(np.uint64)


@pytest.mark.parametrize("step", [1, 100, 1 << 18])
def test_a_layout_in_steps_is_the_layout_at_once(monkeypatch, step):
    monkeypatch.setattr(lm, "STEP_TOKENS", step)
    ids, hashes = hard_batch(3000, 400)
    train = np.random.default_rng(5).random(len(ids)) < 0.8
    cut = lm.Cut(16, np.sort(hashes[7:8]), np.array([900]), np.array([8], np.uint64))
    before = np.r_[0, ids[:-1]]
    many = collections.Counter(zip(ids[train].tolist(), before[train].tolist(), strict=True))
    of_shard = lambda p: int(cut.shard(hashes[[p[0]]], hashes[[p[1]]])[0])
    want = sorted(set(zip(ids.tolist(), before.tolist(), strict=True)), key=lambda p: (of_shard(p), p))
    lay = lm.Layout(ids, hashes, cut, train)
    assert list(zip(lay.word.tolist(), lay.context.tolist(), strict=True)) == want
    assert lay.shard.tolist() == [of_shard(p) for p in want] and lay.many.tolist() == [many[p] for p in want]
    lay = lm.Layout(ids, hashes, cut)
    assert (lay.word[lay.place] == ids).all() and (lay.context[lay.place] == before).all()


def test_a_batch_takes_little_memory_beyond_its_tokens():
    ids, hashes = hard_batch(1 << 21)
    tracemalloc.start()
    try:
        lm.Layout(ids, hashes, lm.Cut(64, *[np.empty(0, np.uint64)] * 3))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 32 * len(ids)  # all tokens sorted at once took 41


def test_pieces_are_handed_on_few_at_a_time(monkeypatch):
    monkeypatch.setattr(lm, "TaskContext", type("Task", (), {"get": staticmethod(lambda: type("Now", (), {"partitionId": staticmethod(lambda: 3)}))}))
    rows = lm._arrow(d=(list(range(50)), "int64"), t=([True] * 50, "bool"), b=([f"w{k} w{k + 1} again again".encode() for k in range(50)], "binary"))
    cut = lm.Cut(64, *[np.empty(0, np.uint64)] * 3)
    out = list(lm._pack(cut, 100)(iter([rows])))
    assert max(x.num_rows for x in out) <= 4 and len({b for x in out for b in x.column(1).to_pylist()}) == 3
    pairs, carried = collections.Counter(), 0
    for row in (r for x in out for r in x.to_pylist()):
        words, per_word, contexts, many = lm._unpack(row["packed"])
        pairs.update(dict(zip(zip(np.repeat(words, per_word).tolist(), contexts.tolist(), strict=True), many.tolist(), strict=True)))
        carried += bool(row["state"])
    h = lm.xxhash.xxh64_intdigest
    assert carried == 3 and sum(pairs.values()) == 250 and pairs[h(b"again"), h(b"again") & 0xFFFFFFFF] == 50
