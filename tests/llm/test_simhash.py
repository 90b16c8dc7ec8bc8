import numpy as np
import pytest
import xxhash

from folium.llm import simhash as sh


def plain(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).replace("\v", " ").split()]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def roots(fps):
    parent = list(range(len(fps)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(fps)):
        for j in range(i):
            if bin(int(fps[i]) ^ int(fps[j])).count("1") <= sh.RADIUS:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(fps))]


@pytest.mark.parametrize("text", ["", "  \n", "One", "a B", "a b c", "A b c d a b c", "é è ê " * 9, "x y z w " * 200])
def test_fingerprint(text):
    assert sh.fingerprint(text.encode()) == plain(text)


def test_search_against_all_pairs(spark):
    rng = np.random.default_rng(11)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64) * 2
    near = [b ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, k, False).astype(np.uint64)) for b in base for k in (1, 2, 3, 4, 5)]
    dense = [base[0] ^ (np.uint64(1) << np.uint64(k)) for k in range(40)]  # more than SMALL meet
    fps = np.unique(np.concatenate([base, near, dense, [np.uint64(0)]]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    linked = {r.node: r.root for r in sh.components(sh.near_links(df, len(fps))).collect()}
    signed, own = fps.view(np.int64), roots(fps)
    groups, want = {}, {}
    for f, r in zip(signed.tolist(), own, strict=True):
        groups.setdefault(linked.get(f, f), set()).add(f)
        want.setdefault(r, set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_near_duplicates(spark):
    text = " ".join(f"w{k}" for k in range(400))
    rows = [(7, text, "a"), (3, text + " tail", "b"), (9, text, "c"), (4, None, "d"), (5, " ", "e"), (6, "other words here", "f"), (6, "other words here", "f"), (None, "alone in the world", "g")]
    d = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in sh.near_duplicates(d).collect()), key=str)
    fps = {(i, t): plain(t or "") for i, t, _ in rows}
    assert sorted(((i, f"{fps[i, t]:016x}") for i, t, _ in rows), key=str) == [(a, b) for a, b, _ in got]
    close = bin(plain(text) ^ plain(text + " tail")).count("1") <= 3
    by = {(a, b): c for a, b, c in got}
    assert by[9, f"{plain(text):016x}"] == (3 if close else 7) and by[5, "0" * 16] == 4
    kept = sh.one_of_each(d)
    assert kept.columns == d.columns and kept.count() == (5 if not close else 4)
    assert sh.near_duplicates(d.limit(0)).count() == 0


def test_long_chain_of_links(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 100)], "a long, b long")
    got = {r.node: r.root for r in sh.components(edges).collect()}
    assert {got[k] for k in range(41)} == {0} and got[101] == 100
