"""The pipeline against plain versions of its stages, over the smallest tables."""

import re
import zlib
from collections import Counter

import public_tokenizers
import xxhash

import corpus_pipeline
from folium.llm.quality_classifier import quality_scores
from folium.llm.quality_rules import quality_rules

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_failed(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    inside = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
    return len(words) < 50 or 100 * len(inside) > 50 * len(words)


def fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def representatives(texts):
    """The smallest id of every component of linked fingerprints."""
    ids = sorted(texts)
    prints, parent = {i: fingerprint(texts[i]) for i in ids}, {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i for i in ids if find(i) == i}


def pieces(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = set()
    for i, text in texts.items():
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        cuts = [0] * (len(ids) % 1024 > 0) + list(range(len(ids) % 1024, len(ids), 1024))
        for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(ids)], strict=True)):
            out.add((i, k, a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b]))))
    return out


def test_every_stage_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    names, at = docs.columns, docs
    texts = lambda df: {r.doc_id: r.text or "" for r in df.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, out = texts(at), corpus_pipeline.checkpoint(stage(spark, at, SF))
        after = texts(out)
        assert out.columns == names and out.count() == len(after)
        assert all(before[i] == t for i, t in after.items())
        if name == "quality_rules":
            verdict = {r.doc_id: r for r in quality_rules(at).collect()}
            assert all(r.base_failed == base_failed(before[i]) for i, r in verdict.items())
            assert set(after) == {i for i, r in verdict.items() if r.kept} and not any(base_failed(t) for t in after.values())
        elif name == "quality_classifier":
            assert set(after) == {r.doc_id for r in quality_scores(at, labels).filter("predicted = 1").collect()}
        elif name == "simhash_dedup":
            assert set(after) == representatives(before)
        else:
            assert after == before
        at = out
    rows = corpus_pipeline.run(spark, SF).toPandas()
    # the mixed order shows in the result: sequences by place begin with ever later documents
    order = {r.doc_id: k for k, r in enumerate(at.collect())}
    head = rows.assign(at=rows.doc_id.map(order)).groupby("sequence_id").agg(at=("at", "min"), place=("place", "first")).sort_values("place")
    assert rows.groupby("sequence_id").place.nunique().max() == 1 and head["at"].is_monotonic_increasing
    assert set(rows[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == pieces(texts(at))
    s = rows.sort_values(["sequence_id", "offset"])
    assert (s.groupby("sequence_id").length.cumsum() - s.length == s.offset).all() and s.groupby("sequence_id").length.sum().max() <= 1024
