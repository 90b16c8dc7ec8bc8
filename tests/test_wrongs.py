"""Cases that once went wrong: caps, crashes, orders, and two definitions of one thing."""

import random

import pytest
from pyspark.sql import functions as F

from folium.functions import columns as C
from folium.functions import words
from folium.options import Limits, Options
from folium.plans.compare import compared, documents, equal_edges
from folium.plans.sets import change_operations, comparisons, edge_columns, page_counts

KEYS = ["k"]
TEXT = dict(mode="semantic", render="none")
HARD = [
    "", " ", "a b", "\u001ca\u001db", "x y　z", "हिन्दी में पाठ", "naïve_1 — café", "1 2 3 4 5 6 7 8", "Page 1 2 of 3  4", "a 1 2 b 3", "é́x", "٣٤ ٥",
    "​zero", "- item", "• x", "a) b", "tab\there", "end. ", "(a, b)", " ", "𝒜 math 𝟙",
]


def edges(spark, *pairs):
    return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k long, before string, after string")


def test_columns_and_kernels_agree(spark):
    rng = random.Random(5)
    texts = HARD + ["".join(rng.choice("1 2 ab \u001c.-(٣ि") for _ in range(rng.randint(0, 14))) for _ in range(600)]
    t = F.col("t")
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select(
        "t", C.squeezed(t).alias("s"), C.tokens(t).alias("k"), C.role_key(t).alias("r"), C.variant_key(t).alias("v"), C.is_list_marker(t).alias("m"), C.marked(t, "<", ">").alias("x")
    )
    for r in rows.collect():
        assert r.s == words.squeeze(r.t) and r.k == words.tokens(r.t), repr(r.t)
        assert r.r == words.role_key(r.t) and r.v == words.variant_key(r.t) and r.m == words.is_list_marker(r.t), repr(r.t)
        assert r.x == words.marked(r.t, "<", ">"), repr(r.t)


def test_flow_of_many_lines(spark):
    rows = [["a", "", "b"], ["(", "x", ")", "."], [], ["", ""], ["one"], [f"w{k}" for k in range(20_000)]]
    got = spark.createDataFrame([(r,) for r in rows], "l array<string>").select("l", C.flow(F.col("l")).alias("f")).collect()
    assert all(r.f == words.flow(r.l) for r in got)


def test_a_long_row_of_numbers_in_a_role_key():
    assert words.role_key("1 2 3 4 5 6 7 8") == "########"


def test_one_edge_over_the_limit_fails_alone(spark):
    long = "\n".join(f"line {k}" for k in range(8009))
    e = edges(spark, (long, long), ("a", "b"))
    got = {r.k: r for r in documents(compared(e, KEYS, Options(**TEXT)), KEYS).collect()}
    assert got[0].equal is None and got[0].error == "page-limit-exceeded" and got[1].equal is False and got[1].error is None
    fast = {r.k: r for r in equal_edges(e, KEYS, Options(**TEXT)).collect()}
    assert (fast[0].equal, fast[0].error, fast[1].equal) == (None, "page-limit-exceeded", False)
    assert documents(compared(e, KEYS, Options(**TEXT, limits=Limits(pages=None))), KEYS).filter("k = 0").first().equal


def test_fast_equality_with_pages_paired_in_sequence(spark):
    a, b = "\n".join(f"line {k}" for k in range(16)), "\n".join(f"line {k}" for k in range(24))
    o = Options(**TEXT, page_matching="sequence")
    assert [r.equal for r in equal_edges(edges(spark, (a, a), (a, b)), KEYS, o).orderBy("k").collect()] == [True, False]


def test_replaced_characters_are_suspect(spark):
    r = compared(edges(spark, ("a�", "a")), KEYS, Options(**TEXT)).first()
    assert r.quality == "suspect" and "text-suspect" in r.warnings


def test_edges_without_pages_have_a_verdict(spark):
    e = spark.createDataFrame([(0, [], []), (1, None, None)], "k long, before array<struct<page_index:int,text:string,bounds:struct<x:double,y:double,width:double,height:double>>>, after array<struct<page_index:int,text:string,bounds:struct<x:double,y:double,width:double,height:double>>>")
    got = documents(compared(e, KEYS, Options(**TEXT)), KEYS).collect()
    assert len(got) == 2 and all(r.equal and r.changed_pages == 0 for r in got)


def twelve(spark):
    texts = [f"constant line\nversion {k}" for k in range(12)]
    rows = [("s", k, str(k), str(k + 1), k, k + 1, texts[k], texts[k + 1]) for k in range(11)]
    e = spark.createDataFrame(rows, "set_id string, edge_index int, from_revision string, to_revision string, from_ordinal int, to_ordinal int, before string, after string")
    return compared(e, edge_columns("set_id"), Options(**TEXT))


def test_anchors_and_variants_follow_the_revisions(spark):
    pages = twelve(spark)
    ops = change_operations(pages).collect()
    assert ops
    for o in ops:
        order = [int(a.revision_id) for a in o.anchors]
        assert order == sorted(order) and [a.anchor_id for a in o.anchors] == [f"{o.id}:anchor:{k}" for k in order]
        assert [v.id for v in o.variants] == [f"{o.id}:variant-{k + 1}" for k in range(len(o.variants))]
        texts = [a.text for a in o.anchors if a.text]
        assert [v.text for v in o.variants] == list(dict.fromkeys(texts)) and all(len(v.revision_ids) == len(v.anchor_ids) for v in o.variants)
    assert any([int(a.revision_id) for a in o.anchors] == [9, 10] for o in ops)
    c = comparisons(pages)
    assert c.count() == 11 and [r.page_count for r in page_counts(c).collect()] == [1] * 12


@pytest.mark.parametrize("hot", [2, 10_000])
def test_copies_of_a_hot_opening(spark, monkeypatch, hot):
    from folium.sources import bindings as B

    monkeypatch.setattr(B, "HOT", hot)
    rng = random.Random(1)
    rows = [(k * rng.choice([1, 7]) + k, rng.choice(["hot", "hot", "cold", f"own {k}"]) + f"\n{k}") for k in range(200)]
    rows = list(dict(rows).items())
    last, want = {}, set()
    for i, t in sorted(rows):
        key = t.split("\n")[0]
        if key in last:
            want.add((last[key][0], i, last[key][1], t))
        last[key] = (i, t)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in B.copy_edges(d).collect()} == want and B.copy_edges(d).count() == len(want)
    ids = dict(rows)
    assert {tuple(r) for r in B.next_id_edges(d).collect()} == {(i, i + 1, t, ids[i + 1]) for i, t in rows if i + 1 in ids}
