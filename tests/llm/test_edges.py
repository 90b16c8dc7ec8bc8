"""Nulls, repeated rows and ids, ties, very long texts, empty tables and clashing names where no other test has them."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folium.llm import chat
from folium.llm.mixing import mixed
from folium.llm.simhash import near_duplicates
from folium.llm.toxicity import Model, scores

SF = "/root/testdata/sf0.001"
LONG = "a word or two . " * 50_000


def test_chat_ties_repeats_long_texts_and_clashing_columns(spark):
    rows = [(1, 0, "user", "b", 1), (1, 0, "user", "a", 2), (1, 0, "user", "a", 3), (1, 1, "assistant", LONG, 4), (2, 0, None, None, 5)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns long")
    got = {r.conv_id: r for r in chat.digests(d).collect()}
    text = f"user\na\nuser\na\nuser\nb\nassistant\n{LONG}\n"
    assert got[1].turns_sha256 == hashlib.sha256(text.encode()).hexdigest() and got[1].n_turns == 4
    assert got[1].loss_chars == len(LONG) and got[1].loss_sha256 == hashlib.sha256(LONG.encode()).hexdigest() and got[2].n_turns == 1


def test_simhash_of_a_very_long_text(spark):
    d = spark.createDataFrame([(1, LONG), (2, LONG), (3, LONG + "x"), (4, "short")], "doc_id long, text string")
    got = {r.doc_id: r for r in near_duplicates(d).collect()}
    assert got[1].fingerprint == got[2].fingerprint and got[2].component_id == got[1].component_id == 1 and got[4].component_id == 4


def test_toxicity_of_a_very_long_text(spark):
    model = Model({b"vile": 3.0}, -0.5, 1.0, 0.0, (-4.0, 2.0, 1.0))
    d = spark.createDataFrame([(1, LONG + " vile vile vile vile vile vile vile " + LONG), (2, LONG), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in scores(d, model).collect()}
    assert (got[1].passages, got[1].first_word, got[1].end_word) == (1, 200_000, 200_007) and got[1].score > got[2].score  # a mark is no word
    assert got[2].passages == 0 and got[3].first_word is None


def test_mixing_rows_without_an_id(spark):
    d = spark.createDataFrame([(None, "a")] * 300 + [(k, "b") for k in range(40)] + [(7, "b")] * 5, "doc_id long, source string")
    got = mixed(d).toPandas()
    assert sorted(got.position) == list(range(345)) and got.doc_id.isna().sum() == 300


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with null, repeated and clashing everything."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = docs.filter("doc_id < 40")
    null_id = docs.filter("doc_id between 40 and 43").withColumn("doc_id", F.lit(None).cast("long"))
    same_id = docs.filter("doc_id between 44 and 46").withColumn("doc_id", F.lit(3).cast("long"))
    blank = spark.createDataFrame([(900, None, None, None, None), (901, "", "en", "s", 0), (902, LONG, "en", None, 1), (903, LONG, "en", None, 1)], docs.schema)
    names = ("mixed_id", "mixed_at", "row_place", "kept_id", "kept_hash", "row_hash", "counts", "piece", "quality", "score")
    every = some.unionByName(some.filter("doc_id < 5")).unionByName(null_id).unionByName(same_id).unionByName(blank)
    return corpus_pipeline.checkpoint(every.select("*", *[F.lit("x").alias(n) for n in names]))


def test_every_stage_takes_odd_rows(spark, odd):
    at = odd
    for name, stage in corpus_pipeline.STAGES:
        nothing = stage(spark, odd.limit(0), SF)
        assert nothing.count() == 0
        out = corpus_pipeline.checkpoint(stage(spark, at, SF))
        if name != "best_fit_packing":
            assert out.columns == odd.columns and nothing.columns == odd.columns and 0 < out.count() <= at.count()
            assert out.exceptAll(at).isEmpty()
        if name == "simhash_dedup":
            assert out.select("text").distinct().count() == out.count()
        if name == "mix_sources":
            assert out.count() == at.count()
        at = out
    rows = at.toPandas()
    assert (rows.sort_values(["sequence_id", "offset"]).groupby("sequence_id").length.sum() <= 1024).all()


def test_stages_on_the_odd_rows_themselves(spark, odd):
    """Mixing and packing drop nothing, near-dedup keeps one of each text, whatever ids and names are."""
    by = dict(corpus_pipeline.STAGES)
    assert by["mix_sources"](spark, odd, SF).count() == odd.count()
    kept = by["simhash_dedup"](spark, odd, SF)
    assert kept.filter("doc_id in (902, 903)").count() == 1 and kept.filter("doc_id is null").count() == 4
    packed = by["best_fit_packing"](spark, odd, SF)
    assert packed.filter("piece = 0").count() == odd.count()
