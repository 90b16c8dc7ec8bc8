"""The training-data queries: one per operator, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import packed

    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import byte_shards

    return byte_shards(table(spark, sf_dir, "documents"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import control_conversation, digests

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digests(rows.unionByName(control_conversation(rows)))


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixed

    return mixed(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import lm_scores

    return lm_scores(table(spark, sf_dir, "documents"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_digests

    return media_digests(table(spark, sf_dir, "documents"))


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", *names)


QUERIES = {f.__name__: f for f in (op1_pack, op2_quality, op3_shard, op4_chat, op5_mix, op6_simhash, op7_toxicity, op8_lm, op9_media, op10_rules)}

#: SQL cannot express the tokenizer, the fitted models or the graph search; tests/llm holds brute-force versions.
ORACLES: dict[str, str] = {}
