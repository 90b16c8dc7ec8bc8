"""Plain tables as the engine's relations, so that every operator runs without a PDF decoder.

text_run: a document's lines, eight a page, set at fixed places. edge: each document and the one with the next id, or
copies that open alike, or a conversation's adjacent turns. raster: a document's characters as grey pixels.
fingerprint: an embedding as 8 x 8 grey samples. figure: an order's lines as boxes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as C

PAGE = (612.0, 152.0)
LINES = 8
#: Ids of one range, whose texts meet in one task; and how many copies make an opening hot, which is then dealt by range.
IDS = 100
HOT, MOST_HOT = 10_000, 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def with_lines(docs: DataFrame, text: str = "text", lines: str = "lines") -> DataFrame:
    return docs.withColumn(lines, F.split(text, "\n"))


def text_run(docs: DataFrame) -> DataFrame:
    """revision_id, page_index, run_index, text, bounds."""
    rows = with_lines(docs).select(F.col("doc_id").alias("revision_id"), F.posexplode("lines").alias("k", "text"))
    y = 10 + 16 * F.col("run_index")
    return rows.select(
        "revision_id", F.expr(f"cast(k div {LINES} as int)").alias("page_index"), F.expr(f"cast(k % {LINES} as int)").alias("run_index"), "text"
    ).withColumn("bounds", C.box(F.lit(72), y, 6 * F.length("text"), F.lit(12)))


def next_id_edges(docs: DataFrame) -> DataFrame:
    """from_id, to_id, before, after: each document with the one whose id follows."""
    # dealt by ranges of ids, so a text moves once; the first of a range stands in the range before it too
    own = F.floor(F.col("doc_id") / IDS)
    ranges = F.when(F.col("doc_id") % IDS == 0, F.array(own, own - 1)).otherwise(F.array(own))
    w = Window.partitionBy("__range").orderBy("doc_id")
    rows = docs.filter("doc_id is not null").select("doc_id", "text", F.explode(ranges).alias("__range"))
    linked = rows.select(F.lag("doc_id").over(w).alias("from_id"), F.col("doc_id").alias("to_id"), F.lag("text").over(w).alias("before"), F.col("text").alias("after"))
    return linked.filter("from_id + 1 = to_id")


def copy_edges(docs: DataFrame) -> DataFrame:
    """from_id, to_id, before, after: each document and the one before it, by id, that has the same first line."""
    rows = docs.filter("doc_id is not null").withColumn("opening", F.sha2(F.substring_index("text", "\n", 1), 256))  # a line may be the whole text
    every = docs.count()
    hot = max(HOT, every // MOST_HOT)
    cells = rows.withColumn("cell", F.lit(0).cast("long"))
    ids = rows.select("opening", "doc_id")
    many = ids.groupBy("opening").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select(F.xxhash64("opening").alias("h"))
    if every > hot and not many.isEmpty():
        # a hot opening is dealt by ranges of ids; the last id of a range stands in the next one as well
        many = F.broadcast(many)  # at most MOST_HOT rows
        cell = lambda rows: rows.withColumn("h", F.xxhash64("opening")).join(many.withColumn("is_hot", F.lit(True)), "h", "left").withColumn("cell", F.when(F.col("is_hot"), F.floor(F.col("doc_id") / hot)).otherwise(0)).drop("h", "is_hot")
        last = cell(ids.withColumn("h", F.xxhash64("opening")).join(many, "h", "left_semi").drop("h")).groupBy("opening", "cell").agg(F.max("doc_id").alias("doc_id"))
        after = F.lead("cell").over(Window.partitionBy("opening").orderBy("cell"))
        again = last.select("opening", "doc_id", after.alias("cell")).filter("cell is not null").select("doc_id", "cell")
        cells = cell(rows).unionByName(rows.join(again, "doc_id"))
    w = Window.partitionBy("opening", "cell").orderBy("doc_id")
    linked = cells.select(F.lag("doc_id").over(w).alias("from_id"), F.col("doc_id").alias("to_id"), F.lag("text").over(w).alias("before"), F.col("text").alias("after"))
    return linked.filter("from_id is not null")


def turn_edges(conversations: DataFrame) -> DataFrame:
    """set_id, edge_index, from_turn, to_turn, before, after: adjacent turns of each conversation.

    The ordinals of an edge's revisions are edge_index and edge_index + 1.
    """
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = conversations.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    lagged = rows.select(
        F.col("conv_id").alias("set_id"), (F.row_number().over(w) - 2).alias("edge_index"), F.lag("turn").over(w).alias("from_turn"),
        F.col("turn").alias("to_turn"), F.lag("text").over(w).alias("before"), F.col("text").alias("after"),
    )
    return lagged.filter("edge_index >= 0")


def grey(text: str) -> np.ndarray:
    """A text's characters as grey values: 255 for white space, else the code point mod 200."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where(np.isin(points, (9, 10, 11, 12, 13, 32)), 255, points % 200)


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, samples: 64 grey values."""
    value = lambda v: F.least(F.greatest(F.floor((v.cast("double") + 0.6) * 212.5 + 0.5), F.lit(0)), F.lit(255)).cast("int")
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", value).alias("samples"))


def figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """revision_id (an order), figure_index, bounds, content_hash."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("revision_id"), (F.col("l_linenumber") - 1).alias("figure_index"),
        C.box(40 * F.col("l_linenumber"), 10 * F.col("l_quantity"), 30 + 100 * F.col("l_discount"), F.lit(40)).alias("bounds"),
        (F.col("l_suppkey") % 7).alias("content_hash"),
    )
