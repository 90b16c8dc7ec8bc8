"""Contiguous shards of near-equal bytes.

Rows are dealt by ranges of the id and sorted, which fixes one global order. Each partition's total of bytes and rows
gives, as a prefix sum over partitions, where the partition begins; within it a running sum goes on. A row goes to the
shard in whose equal share of all bytes the row's middle byte lies, so shards are contiguous in the order, and
each bound lies within half a row of its target. No text moves: only ids, sizes and checksums are shuffled.

The law is ``bytes``. Copies are rows like any other here: an order by id is cut wherever the target falls.

Edge cases: a null text has no bytes and size 1, as an empty one; a null id sorts first; rows with equal ids are
ordered by checksum and size; an empty table gives an empty result; a row larger than a share leaves shards empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint, text_bytes

SHARDS = 8


def byte_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (gapless from 0 in its shard), grown_shard (null under this law)."""
    spark = docs.sparkSession
    text = text_bytes()
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", "text_crc32", "size"]
    # checkpointed with its partition number: both passes below see the same partitions
    dealt = checkpoint(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    totals = dealt.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = totals.select(
        F.col("part").alias("p"),
        F.coalesce(F.sum("bytes").over(ahead), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all_bytes"),
    )
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = dealt.withColumn("upto", F.sum("size").over(inside)).withColumn("number", F.count("*").over(inside))
    placed = summed.join(starts, F.col("part") == F.col("p")).select(
        "doc_id", "size", "text_crc32",
        F.expr("bytes_before + upto").alias("end"), F.expr("rows_before + number - 1").alias("rank"), "all_bytes",
    )
    # twice the middle byte against twice the total, in decimals: no overflow at any size
    shard = F.expr(f"cast(least({shards} - 1, ((cast(2 * end - size as decimal(38,0)) * {shards}) div (2 * cast(all_bytes as decimal(38,0))))) as int)")
    cut = checkpoint(placed.withColumn("shard", shard))
    firsts = F.broadcast(cut.groupBy("shard").agg(F.min("rank").alias("first")).withColumnRenamed("shard", "s"))  # one row a shard
    return cut.join(firsts, F.col("shard") == F.col("s")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("rank") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )

