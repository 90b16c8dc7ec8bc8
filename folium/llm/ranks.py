"""Gapless ranks within keys of any skew: salted counts, prefix sums over salts, row numbers within (key, salt)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of one (key, salt) cell, about.
CELL_ROWS = 200_000


def ranked(rows: DataFrame, key: str, order: list[str], salt: Column, out: str, salts: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` with a long ``out``: 0, 1, ... within each ``key``; and the count per key.

    ``rows`` is read twice and must be stable (checkpointed). Rows are dealt by (key, salt), so a key that holds most
    rows is spread over ``salts`` cells; the order is by salt, then ``order``. Key may be null.
    """
    salted = rows.withColumn("__salt", F.pmod(salt, F.lit(salts)).cast("int"))
    cells = salted.groupBy(key, "__salt").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(key).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select(F.col(key).alias("__key"), F.col("__salt").alias("__cell"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    number = Window.partitionBy(key, "__salt").orderBy(*order)
    numbered = salted.withColumn("__row", F.row_number().over(number))
    joined = numbered.join(starts, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__salt") == F.col("__cell")))
    ranks = joined.withColumn(out, (F.col("__start") + F.col("__row") - 1).cast("long")).select(*rows.columns, out)
    return ranks, cells.groupBy(key).agg(F.sum("__n").alias("n"))


def salts_for(count: int) -> int:
    """How many cells a key is spread over at ``count`` rows in all."""
    return max(16, -(-count // CELL_ROWS))
