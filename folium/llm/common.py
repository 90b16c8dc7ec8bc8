"""What the training-data operators share: checkpoints, Arrow columns, pass-through UDFs."""

from __future__ import annotations

import re
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut ``df``'s lineage with a reliable checkpoint.

    The folder is the one the session names in ``spark.checkpoint.dir``. Where none is set, a local session (tests) uses
    a temporary one; on a cluster, whose executors could not share it, that is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="folium-"))
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: str = "text"):
    """The column's UTF-8 bytes; a null text counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def id_crc(column: str = "doc_id"):
    """CRC-32 of the id written as text, the key of the held-out folds; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def struct_array(columns: dict[str, pa.Array]) -> pa.Array:
    """A struct column from named arrays."""
    return pa.StructArray.from_arrays(list(columns.values()), names=list(columns))


def free_name(df: DataFrame, stem: str) -> str:
    """``stem``, lengthened until no column of ``df`` has this name (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem
