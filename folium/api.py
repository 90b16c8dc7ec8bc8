"""The engine's entry points: files, bytes and sets of revisions, and the kernels that stand alone.

``compare``, ``is_equal`` and ``compare_set`` take PDF files (paths that Spark's binaryFile reads) or relations of bytes;
what they return are DataFrames and sessions, so nothing is gathered on the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.matching import PageText
from .operators.matching import compare_runs as _compare_runs
from .operators.pages import Fingerprint, Pair, paired
from .operators.raster import Options as RasterOptions
from .operators.raster import RasterDiff
from .operators.raster import compare as _compare_images
from .operators.reading import Run, normalize
from .options import Limits, Options
from .plans.compare import PAGES_IN, _arrow, compared, documents, equal_edges
from .plans.session import DocumentSet, Session
from .plans.sets import comparisons, page_counts, set_verdicts
from .sources.pdf import page_structs

EDGE = ("from_revision", "to_revision")


def parsed(rows: DataFrame, limits: Limits = Limits(), content: str = "content") -> DataFrame:
    """``rows`` with a file's bytes as pages (PAGES_IN), or error and message where it cannot be read."""
    kind = f"struct<error:string,message:string,pages:{PAGES_IN}>"
    arrow = _arrow(kind)

    def run(files: pa.Array) -> pa.Array:
        return pa.array([None if not f.is_valid else page_structs(f.as_py(), limits) for f in files], arrow)

    large = F.lit(False) if limits.input_bytes is None else F.octet_length(content) > limits.input_bytes
    data = F.when(~F.coalesce(large, F.lit(True)), F.col(content))
    found = rows.withColumn("__read", F.arrow_udf(run, kind)(data)).withColumn("__large", large)
    error = F.when(F.col("__large"), "input-too-large").otherwise(F.col("__read.error"))
    return found.withColumn("pages", F.col("__read.pages")).withColumn("error", error).withColumn("message", F.col("__read.message")).drop("__read", "__large", content)


def revisions(spark: SparkSession, paths: str | Sequence[str], limits: Limits = Limits()) -> DataFrame:
    """revision_id (the path), pages, error, message of each file; a file beyond the limit of bytes isn't read."""
    files = spark.read.format("binaryFile").load([paths] if isinstance(paths, str) else list(paths))
    fits = F.lit(True) if limits.input_bytes is None else F.col("length") <= limits.input_bytes
    read = parsed(files.select(F.col("path").alias("revision_id"), F.when(fits, F.col("content")).alias("content"), fits.alias("fits")), limits)
    return read.withColumn("error", F.when(~F.col("fits"), "input-too-large").otherwise(F.col("error"))).drop("fits")


def bytes_edges(rows: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Edges from a relation with ``before`` and ``after`` as BinaryType: other columns stay, the sides become pages."""
    keys = [c for c in rows.columns if c not in ("before", "after")]
    for side in ("before", "after"):
        rows = parsed(rows, limits, side).withColumnsRenamed({"pages": f"{side}_pages_in", "error": f"{side}_error", "message": f"{side}_message"})
    return rows.select(
        *keys, F.col("before_pages_in").alias("before"), F.col("after_pages_in").alias("after"),
        F.coalesce("before_error", "after_error").alias("edge_error"), F.coalesce("before_message", "after_message").alias("edge_message"),
    )


def compare_edges(edges: DataFrame, keys: Sequence[str], options: Options = Options()) -> DataFrame:
    """``compared`` over edges with ``edge_error``: those that have one give a row with it instead."""
    good = compared(edges.filter("edge_error is null"), keys, options)
    bad = edges.filter("edge_error is not null").select(*keys, F.col("edge_error").alias("error"), F.col("edge_message").alias("message"))
    return good.unionByName(bad, allowMissingColumns=True)


def file_edges(spark: SparkSession, pairs: Iterable[tuple[str, str]], limits: Limits = Limits()) -> DataFrame:
    """Edges of pairs of paths, each file read once."""
    pairs = list(pairs)
    listed = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "edge_index int, from_path string, to_path string")
    files = [revisions(spark, p, limits).withColumn("path", F.lit(p)) for p in sorted({p for pair in pairs for p in pair})]
    rows = files[0]
    for f in files[1:]:
        rows = rows.unionByName(f)
    side = lambda who, pages: rows.select(F.col("path").alias(f"{who}_path"), F.col("pages").alias(pages), F.col("error").alias(f"{who}_error"), F.col("message").alias(f"{who}_message"))
    joined = listed.join(side("from", "before"), "from_path").join(side("to", "after"), "to_path")
    return joined.select(
        F.col("from_path").alias("from_revision"), F.col("to_path").alias("to_revision"), "before", "after",
        F.coalesce("from_error", "to_error").alias("edge_error"), F.coalesce("from_message", "to_message").alias("edge_message"),
    )


def compare(spark: SparkSession, before: str, after: str, options: Options = Options(mode="semantic")) -> DataFrame:
    """One row per page pair of two files."""
    return compare_edges(file_edges(spark, [(before, after)], options.limits), EDGE, options)


def is_equal(spark: SparkSession, before: str, after: str, options: Options = Options(mode="semantic")) -> DataFrame:
    """One row: the verdict of the fast path, or an error."""
    edges = file_edges(spark, [(before, after)], options.limits)
    bad = edges.filter("edge_error is not null").select(*EDGE, F.lit(None).cast("boolean").alias("equal"), F.col("edge_error").alias("error"))
    return equal_edges(edges.filter("edge_error is null"), EDGE, options).unionByName(bad)


class SetResult:
    """What comparing a set gives, each part computed when it is asked for."""

    def __init__(self, documents: DocumentSet):
        self.documents = documents
        self.pages = documents.pages().persist()

    def comparisons(self) -> DataFrame:
        return comparisons(self.pages)

    def verdict(self) -> DataFrame:
        return set_verdicts(self.comparisons())

    def revisions(self) -> DataFrame:
        return page_counts(self.comparisons())

    def changes(self) -> DataFrame:
        return self.documents.changes()

    def close(self) -> None:
        self.pages.unpersist()


def compare_set(revisions: DataFrame, ids: Sequence[str], options: Options = Options(mode="semantic", render="none"), strategy: str = "baseline") -> SetResult:
    """An ordered set: ``revisions`` has revision_id and pages (or runs, or text), ``ids`` their order."""
    value = next(c for c in ("pages", "runs", "text") if c in revisions.columns)
    return SetResult(DocumentSet(revisions.select("revision_id", F.col(value).alias("runs")), list(ids), options, strategy))


def render_preview(session: Session, key: tuple, pair_index: int, view: str = "diff") -> bytes:
    """A PNG of one page pair, rendered when it is asked for and kept by the session."""
    return session.preview(key, pair_index, view)


def normalize_text(runs: Sequence[Run], reading_order: str = "auto") -> list[Run]:
    """A page's lines in reading order."""
    return normalize(runs, reading_order)


def compare_runs(before: Sequence[Run], after: Sequence[Run], options: Options = Options()) -> PageText:
    """The semantic comparison of two pages' segments."""
    return _compare_runs(*(normalize(x, options.reading_order) for x in (before, after)), options.context_lines)


def compare_images(before, after, options: RasterOptions = RasterOptions(), preview: bool = False) -> RasterDiff:
    return _compare_images(before, after, options, preview)


def pair_pages(before: Sequence[Fingerprint], after: Sequence[Fingerprint], matching: str = "sequence", identical: bool = False) -> list[Pair]:
    return paired(before, after, matching, identical)


def totals(pages: DataFrame, keys: Sequence[str] = EDGE) -> DataFrame:
    """Verdict and totals of compared pages."""
    return documents(pages, keys)
