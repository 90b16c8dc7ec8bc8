"""Sessions: lazily compared edges with memoised results, cached previews, progress and cancellation."""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import raster
from ..options import ComparisonError, Options, set_edges
from .compare import character_raster, compared, documents, equal_edges, revision
from .sets import change_operations, edge_columns


class PreviewCache:
    """PNG files by key, least recently used ones leave beyond a number of bytes."""

    def __init__(self, most: int = 64 * 1024 * 1024):
        self.most, self.held, self.files = most, 0, OrderedDict()
        self.hits = self.misses = self.evictions = 0

    def get(self, key: str, make: Callable[[], bytes]) -> bytes:
        if key in self.files:
            self.hits += 1
            self.files.move_to_end(key)
            return self.files[key]
        self.misses += 1
        data = make()
        if len(data) <= self.most:
            self.files[key] = data
            self.held += len(data)
            while self.held > self.most:
                self.held -= len(self.files.popitem(last=False)[1])
                self.evictions += 1
        return data


class Session:
    """Edges (keys, before, after as run arrays) under one set of options; nothing runs before it is asked for."""

    def __init__(self, edges: DataFrame, keys: tuple[str, ...], options: Options, size: tuple[float, float] = (612.0, 152.0), cache_bytes: int = 64 * 1024 * 1024):
        self.edges, self.keys, self.options, self.size = edges, keys, options, size
        self.previews, self.tag = PreviewCache(cache_bytes), f"folium-{uuid.uuid4().hex}"
        self._pages: DataFrame | None = None
        self._equal: DataFrame | None = None

    def pages(self) -> DataFrame:
        """Compared page pairs, kept for later questions."""
        if self._pages is None:
            self._pages = compared(self.edges, self.keys, self.options, self.size).persist()
        return self._pages

    def equal(self) -> DataFrame:
        """Verdicts; of a comparison that was made already, else by the fast path."""
        if self._pages is not None:
            return documents(self._pages, self.keys).select(*self.keys, "equal")
        if self._equal is None:
            self._equal = equal_edges(self.edges, self.keys, self.options, self.size).persist()
        return self._equal

    def run(self, action: Callable[[DataFrame], object], on: DataFrame) -> object:
        """An action whose jobs ``cancel`` interrupts; a failed comparison is forgotten."""
        spark = on.sparkSession
        spark.addTag(self.tag)
        try:
            return action(on)
        except Exception:
            self.close()
            raise
        finally:
            spark.removeTag(self.tag)

    def cancel(self) -> None:
        self.edges.sparkSession.interruptTag(self.tag)

    def progress(self) -> dict[str, int]:
        """Tasks done and in all over the running stages."""
        tracker = self.edges.sparkSession.sparkContext.statusTracker()
        stages = [s for k in tracker.getActiveStageIds() if (s := tracker.getStageInfo(k))]
        return {"completed": sum(s.numCompletedTasks for s in stages), "total": sum(s.numTasks for s in stages)}

    def preview(self, key: tuple, pair_index: int, view: str = "diff") -> bytes:
        """A PNG of one page pair: before, after (shifted by the alignment) or diff."""
        if view not in ("before", "after", "diff"):
            raise ComparisonError("invalid-preview-view", view)

        def make() -> bytes:
            on = F.lit(True)
            for name, value in zip(self.keys, key, strict=True):
                on = on & (F.col(name) == value)
            row = self.edges.filter(on).first()
            pair = self.pages().filter(on & (F.col("pair_index") == pair_index)).select("before_page", "after_page").first()
            if row is None or pair is None:
                raise ComparisonError("page-index-out-of-bounds", str(pair_index))
            rows = [[r.asDict(True) for r in side] if isinstance(side, list) else side for side in (row.before, row.after)]
            sides = [revision(r, self.size, True) for r in rows]
            old, new = (s[k] if k is not None else None for s, k in zip(sides, (pair.before_page, pair.after_page), strict=True))
            old, new = (None if p is None else character_raster([r.text for r in p.runs]) if p.image is None else p.image for p in (old, new))
            old = raster.on_canvas(new[:0], new.shape[1], new.shape[0]) if old is None else old
            new = raster.on_canvas(old[:0], old.shape[1], old.shape[0]) if new is None else new
            d = raster.compare(old, new, self.options.raster, preview=True)
            image = {"diff": d.preview, "before": old, "after": raster.on_canvas(new, d.width, d.height, d.alignment.dx, d.alignment.dy)}[view]
            return raster.png(image)

        return self.previews.get(f"{key}:{pair_index}:{view}", make)

    def close(self) -> None:
        for df in (self._pages, self._equal):
            if df is not None:
                df.unpersist()
        self._pages = self._equal = None


class DocumentSet:
    """An ordered set of revisions (id, runs): its edges, and pair sessions made on demand."""

    def __init__(self, revisions: DataFrame, ids: list[str], options: Options, strategy: str = "baseline"):
        self.revisions, self.ids, self.options, self.pairs = revisions, ids, options, set_edges(ids, strategy)
        self._sessions: dict[tuple[str, str], Session] = {}

    def _edges(self, pairs: list[tuple[int, str, str]]) -> DataFrame:
        spark = self.revisions.sparkSession
        at = {name: k for k, name in enumerate(self.ids)}
        rows = [(*p, at[p[1]], at[p[2]]) for p in pairs]
        listed = F.broadcast(spark.createDataFrame(rows, "edge_index int, from_revision string, to_revision string, from_ordinal int, to_ordinal int"))  # at most 63 rows
        a = self.revisions.select(F.col("revision_id").alias("from_revision"), F.col("runs").alias("before"))
        b = self.revisions.select(F.col("revision_id").alias("to_revision"), F.col("runs").alias("after"))
        return a.join(listed, "from_revision").join(b, "to_revision").select(F.lit("set").alias("set_id"), "edge_index", "from_revision", "to_revision", "from_ordinal", "to_ordinal", "before", "after")

    def session(self, from_id: str, to_id: str) -> Session:
        if from_id == to_id or from_id not in self.ids or to_id not in self.ids:
            raise ComparisonError("invalid-options", "unknown or identical revisions")
        if (from_id, to_id) not in self._sessions:
            self._sessions[from_id, to_id] = Session(self._edges([(0, from_id, to_id)]), ("from_revision", "to_revision"), self.options)
        return self._sessions[from_id, to_id]

    def pages(self) -> DataFrame:
        """All edges compared in parallel."""
        rows = [(k, self.ids[a], self.ids[b]) for k, (a, b) in enumerate(self.pairs)]
        return compared(self._edges(rows), edge_columns("set_id"), self.options)

    def changes(self) -> DataFrame:
        """The revision-neutral change operations of the set."""
        return change_operations(self.pages())
