"""Change operations of ordered sets of revisions: rows of compared edges folded by operation key, natively."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as C
from .compare import HUNKS, documents

#: Wire names as the keys of added text spell them (fixed values).
STRUCTURE_NAMES = {"paragraph": "Paragraph", "list-item": "ListItem", "table-row": "TableRow"}


def edge_columns(set_col: str) -> list[str]:
    return [set_col, "edge_index", "from_revision", "to_revision", "from_ordinal", "to_ordinal"]


def operation(phase: int, order: Column, ordinal: Column, key: Column, source: Column, kind: Column, page: Column, **more: Column) -> Column:
    """A change of one edge, as all three sources tell it; ``place`` orders the changes of a set."""
    place = F.struct(F.col("edge_index"), order.cast("int").alias("order"), F.lit(phase).alias("phase"), F.col("pair_index"), ordinal.cast("int").alias("ordinal"))
    none = {"structure": "string", "before_text": "string", "after_text": "string", "changed_pixels": "long", "hunks": HUNKS}
    fields = {k: more.get(k, F.lit(None)).cast(t) for k, t in none.items()}
    fields |= {"before_page": more.get("before_page", F.col("before_page")), "after_page": more.get("after_page", F.col("after_page")), "changed_lines": more.get("changed_lines", F.lit(0))}
    own = {"place": place, "op_key": key, "source": source, "kind": kind, "page_index": page, "from_revision": F.col("from_revision"), "to_revision": F.col("to_revision"), "from_ordinal": F.col("from_ordinal"), "to_ordinal": F.col("to_ordinal")}
    return F.struct(*[c.alias(k) for k, c in (own | fields).items()])


def text_operations() -> Column:
    """Of a page pair, an operation for each review block."""
    shown = F.create_map(*[F.lit(x) for kv in STRUCTURE_NAMES.items() for x in kv])
    page = F.coalesce("before_page", "after_page", "pair_index")

    def one(b: Column, k: Column) -> Column:
        added = F.concat_ws(":", F.lit("text"), "to_revision", page, F.lit("added"), C.variant_key(F.coalesce(b["after_text"], F.lit(""))), shown[b["structure"]])
        key = F.when(b["kind"] == "added", added).otherwise(F.concat_ws(":", F.lit("text"), "from_revision", page, b["id"]))
        texts = {n: b[n] for n in ("structure", "before_text", "after_text", "changed_lines", "hunks")}
        return operation(0, F.lit(-1), k, key, F.lit("text"), b["kind"], page, **texts)

    return F.transform(F.coalesce("blocks", F.array()), one)


def figure_operations() -> Column:
    """Of a page pair, an operation for each figure."""

    def one(f: Column, k: Column) -> Column:
        owner = F.when(f["status"] == "added", F.col("to_revision")).otherwise(F.col("from_revision"))
        key = F.concat_ws(":", F.lit("figure"), owner, "pair_index", f["id"])
        pages = {"before_page": F.coalesce("before_page", "pair_index"), "after_page": F.coalesce("after_page", "pair_index")}
        return operation(1, F.col("pair_index"), k, key, F.lit("figure"), f["status"], F.coalesce("before_page", "after_page", "pair_index"), **pages)

    return F.transform(F.coalesce("figures", F.array()), one)


def page_kind(status: Column) -> Column:
    return F.when(status == "inserted", "added").when(status == "deleted", "removed").when(status == "moved", "moved").otherwise("visual")


def page_operation() -> Column:
    """Of a page pair, one operation if it is inserted, deleted or moved, or modified without text rows and figures."""
    silent = (F.coalesce(F.size("blocks"), F.lit(0)) <= 0) & (F.coalesce(F.size("figures"), F.lit(0)) <= 0)
    status, kind = F.col("status"), page_kind(F.col("status"))
    owner = F.when(status == "inserted", F.col("to_revision")).otherwise(F.col("from_revision"))
    page = F.coalesce("after_page", "before_page", "pair_index")
    source = F.when(kind == "visual", "visual").otherwise("page")
    one = operation(2, F.col("pair_index"), F.lit(0), F.concat_ws(":", F.lit("page"), owner, page, kind), source, kind, page, changed_pixels=F.col("changed_pixels"))
    return F.filter(F.array(one), lambda _: status.isin("inserted", "deleted", "moved") | ((status == "modified") & silent))


def state(kind: Column) -> Column:
    return F.when(kind == "added", "introduced").when(kind.isin("removed", "moved", "reflowed", "swapped"), kind).otherwise("modified")


def change_operations(pages: DataFrame, set_col: str = "set_id") -> DataFrame:
    """op_key, id, kind, source, page_index, structure, anchors, variants, comparisons, visual evidence per operation.

    ``pages`` is a compared edge table with set_id, edge_index, from_revision, to_revision, and the revisions' ordinals.
    The first row of a key, by edge, source and place, gives source, page and number; kinds that differ diverge; the
    first anchor of each revision counts; the latest edge's visual evidence counts; one comparison per edge. Anchors
    stand in the order of the revisions; variants (anchor texts that aren't blank, told apart by their normalised form)
    in the order in which they were first seen, each with its revisions and anchors.

    All rows of a set meet in one shuffle; a set has at most 64 revisions.
    """
    if "from_ordinal" not in pages.columns:  # edges of neighbours, unless they say otherwise
        pages = pages.withColumn("from_ordinal", F.col("edge_index")).withColumn("to_ordinal", F.col("edge_index") + 1)
    every = pages.filter("status <> 'equal'").select(set_col, F.explode(F.concat(text_operations(), figure_operations(), page_operation())).alias("o"))
    ops = every.repartition(set_col).groupBy(set_col, F.col("o.op_key").alias("op_key")).agg(F.array_sort(F.collect_list("o"), by_place).alias("rows"))
    number = F.row_number().over(Window.partitionBy(set_col).orderBy(F.col("rows")[0]["place"]))
    named = ops.withColumn("id", F.concat(F.lit("change-"), number)).withColumn("seen", first_anchors(F.col("rows")))
    named = named.withColumn("seen", F.transform("seen", lambda a: a.withField("anchor_id", F.concat("id", F.lit(":anchor:"), a["revision_id"]))))
    r = F.col("rows")
    some = lambda name: F.filter(F.transform(r, lambda x: x[name]), lambda x: x.isNotNull())
    listed = F.transform("seen", lambda a: F.struct(*[a[n].alias(n) for n in ("ordinal", "revision_id", "anchor_id", "state", "page_index", "text")]))
    out = named.select(
        set_col, "op_key", "id", r[0]["place"].alias("place"), r[0]["source"].alias("source"), r[0]["page_index"].alias("page_index"),
        F.when(F.size(F.array_distinct(r["kind"])) == 1, r[0]["kind"]).otherwise("diverged").alias("kind"), F.get(some("structure"), F.lit(0)).alias("structure"),
        F.size(F.array_distinct(F.transform(r, lambda x: x["place"]["edge_index"]))).alias("comparisons"), F.transform(r, lambda x: F.struct(*[x[n].alias(n) for n in ("place", "from_revision", "to_revision", "hunks")])).alias("evidence"),
        F.aggregate(r, F.lit(0).cast("long"), lambda n, x: n + x["changed_lines"]).alias("changed_lines"), F.try_element_at(some("changed_pixels"), F.lit(-1)).alias("changed_pixels"),
        F.array_sort(listed).alias("anchors"), variants(F.col("seen"), F.col("id")).alias("variants"),
    )
    shown = F.row_number().over(Window.partitionBy(set_col).orderBy(F.col("page_index").asc_nulls_last(), "place"))
    return out.withColumn("op_ordinal", shown).drop("place")


def by_place(a: Column, b: Column) -> Column:
    return F.when(a["place"] < b["place"], -1).when(a["place"] > b["place"], 1).otherwise(0)


def first_anchors(rows: Column) -> Column:
    """Of an operation's rows in order, the first anchor of each revision, in the order of sight."""

    def sides(x: Column) -> Column:
        side = lambda who, page, text: F.struct(x[f"{who}_revision"].alias("revision_id"), x[f"{who}_ordinal"].alias("ordinal"), state(x["kind"]).alias("state"), x[page].alias("page_index"), x[text].alias("text"))
        both = F.array(F.when(x["kind"] != "added", side("from", "before_page", "before_text")), F.when(x["kind"] != "removed", side("to", "after_page", "after_text")))
        return F.filter(both, lambda a: a.isNotNull())

    return once(F.flatten(F.transform(rows, sides)), lambda a: a["revision_id"])


def once(items: Column, key: Callable[[Column], Column]) -> Column:
    """The items whose key no earlier one has."""
    return F.filter(items, lambda a, k: F.array_position(F.transform(items, key), key(a)) == k + 1)


def variants(anchors: Column, op_id: Column) -> Column:
    """The different texts of an operation's anchors, as first written, with their revisions and anchors in order of sight."""
    key = lambda a: C.variant_key(a["text"])
    told = F.filter(anchors, lambda a: a["text"].isNotNull() & (C.squeezed(a["text"]) != ""))

    def one(v: Column, k: Column) -> Column:
        own = F.filter(told, lambda a: key(a) == key(v))
        return F.struct(F.concat(op_id, F.lit(":variant-"), (k + 1).cast("string")).alias("id"), v["text"].alias("text"), F.transform(own, lambda a: a["revision_id"]).alias("revision_ids"), F.transform(own, lambda a: a["anchor_id"]).alias("anchor_ids"))

    return F.transform(once(told, key), one)


def comparisons(pages: DataFrame, set_col: str = "set_id") -> DataFrame:
    """Per edge: equal, changed pages, changed lines, truncated, pages of both revisions."""
    return documents(pages, edge_columns(set_col))


def set_verdicts(edges: DataFrame, set_col: str = "set_id") -> DataFrame:
    """Of the rows of ``comparisons``: whether all edges are equal, whether any was truncated, totals."""
    return edges.groupBy(set_col).agg(
        F.count("*").alias("edges"), F.every("equal").alias("equal"), F.bool_or("truncated").alias("truncated"),
        F.sum("changed_pages").alias("changed_pages"), F.sum("changed_lines").alias("changed_lines"),
    )


def page_counts(edges: DataFrame, set_col: str = "set_id") -> DataFrame:
    """The pages of each revision, as the last edge that has it tells."""
    side = lambda who, pages: F.struct(F.col(f"{who}_ordinal").alias("ordinal"), F.col(f"{who}_revision").alias("revision_id"), F.col(pages).alias("pages"))
    rows = edges.select(set_col, "edge_index", F.explode(F.array(side("from", "before_pages"), side("to", "after_pages"))).alias("r"))
    return rows.groupBy(set_col, "r.ordinal", "r.revision_id").agg(F.max_by("r.pages", "edge_index").alias("page_count"))
