"""Whole comparisons as registered queries, with SQL that tells the same verdicts from the texts alone.

The SQL uses what the binding of plain texts implies: a line is one run, lines of a page stand 16 points apart, and no
more than eight of them make a page, so that a page's changed lines always are one hunk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .queries import DOCS, EDGE, TOKEN_RE, TURNS, WS, _semantic, query
from .sources import bindings as B

COPIES = f"""{DOCS}, linked as (select lag(doc_id) over w as from_id, doc_id as to_id from docs window w as (partition by string_split(text, chr(10))[1] order by doc_id)),
edges as (select l.from_id as k1, l.to_id as k2, a.text as before, b.text as after from linked l join docs a on a.doc_id = l.from_id join docs b on b.doc_id = l.to_id)"""
TURN_EDGES = TURNS.replace("edges as (select *", "edges as (select set_id as k1, edge_index as k2, from_turn, to_turn, before, after")


def longest(n: str, rows: str) -> str:
    """SQL for the length of the longest common subsequence: one row of the table after the other, from ``hits``.

    A row never falls, so of the hits up to a place the last one counts.
    """
    return f"""case when {n} = 0 or len({rows}) = 0 then 0 else list_max(list_reduce(list_prepend(list_transform(range({n}), lambda i: 0::bigint), {rows}),
  lambda acc, hit: list_transform(range(1, len(acc) + 1), lambda j: greatest(acc[j], case when hit[j] > 0 then coalesce(acc[hit[j] - 1], 0) + 1 else 0 end)))) end"""


def hits(a: str, b: str) -> str:
    """Of each item of ``a``: the last place up to each place of ``b`` that holds it, or 0."""
    found = f"list_filter(range(1, len({b}) + 1), lambda i: {b}[i] = x)"
    return f"list_transform({a}, lambda x: list_transform([{found}], lambda f: list_transform(range(1, len({b}) + 1), lambda j: coalesce(list_max(list_filter(f, lambda i: i <= j)), 0)))[1])"


def pages_sql(edges: str) -> str:
    """``p``: a row per page pair of ``edges`` (k1, k2, before, after): status, quality, equal, changed_lines, whether there are changes."""
    side = lambda t: f"""list_filter(list_transform(list_zip({t}, range(len({t}))), lambda z: {{'t': trim(regexp_replace(z[1], '[{WS}]+', ' ', 'g')), 'k': z[2], 'n': length(z[1])}}), lambda r: r.t <> '')"""
    chars = lambda x: f"list_sum(list_transform({x}, lambda r: length(r.t)))"
    return f"""{edges},
lines as (select k1, k2, string_split(before, chr(10)) as b, string_split(after, chr(10)) as a from edges),
paged as (select k1, k2, b, a, (len(b) + 7) // 8 as nb, (len(a) + 7) // 8 as na, unnest(range(greatest((len(b) + 7) // 8, (len(a) + 7) // 8))) as i from lines),
cut as (select k1, k2, i, nb, na, i < nb as has_b, i < na as has_a, case when i < nb then b[8 * i + 1 : 8 * i + 8] else [] end as pb, case when i < na then a[8 * i + 1 : 8 * i + 8] else [] end as pa from paged),
runs as (select * exclude (pb, pa), {side('pb')} as rb, {side('pa')} as ra, contains(array_to_string(pb, ''), chr(65533)) as sb, contains(array_to_string(pa, ''), chr(65533)) as sa from cut),
toks as (select *, list_transform(rb, lambda r: r.t) as tb, list_transform(ra, lambda r: r.t) as ta,
  list_transform(rb, lambda r: regexp_extract_all(r.t, '{TOKEN_RE}')) as kb, list_transform(ra, lambda r: regexp_extract_all(r.t, '{TOKEN_RE}')) as ka from runs),
graded as (select *, flatten(kb) = flatten(ka) and kb <> ka as reflow, rb = ra as same, {longest('len(ta)', hits('tb', 'ta'))} as common from toks),
-- few tokens in common, whatever their order, rule out a flow; only the rest is worth a table
bound as (select *, case when len(tb) > 0 and len(ta) > 0 and not reflow and flatten(kb) <> flatten(ka) and common::double / greatest(len(tb), len(ta)) < 0.65
  and (len(flatten(kb)) + 1) * (len(flatten(ka)) + 1) <= 4000000 then
  list_sum(list_transform(list_distinct(flatten(kb)), lambda x: least(len(list_filter(flatten(kb), lambda y: y = x)), len(list_filter(flatten(ka), lambda y: y = x)))))
  / greatest(len(flatten(kb)), len(flatten(ka))) else 0 end as most from graded),
flowed as (select *, case when most >= 0.75 then ({longest('len(flatten(ka))', hits('flatten(kb)', 'flatten(ka)'))})::double / greatest(len(flatten(kb)), len(flatten(ka))) >= 0.75 else false end as flow from bound),
p as (select k1, k2, i as pair_index, nb, na, has_b, has_a, same as equal,
  case when not has_a then 'deleted' when not has_b then 'inserted' when same then 'equal' else 'modified' end as status,
  case when (sb and len(rb) > 0) or (sa and len(ra) > 0) then 'suspect' when len(rb) = 0 and len(ra) = 0 then 'empty' when len(rb) = 0 or len(ra) = 0 then 'partial' else 'text' end as quality,
  case when reflow then 0 when flow then 2 else len(tb) + len(ta) - 2 * common end::int as changed_lines, not same as changes from flowed),
w as (select *, concat_ws(',', case quality when 'empty' then 'text-unavailable' when 'partial' then 'text-partial' when 'suspect' then 'text-suspect' end, 'visual-not-computed') as warnings from p)"""


def verdicts_sql(keys: str) -> str:
    return f"""select {keys}, bool_and(status = 'equal') as equal, max(nb)::int as before_pages, max(na)::int as after_pages, count(*) filter (status <> 'equal') as changed_pages,
  coalesce(sum(changed_lines) filter (status <> 'equal'), 0)::bigint as changed_lines, count(*) filter (changes) as text_pages, count(*) filter (changed_lines > 0) as hunks from p group by all"""


def copies(spark: SparkSession, sf: str) -> DataFrame:
    from .plans.compare import compared

    return compared(B.copy_edges(B.documents(spark, sf)), EDGE, _semantic())


@query(f"""with {pages_sql(COPIES)} select k1 as from_id, k2 as to_id, pair_index::int as pair_index, case when has_b then pair_index::int end as before_page,
  case when has_a then pair_index::int end as after_page, status, quality, equal, changed_lines, warnings from w""")
def op_compare_semantic_only(spark: SparkSession, sf: str) -> DataFrame:
    """Statuses, extraction quality, changed lines and warnings of every page pair of documents that open alike."""
    return copies(spark, sf).select(*EDGE, "pair_index", "before_page", "after_page", "status", "quality", "equal", "changed_lines", F.concat_ws(",", "warnings").alias("warnings"))


@query(f"with {pages_sql(COPIES)} {verdicts_sql('k1 as from_id, k2 as to_id')}")
def agg_document_text_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Verdict and totals per pair of copies: the flagship summary (agg_viewer_totals, agg_changed_lines)."""
    from .plans.compare import documents

    d = documents(copies(spark, sf), EDGE)
    return d.select(*EDGE, "equal", "before_pages", "after_pages", "changed_pages", "changed_lines", "text_pages", "hunks")


@query(f"with {pages_sql(COPIES)} select k1 as from_id, k2 as to_id, bool_and(status = 'equal') as equal from p group by all")
def op_is_equal(spark: SparkSession, sf: str) -> DataFrame:
    """The fast path of equality, which stops at the first difference."""
    from .plans.compare import equal_edges

    return equal_edges(B.copy_edges(B.documents(spark, sf)), EDGE, _semantic()).select(*EDGE, "equal")


@query(f"with {pages_sql(COPIES)} select from_id, to_id, warning, count(*) as pages from (select k1 as from_id, k2 as to_id, unnest(string_split(warnings, ',')) as warning from w) group by all")
def set_distinct_warnings(spark: SparkSession, sf: str) -> DataFrame:
    """The distinct warnings of every edge, with the pages that have them."""
    return copies(spark, sf).select(*EDGE, F.explode("warnings").alias("warning")).groupBy(*EDGE, "warning").agg(F.count("*").alias("pages"))


# --- sets -----------------------------------------------------------------------------------------------------------------


def sets(spark: SparkSession, sf: str) -> DataFrame:
    from .plans.sets import comparisons
    from .queries import _sets

    return comparisons(_sets(spark, sf))


@query(f"""with {pages_sql(TURN_EDGES)} select k1 as set_id, k2 as edge_index, bool_and(status = 'equal') as equal, count(*) filter (status <> 'equal') as changed_pages,
  coalesce(sum(changed_lines) filter (status <> 'equal'), 0)::bigint as changed_lines, false as truncated from p group by all""")
def agg_set_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Per edge of every conversation: verdict, changed pages, changed lines of the diffs, whether a diff was cut short."""
    return sets(spark, sf).select("set_id", "edge_index", "equal", "changed_pages", "changed_lines", "truncated")


@query(f"""with {pages_sql(TURN_EDGES)}, e as (select k1, k2, bool_and(status = 'equal') as equal, count(*) filter (status <> 'equal') as changed_pages,
  coalesce(sum(changed_lines) filter (status <> 'equal'), 0)::bigint as changed_lines from p group by all)
select k1 as set_id, count(*) as edges, bool_and(equal) as equal, false as truncated, sum(changed_pages)::bigint as changed_pages, sum(changed_lines)::bigint as changed_lines from e group by 1""")
def agg_set_equal(spark: SparkSession, sf: str) -> DataFrame:
    from .plans.sets import set_verdicts

    return set_verdicts(sets(spark, sf))


@query(f"""with {TURN_EDGES}, r as (select k1, k2 as ordinal, from_turn as turn, before as text from edges union select k1, k2 + 1, to_turn, after from edges)
select k1 as set_id, ordinal, turn::varchar as revision_id, ((len(string_split(text, chr(10))) + 7) // 8)::int as page_count from r""")
def agg_revision_page_count(spark: SparkSession, sf: str) -> DataFrame:
    """The pages of every revision of a set, as the edges tell."""
    from .plans.sets import page_counts

    return page_counts(sets(spark, sf)).select("set_id", "ordinal", "revision_id", "page_count")


@query(f"""with {pages_sql(TURN_EDGES)}, k as (select k1, case status when 'inserted' then 'added' when 'deleted' then 'removed' else 'visual' end as kind from p where status <> 'equal')
select k1 as set_id, case when count(distinct kind) = 1 then min(kind) else 'diverged' end as kind from k group by 1""")
def agg_kind_merge(spark: SparkSession, sf: str) -> DataFrame:
    """The kind that all changed pages of a set agree on."""
    from .functions import columns as C
    from .plans.sets import page_kind
    from .queries import _sets

    k = _sets(spark, sf).filter("status <> 'equal'").select("set_id", page_kind(F.col("status")).alias("kind"))
    return k.groupBy("set_id").agg(C.merged_kind(F.col("kind")).alias("kind"))


@query(f"""with {TURN_EDGES}, both_ as (select k1, 0 as side, k2 as edge, from_turn as turn, k2 as ordinal, before as text from edges union all select k1, 1, k2, to_turn, k2 + 1, after from edges),
first as (select k1, ordinal, turn, text, min(edge * 2 + side) as seen from both_ group by all),
keyed as (select *, lower(trim(regexp_replace(text, '[{WS}]+', ' ', 'g'))) as key from first)
select k1 as set_id, md5(key) as variant, count(*) as anchors, string_agg(turn::varchar, ',' order by seen) as revisions, row_number() over (partition by k1 order by min(seen)) as number from keyed where key <> '' group by k1, key""")
def agg_variants(spark: SparkSession, sf: str) -> DataFrame:
    """The different texts of a set whose every turn is an anchor of one operation, in the order of sight."""
    from .functions import columns as C
    from .plans.sets import first_anchors, variants

    e = B.turn_edges(B.table(spark, sf, "conversations"))
    row = F.struct(
        "edge_index", F.lit("modified").alias("kind"), F.col("from_turn").cast("string").alias("from_revision"), F.col("to_turn").cast("string").alias("to_revision"), F.col("edge_index").alias("from_ordinal"),
        (F.col("edge_index") + 1).alias("to_ordinal"), F.lit(0).alias("before_page"), F.lit(0).alias("after_page"), F.col("before").alias("before_text"), F.col("after").alias("after_text"),
    )
    g = e.groupBy("set_id").agg(F.array_sort(F.collect_list(row)).alias("rows")).withColumn("seen", first_anchors(F.col("rows")))
    seen = F.transform("seen", lambda a: a.withField("anchor_id", F.concat(F.lit("change-1:anchor:"), a["revision_id"])))
    v = g.withColumn("seen", seen).select("set_id", F.posexplode(variants(F.col("seen"), F.lit("change-1"))).alias("k", "v"))
    return v.select("set_id", F.md5(C.variant_key(F.col("v.text"))).alias("variant"), F.size("v.anchor_ids").alias("anchors"), F.concat_ws(",", "v.revision_ids").alias("revisions"), (F.col("k") + 1).alias("number"))
