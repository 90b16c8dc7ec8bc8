"""The comparison engine's operators as registered queries, each over its whole tables, with DuckDB SQL where one exists."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import columns as C
from .sources import bindings as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str = ""):
    """Registers a query under its function's name, with its oracle."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


DOCS = "docs as (select doc_id, coalesce(text, '') as text from documents)"
#: White space and tokens in RE2's spelling; RE2 knows no Alphabetic, so letters and their marks stand for it.
WS = r"\x09-\x0d\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
TOKEN_RE = rf"[\p{{L}}\p{{N}}\p{{M}}_]+|[^{WS}]"
NORM = rf"trim(regexp_replace(text, '[{WS}]+', ' ', 'g'))"
RUNS = f"""{DOCS},
split as (select doc_id, string_split(text, chr(10)) as ls from docs),
flat as (select doc_id, unnest(ls) as text, unnest(range(len(ls))) as k from split),
runs as (select doc_id as revision_id, (k // 8)::int as page_index, (k % 8)::int as run_index, text,
  72.0 as x, 10.0 + 16 * (k % 8) as y, 6.0 * length(text) as w, 12.0 as h from flat)"""
EDGES = f"""{DOCS}, edges as (select a.doc_id as from_id, b.doc_id as to_id, a.text as before, b.text as after
  from docs a join docs b on b.doc_id = a.doc_id + 1)"""
MARKER = rf"^[{WS}]*(?:[-*•–—](?:[{WS}]|$)|(?:[0-9]+|[A-Za-z])[.)][{WS}])"
TURNS = """turns as (select conv_id as set_id, row_number() over w - 2 as edge_index, lag(turn) over w as from_turn, turn as to_turn,
  lag(coalesce(text, '')) over w as before, coalesce(text, '') as after from conversations window w as (partition by conv_id order by turn)),
edges as (select * from turns where edge_index >= 0)"""
FIGURES = """figures as (select l_orderkey as revision_id, l_linenumber - 1 as figure_index, 40.0 * l_linenumber as x, 10.0 * l_quantity as y,
  30 + 100 * l_discount as w, 40.0 as h, l_suppkey % 7 as content_hash from lineitem)"""
SIDES = f"""{FIGURES}, pairs as (select a.revision_id, a.figure_index as i, b.figure_index as j, a.x ax, a.y ay, a.w aw, a.h ah, b.x bx, b.y by_, b.w bw, b.h bh,
  a.content_hash ahash, b.content_hash bhash from figures a join figures b on b.revision_id = a.revision_id + 1),
geo as (select *, greatest(least(ax + aw, bx + bw) - greatest(ax, bx), 0) * greatest(least(ay + ah, by_ + bh) - greatest(ay, by_), 0) as inter,
  sqrt(power(ax + aw / 2 - bx - bw / 2, 2) + power(ay + ah / 2 - by_ - bh / 2, 2)) as dist from pairs)"""


# --- scalar text functions -------------------------------------------------------------------------------------------


@query(f"with {DOCS} select doc_id, md5({NORM}) as digest, length({NORM}) as chars from docs")
def str_normalize_ws(spark: SparkSession, sf: str) -> DataFrame:
    t = C.squeezed(F.col("text"))
    return B.documents(spark, sf).select("doc_id", F.md5(t).alias("digest"), F.length(t).alias("chars"))


@query(rf"""with {DOCS}, t as (select doc_id, regexp_extract_all(text, '{TOKEN_RE}') as ts from docs)
select doc_id, len(ts) as n_tokens, md5(array_to_string(ts, ' ')) as digest from t""")
def str_tokens(spark: SparkSession, sf: str) -> DataFrame:
    t = B.documents(spark, sf).select("doc_id", C.tokens(F.col("text")).alias("ts"))
    return t.select("doc_id", F.size("ts").alias("n_tokens"), F.md5(F.concat_ws(" ", "ts")).alias("digest"))


@query(f"with {DOCS} select doc_id, md5(lower({NORM})) as digest from docs")
def str_variant_key(spark: SparkSession, sf: str) -> DataFrame:
    return B.documents(spark, sf).select("doc_id", F.md5(C.variant_key(F.col("text"))).alias("digest"))


ROLE_SQL = f"regexp_replace(replace({NORM}, '#', chr(2)), '[0-9]+', '#', 'g')"
# a number keeps its place before the spaces that stood before it: sort each row of numbers and spaces by kind
ROLE_SQL = f"""lower(trim(regexp_replace(replace(list_reduce(list_prepend('', regexp_extract_all({ROLE_SQL}, '[# ]+|[^# ]+')),
  lambda a, x: a || case when contains(x, '#') then repeat('#', len(x) - len(replace(x, '#', ''))) || repeat(' ', len(replace(x, '#', ''))) else x end), chr(2), '#'), ' +', ' ', 'g')))"""


@query(f"with {RUNS} select revision_id, page_index, run_index, {ROLE_SQL} as role_key from runs")
def str_role_key(spark: SparkSession, sf: str) -> DataFrame:
    return B.text_run(B.documents(spark, sf)).select("revision_id", "page_index", "run_index", C.role_key(F.col("text")).alias("role_key"))


JOIN_SQL = """case when {l} = '' then {r} when {r} = '' then {l} else {l} ||
  case when substr({r}, 1, 1) in ('.', ',', ';', ':', '!', '?', '%', ')', ']', '}}') or right({l}, 1) in ('(', '[', '{{') then '' else ' ' end || {r} end"""


@query(f"with {DOCS} select doc_id, md5(list_reduce(string_split(text, chr(10)), lambda l, r: {JOIN_SQL.format(l='l', r='r')})) as digest from docs")
def str_flow_text(spark: SparkSession, sf: str) -> DataFrame:
    """Lines folded with str_join_line."""
    return B.with_lines(B.documents(spark, sf)).select("doc_id", F.md5(C.flow(F.col("lines"))).alias("digest"))


@query(f"with {RUNS} select revision_id, page_index, run_index, case when length(text) > 256 then text[1:256] || '...' else text end as message from runs")
def str_truncate_error(spark: SparkSession, sf: str) -> DataFrame:
    return B.text_run(B.documents(spark, sf)).select("revision_id", "page_index", "run_index", C.short_error(F.col("text")).alias("message"))


@query(rf"""with {RUNS} select revision_id, page_index, run_index, case when {NORM} = '' then text
  else regexp_replace(text, '(?s)^([{WS}]*)(.*?)([{WS}]*)$', '\1[-\2-]\3') end as marked from runs""")
def str_mark_inline(spark: SparkSession, sf: str) -> DataFrame:
    return B.text_run(B.documents(spark, sf)).select("revision_id", "page_index", "run_index", C.marked(F.col("text"), "[-", "-]").alias("marked"))


# --- runs, predicates, extraction ------------------------------------------------------------------------------------


@query(f"with {RUNS} select revision_id, page_index, count(*) as n_runs, sum(length({NORM}))::bigint as chars from runs where length({NORM}) > 0 group by all")
def flt_nonempty_run(spark: SparkSession, sf: str) -> DataFrame:
    t = B.text_run(B.documents(spark, sf)).withColumn("t", C.squeezed(F.col("text"))).filter("length(t) > 0")
    return t.groupBy("revision_id", "page_index").agg(F.count("*").alias("n_runs"), F.sum(F.length("t")).alias("chars"))


SUMMARY_SQL = f"""{RUNS}, summary as (select revision_id, page_index, count(*) as run_count, sum(length(text))::bigint as char_count,
  sum(length(text) - length(replace(text, chr(65533), '')))::bigint as replaced from runs group by all),
graded as (select *, case when run_count = 0 then 'empty' when replaced > 0 then 'suspect' else 'text' end as status from summary)"""


def summaries(runs: DataFrame) -> DataFrame:
    """Extraction summary of each page."""
    got = runs.groupBy("revision_id", "page_index").agg(
        F.count("*").alias("run_count"), F.sum(F.length("text")).alias("char_count"),
        F.sum(F.length("text") - F.length(F.replace("text", F.lit("�"), F.lit("")))).alias("replaced"),
    )
    return got.withColumn("status", F.when(F.col("run_count") == 0, "empty").when(F.col("replaced") > 0, "suspect").otherwise("text"))


@query(f"with {SUMMARY_SQL} select * from graded")
def agg_extraction_summary(spark: SparkSession, sf: str) -> DataFrame:
    return summaries(B.text_run(B.documents(spark, sf)))


@query(f"""with {SUMMARY_SQL}, a as (select * from graded), b as (select revision_id - 1 as revision_id, page_index, status, char_count from graded)
select revision_id, page_index, coalesce(a.char_count, 0) as before_chars, coalesce(b.char_count, 0) as after_chars,
  case when 'suspect' in (coalesce(a.status, 'empty'), coalesce(b.status, 'empty')) then 'suspect'
  when coalesce(a.status, 'empty') = 'empty' and coalesce(b.status, 'empty') = 'empty' then 'empty'
  when coalesce(a.status, 'empty') = 'empty' or coalesce(b.status, 'empty') = 'empty' then 'partial' else 'text' end as quality
from a full join b using (revision_id, page_index)""")
def agg_extraction_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Pages paired by index with those of the next id: quality and agg_page_char_counts."""
    s = summaries(B.text_run(B.documents(spark, sf))).select("revision_id", "page_index", "status", "char_count")
    b = s.select((F.col("revision_id") - 1).alias("revision_id"), "page_index", F.col("status").alias("after_status"), F.col("char_count").alias("after_count"))
    j = s.join(b, ["revision_id", "page_index"], "full_outer")
    empty, zero = F.lit("empty"), F.lit(0)
    return j.select(
        "revision_id", "page_index", F.coalesce("char_count", zero).alias("before_chars"), F.coalesce("after_count", zero).alias("after_chars"),
        C.quality(F.coalesce("status", empty), F.coalesce("after_status", empty)).alias("quality"),
    )


@query(f"with {RUNS} select revision_id, page_index, run_index, regexp_matches(text, '{MARKER}') as is_marker, contains(text, '|') or contains(text, chr(9)) as is_row from runs")
def prd_list_marker(spark: SparkSession, sf: str) -> DataFrame:
    """List markers, and bars or tabs of table rows (prd_list_item_run, prd_table_row_run on one-fragment runs)."""
    return B.text_run(B.documents(spark, sf)).select("revision_id", "page_index", "run_index", C.is_list_marker(F.col("text")).alias("is_marker"), C.is_table_row(F.col("text")).alias("is_row"))


ROLE = "case when y <= 24 and y + h < 152 - 24 then 'header' when y > 24 and y + h >= 152 - 24 then 'footer' end"


@query(f"with {RUNS}, r as (select *, {ROLE} as role from runs) select role, count(*) as n, sum(length(text))::bigint as chars from r where role is not null group by 1")
def prd_edge_role(spark: SparkSession, sf: str) -> DataFrame:
    r = B.text_run(B.documents(spark, sf)).withColumn("role", C.edge_role(F.col("bounds"), F.lit(B.PAGE[1])))
    return r.filter("role is not null").groupBy("role").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


CANDIDATES = f"""{RUNS}, roled as (select *, {ROLE} as role, {ROLE_SQL} as key from runs),
candidates as (select * from roled where role is not null and length(key) <= 240 and length(regexp_replace(key, '[^\\p{{L}}\\p{{N}}]', '', 'g')) >= 4),
evidence as (select revision_id, role, key, count(distinct page_index) as pages from candidates group by all having count(distinct page_index) >= 2)"""


def role_candidates(runs: DataFrame, page_height: float) -> DataFrame:
    r = runs.withColumn("role", C.edge_role(F.col("bounds"), F.lit(page_height))).withColumn("key", C.role_key(F.col("text")))
    meaningful = F.length(F.regexp_replace("key", r"[^\p{L}\p{N}]", "")) >= 4
    return r.filter(F.col("role").isNotNull() & (F.length("key") <= 240) & meaningful)


def role_evidence(candidates: DataFrame) -> DataFrame:
    """Keys that stand in the same edge band of two or more pages of a revision."""
    return candidates.groupBy("revision_id", "role", "key").agg(F.count_distinct("page_index").alias("pages")).filter("pages >= 2")


@query(f"with {CANDIDATES} select revision_id, page_index, run_index, role, key from candidates")
def flt_role_candidate(spark: SparkSession, sf: str) -> DataFrame:
    return role_candidates(B.text_run(B.documents(spark, sf)), B.PAGE[1]).select("revision_id", "page_index", "run_index", "role", "key")


@query(f"with {CANDIDATES} select revision_id, role, key, pages from evidence")
def agg_role_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return role_evidence(role_candidates(B.text_run(B.documents(spark, sf)), B.PAGE[1]))


@query(f"""with {CANDIDATES} select r.revision_id, r.page_index, r.run_index, r.role from roled r where exists (select 1 from evidence e
  where e.revision_id = r.revision_id and e.role = r.role and r.key <> '' and contains(' ' || r.key || ' ', ' ' || e.key || ' '))""")
def join_role_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Edge-band runs that are, or hold as whole words, a repeated key: op_roles' classification."""
    runs = B.text_run(B.documents(spark, sf))
    r = runs.withColumn("role", C.edge_role(F.col("bounds"), F.lit(B.PAGE[1]))).withColumn("key", C.role_key(F.col("text"))).filter("role is not null and key <> ''")
    e = role_evidence(role_candidates(runs, B.PAGE[1])).select(F.col("revision_id").alias("rid"), F.col("role").alias("erole"), F.col("key").alias("ekey"))
    inside = F.contains(F.concat(F.lit(" "), "key", F.lit(" ")), F.concat(F.lit(" "), "ekey", F.lit(" ")))
    return r.join(e, (F.col("revision_id") == F.col("rid")) & (F.col("role") == F.col("erole")) & inside, "left_semi").select("revision_id", "page_index", "run_index", "role")


@query(f"with {RUNS} select revision_id, page_index, run_index, row_number() over (partition by revision_id, page_index order by y + h / 2, x, run_index) as reading_index from runs")
def win_reading_sort(spark: SparkSession, sf: str) -> DataFrame:
    b = F.col("bounds")
    w = Window.partitionBy("revision_id", "page_index").orderBy(b.y + b.height / 2, b.x, "run_index")
    return B.text_run(B.documents(spark, sf)).select("revision_id", "page_index", "run_index", F.row_number().over(w).alias("reading_index"))


@query(f"""with {RUNS}, lagged as (select *, lag(text) over w as pt, lag(y) over w as py, lag(h) over w as ph from runs window w as (partition by revision_id, page_index order by run_index)),
marked as (select *, case when pt is not null and not (contains(pt, '|') or contains(pt, chr(9)) or contains(text, '|') or contains(text, chr(9)) or regexp_matches(text, '{MARKER}'))
  and abs(y + h / 2 - py - ph / 2) <= greatest(2.25 * greatest(h, ph, 1), 24) and (not regexp_matches(pt, '[.!?:;][{WS}]*$') or abs(y + h / 2 - py - ph / 2) <= greatest(1.35 * greatest(h, ph, 1), 16))
  then 0 else 1 end as starts from lagged)
select revision_id, page_index, run_index, sum(starts) over (partition by revision_id, page_index order by run_index)::bigint as block from marked""")
def win_block_segmentation(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks as sessions of lines: prd_can_join_lines on neighbours, then a running sum of the breaks."""
    w = Window.partitionBy("revision_id", "page_index").orderBy("run_index")
    r = B.text_run(B.documents(spark, sf)).withColumn("pt", F.lag("text").over(w)).withColumn("pb", F.lag("bounds").over(w))
    goes_on = C.continues(F.col("pt"), F.col("pb"), F.col("text"), F.col("bounds"))
    starts = F.when(F.col("pt").isNotNull() & goes_on, 0).otherwise(1)
    return r.withColumn("starts", starts).select("revision_id", "page_index", "run_index", F.sum("starts").over(w).alias("block"))


@query(f"""with {RUNS}, g as (select *, lead(y) over (partition by revision_id, page_index order by run_index) - (y + h) as gap from runs)
select revision_id, page_index, count(gap) as gaps, max(gap)::double as widest from g group by all""")
def win_gap_scan(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("revision_id", "page_index").orderBy("run_index")
    b = F.col("bounds")
    g = B.text_run(B.documents(spark, sf)).withColumn("gap", F.lead(b.y).over(w) - (b.y + b.height))
    return g.groupBy("revision_id", "page_index").agg(F.count("gap").alias("gaps"), F.max("gap").alias("widest"))


@query(f"with {RUNS} select revision_id, page_index, min(x)::double as x, min(y)::double as y, (max(x + w) - min(x))::double as width, (max(y + h) - min(y))::double as height from runs group by all")
def agg_bbox(spark: SparkSession, sf: str) -> DataFrame:
    return boxes_around(B.text_run(B.documents(spark, sf)), "revision_id", "page_index")


def boxes_around(rows: DataFrame, *keys: str) -> DataFrame:
    b = F.col("bounds")
    g = rows.groupBy(*keys).agg(F.min(b.x).alias("x"), F.min(b.y).alias("y"), F.max(b.x + b.width).alias("r"), F.max(b.y + b.height).alias("b"))
    return g.select(*keys, "x", "y", (F.col("r") - F.col("x")).alias("width"), (F.col("b") - F.col("y")).alias("height"))


def hunks(rows: DataFrame, keys: list[str], at: str, hit: str, context: int) -> DataFrame:
    """Gaps and islands: each hit with its context, merged where ranges touch."""
    spans = rows.withColumn("last", F.max(at).over(Window.partitionBy(*keys))).filter(hit).select(
        *keys, at, F.greatest(F.col(at) - context, F.lit(0)).alias("a"), F.least(F.col(at) + context + 1, F.col("last") + 1).alias("b")
    )
    w = Window.partitionBy(*keys).orderBy(at)
    reached = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    numbered = spans.withColumn("starts", F.when(F.col("a") <= reached, 0).otherwise(1)).withColumn("hunk", F.sum("starts").over(w))
    return numbered.groupBy(*keys, "hunk").agg(F.min("a").alias("first_line"), F.max("b").alias("end_line"), F.count("*").alias("changed"))


# --- edges and joins -------------------------------------------------------------------------------------------------


@query(f"with {EDGES} select from_id, to_id, sha256(before) = sha256(after) as identical, length(before) as before_chars, length(after) as after_chars from edges")
def set_identity(spark: SparkSession, sf: str) -> DataFrame:
    e = B.next_id_edges(B.documents(spark, sf))
    return e.select("from_id", "to_id", (F.sha2("before", 256) == F.sha2("after", 256)).alias("identical"), F.length("before").alias("before_chars"), F.length("after").alias("after_chars"))


PAGES = f"""{RUNS}, pages as (select revision_id, page_index, string_agg(text, chr(10) order by run_index) as body, count(*) as n from runs group by all),
paired as (select coalesce(a.revision_id, b.revision_id - 1) as from_id, coalesce(a.page_index, b.page_index) as page_index, a.page_index as before_page, b.page_index as after_page,
  a.body as before_body, b.body as after_body from (select * from pages where revision_id + 1 in (select doc_id from docs)) a
  full join (select * from pages where revision_id - 1 in (select doc_id from docs)) b on b.revision_id = a.revision_id + 1 and b.page_index = a.page_index)"""


def paired_pages(spark: SparkSession, sf: str) -> DataFrame:
    """join_index_pages: every edge's pages by index, one side null where a revision has fewer."""
    e = B.next_id_edges(B.documents(spark, sf))
    # the lines are bound to a variable, or they would be split again for each page
    chunk = lambda c: F.expr(f"transform(array(split({c}, '\\n')), x -> transform(sequence(0, (size(x) - 1) div {B.LINES}), p -> array_join(slice(x, cast(p * {B.LINES} + 1 as int), {B.LINES}), '\\n')))[0]")
    both = e.select("from_id", F.arrays_zip(chunk("before").alias("before"), chunk("after").alias("after")).alias("z"))
    rows = both.select("from_id", F.posexplode("z").alias("page_index", "z")).select("from_id", "page_index", F.col("z.before").alias("before_body"), F.col("z.after").alias("after_body"))
    side = lambda c: F.when(F.col(c).isNotNull(), F.col("page_index"))
    return rows.withColumn("before_page", side("before_body")).withColumn("after_page", side("after_body"))


@query(f"with {PAGES} select from_id, page_index, before_page, after_page from paired")
def join_index_pages(spark: SparkSession, sf: str) -> DataFrame:
    return paired_pages(spark, sf).select("from_id", "page_index", "before_page", "after_page")


STATUS = "case when after_page is null then 'deleted' when before_page is null then 'inserted' when before_body = after_body then 'equal' else 'modified' end"


def page_statuses(spark: SparkSession, sf: str) -> DataFrame:
    p = paired_pages(spark, sf)
    status = C.page_status(F.col("before_page"), F.col("after_page"), F.lit(False), F.col("before_body") == F.col("after_body"))
    return p.select("from_id", "page_index", status.alias("status"))


@query(f"with {PAGES} select from_id, page_index, {STATUS} as status from paired")
def op_page_status(spark: SparkSession, sf: str) -> DataFrame:
    return page_statuses(spark, sf)


@query(f"with {PAGES} select {STATUS} as status, count(*) as n from paired group by 1")
def agg_status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return page_statuses(spark, sf).groupBy("status").agg(F.count("*").alias("n"))


@query(f"with {PAGES}, s as (select from_id, page_index, {STATUS} as status from paired) select from_id, page_index, status from s where status <> 'equal'")
def flt_changed_page(spark: SparkSession, sf: str) -> DataFrame:
    return page_statuses(spark, sf).filter("status <> 'equal'")


@query(f"""with {PAGES}, s as (select from_id, page_index, {STATUS} as status from paired)
select from_id, bool_and(status = 'equal') as equal, count(*) filter (status <> 'equal') as changed_pages, min(case when status <> 'equal' then page_index end) as first_difference from s group by 1""")
def agg_document_equal(spark: SparkSession, sf: str) -> DataFrame:
    """Verdict per edge, changed pages, and the first unequal page (lim_first_difference)."""
    s = page_statuses(spark, sf)
    differs = F.col("status") != "equal"
    return s.groupBy("from_id").agg(F.every(~differs).alias("equal"), F.count_if(differs).alias("changed_pages"), F.min(F.when(differs, F.col("page_index"))).alias("first_difference"))


LINES_SQL = f"""{EDGES}, bl as (select from_id, unnest(string_split(before, chr(10))) as text from edges), al as (select from_id, unnest(string_split(after, chr(10))) as text from edges),
bc as (select from_id, text, count(*) as n from bl group by all), ac as (select from_id, text, count(*) as n from al group by all)"""


def edge_lines(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Distinct lines with counts of each side of every edge."""
    e = B.next_id_edges(B.documents(spark, sf))
    side = lambda c: e.select("from_id", F.explode(F.split(c, "\n")).alias("text")).groupBy("from_id", "text").agg(F.count("*").alias("n"))
    return side("before"), side("after")


@query(f"with {LINES_SQL} select from_id, text from bc join ac using (from_id, text) where bc.n = 1 and ac.n = 1")
def join_exact_text(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that are unique on both sides pair by text alone."""
    b, a = edge_lines(spark, sf)
    return b.filter("n = 1").join(a.filter("n = 1").select("from_id", "text"), ["from_id", "text"]).select("from_id", "text")


@query(f"with {LINES_SQL} select from_id, text, n from bc anti join ac using (from_id, text)")
def anti_removed(spark: SparkSession, sf: str) -> DataFrame:
    b, a = edge_lines(spark, sf)
    return b.join(a, ["from_id", "text"], "left_anti")


@query(f"with {LINES_SQL} select from_id, text, n from ac anti join bc using (from_id, text)")
def anti_added(spark: SparkSession, sf: str) -> DataFrame:
    b, a = edge_lines(spark, sf)
    return a.join(b, ["from_id", "text"], "left_anti")


@query(f"""with {EDGES}, b as (select from_id, unnest(ls) as bt, unnest(range(len(ls))) as k from (select from_id, string_split(before, chr(10)) as ls from edges)),
a as (select from_id, unnest(ls) as at_, unnest(range(len(ls))) as k from (select from_id, string_split(after, chr(10)) as ls from edges)),
z as (select from_id, k, case when at_ is null then 'removed' when bt is null then 'added' when bt = at_ then 'equal' else 'modified' end as kind from b full join a using (from_id, k))
select from_id, kind, count(*) as n from z group by all""")
def join_bounded_zip(spark: SparkSession, sf: str) -> DataFrame:
    """Lines paired by position, as the comparison of oversize pages does."""
    e = B.next_id_edges(B.documents(spark, sf))
    z = e.select("from_id", F.explode(F.arrays_zip(F.split("before", "\n").alias("b"), F.split("after", "\n").alias("a"))).alias("z"))
    kind = F.when(F.col("z.a").isNull(), "removed").when(F.col("z.b").isNull(), "added").when(F.col("z.a") == F.col("z.b"), "equal").otherwise("modified")
    return z.select("from_id", kind.alias("kind")).groupBy("from_id", "kind").agg(F.count("*").alias("n"))


TOK = "regexp_extract_all({0}, '" + TOKEN_RE.replace("{", "{{").replace("}", "}}") + "')"


@query(f"""with {EDGES}, t as (select from_id, list_transform(string_split(before, chr(10)), lambda l: {TOK.format('l')}) as b, list_transform(string_split(after, chr(10)), lambda l: {TOK.format('l')}) as a from edges)
select from_id, flatten(b) = flatten(a) and b <> a as reflow from t""")
def prd_text_reflow(spark: SparkSession, sf: str) -> DataFrame:
    e = B.next_id_edges(B.documents(spark, sf))
    return e.select("from_id", C.reflows(F.split("before", "\n"), F.split("after", "\n")).alias("reflow"))


# --- sets of revisions -------------------------------------------------------------------------------------------------


@query(f"with {TURNS} select set_id, edge_index, from_turn, to_turn from edges")
def win_adjacent_edges(spark: SparkSession, sf: str) -> DataFrame:
    return B.turn_edges(B.table(spark, sf, "conversations")).select("set_id", "edge_index", "from_turn", "to_turn")


@query("""with r as (select conv_id as set_id, turn, row_number() over (partition by conv_id order by turn) - 1 as ord from conversations),
base as (select set_id, min(turn) as from_turn from r group by 1) select set_id, ord - 1 as edge_index, from_turn, turn as to_turn from r join base using (set_id) where ord > 0""")
def join_set_edges(spark: SparkSession, sf: str) -> DataFrame:
    """The baseline strategy: the first revision against every other."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    r = B.table(spark, sf, "conversations").select(F.col("conv_id").alias("set_id"), F.first("turn").over(w).alias("from_turn"), F.col("turn").alias("to_turn"), (F.row_number().over(w) - 2).alias("edge_index"))
    return r.filter("edge_index >= 0").select("set_id", "edge_index", "from_turn", "to_turn")


@query("select conv_id as set_id, count(*) as revisions, count(distinct turn) < count(*) as repeated, count(*) between 2 and 64 as valid from conversations group by 1")
def set_distinct_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Repeated revision ids and the limits of a set (lim_set_size)."""
    c = B.table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("set_id")).agg(F.count("*").alias("revisions"), F.count_distinct("turn").alias("d"))
    return c.select("set_id", "revisions", (F.col("d") < F.col("revisions")).alias("repeated"), F.col("revisions").between(2, 64).alias("valid"))


@query(f"""with {PAGES}, s as (select from_id, page_index, after_page, {STATUS} as status from paired)
select from_id, page_index, status, row_number() over (partition by from_id order by after_page nulls last, page_index) as operation_index from s where status <> 'equal'""")
def srt_operations(spark: SparkSession, sf: str) -> DataFrame:
    """Operations by page, null last, then as they were made."""
    p = paired_pages(spark, sf)
    status = C.page_status(F.col("before_page"), F.col("after_page"), F.lit(False), F.col("before_body") == F.col("after_body"))
    w = Window.partitionBy("from_id").orderBy(F.col("after_page").asc_nulls_last(), "page_index")
    return p.withColumn("status", status).filter("status <> 'equal'").select("from_id", "page_index", "status", F.row_number().over(w).alias("operation_index"))


@query(f"""with {PAGES}, s as (select from_id, page_index, before_page, after_page, {STATUS} as status from paired where {STATUS} <> 'equal')
select from_id, case status when 'inserted' then 'added' when 'deleted' then 'removed' else 'visual' end as kind,
  case status when 'inserted' then 'introduced' when 'deleted' then 'removed' else 'modified' end as state,
  'page:' || (case when status = 'inserted' then from_id + 1 else from_id end)::varchar || ':' || coalesce(after_page, before_page)::varchar || ':' ||
  case status when 'inserted' then 'added' when 'deleted' then 'removed' else 'visual' end as op_key from s""")
def op_set_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Keys, kinds and anchor states of page operations (prj_kind_maps)."""
    p = paired_pages(spark, sf)
    status = C.page_status(F.col("before_page"), F.col("after_page"), F.lit(False), F.col("before_body") == F.col("after_body"))
    s = p.withColumn("status", status).filter("status <> 'equal'")
    kind = F.when(F.col("status") == "inserted", "added").when(F.col("status") == "deleted", "removed").otherwise("visual")
    state = F.when(F.col("status") == "inserted", "introduced").when(F.col("status") == "deleted", "removed").otherwise("modified")
    owner = F.when(F.col("status") == "inserted", F.col("from_id") + 1).otherwise(F.col("from_id"))
    return s.select("from_id", kind.alias("kind"), state.alias("state"), F.concat_ws(":", F.lit("page"), owner, F.coalesce("after_page", "before_page"), kind).alias("op_key"))


# --- rectangles and figures --------------------------------------------------------------------------------------------


def figure_pairs(spark: SparkSession, sf: str) -> DataFrame:
    f = B.figures(spark, sf)
    a = f.select("revision_id", F.col("figure_index").alias("i"), F.col("bounds").alias("a"), F.col("content_hash").alias("ahash"))
    b = f.select((F.col("revision_id") - 1).alias("revision_id"), F.col("figure_index").alias("j"), F.col("bounds").alias("b"), F.col("content_hash").alias("bhash"))
    return a.join(b, "revision_id")


@query(f"""with {SIDES} select revision_id, i, j, round(inter, 6) as intersection, round(case when least(aw * ah, bw * bh) > 0 then inter / least(aw * ah, bw * bh) else 0 end, 6) as overlap_share, round(dist, 6) as distance,
  case when inter > 0 then inter / (aw * ah + bw * bh - inter) >= 0.12 else dist <= 1.5 * greatest(aw, ah, bw, bh) end as positional,
  abs(ax - bx) <= 1.5 and abs(ay - by_) <= 1.5 and abs(aw - bw) <= 1.5 and abs(ah - bh) <= 1.5 as close,
  (greatest(least(ay + ah, by_ + bh) - greatest(ay, by_), 0) / greatest(least(ah, bh), 1) >= 0.35 or abs(ay + ah / 2 - by_ - bh / 2) <= 0.7 * greatest(least(ah, bh), 1))
    and greatest(ax - bx - bw, bx - ax - aw, 0) <= greatest(8 * greatest(least(ah, bh), 1), 32) as same_line from geo""")
def prd_positional_match(spark: SparkSession, sf: str) -> DataFrame:
    """area_intersection, sim_overlap_ratio, dist_center, prd_positional_match, prd_bounds_close, prd_same_line on figure pairs."""
    a, b = F.col("a"), F.col("b")
    return figure_pairs(spark, sf).select(
        "revision_id", "i", "j", F.round(C.overlap(a, b), 6).alias("intersection"), F.round(C.overlap_share(a, b), 6).alias("overlap_share"), F.round(C.distance(a, b), 6).alias("distance"),
        C.positional(a, b).alias("positional"), C.close(a, b).alias("close"), C.same_line(a, b).alias("same_line"),
    )


SLOT = "0.65 * inter / least(aw * ah, bw * bh) + 0.2 * least(aw * ah, bw * bh) / greatest(aw * ah, bw * bh) + 0.15 * greatest(0, 1 - dist / 64)"


@query(f"with {SIDES}, s as (select *, {SLOT} as score from geo where inter / least(aw * ah, bw * bh) >= 0.2 or dist <= 64) select revision_id, i, j, round(score, 6) as score from s where score >= 0.3")
def sim_figure_slot(spark: SparkSession, sf: str) -> DataFrame:
    p = figure_pairs(spark, sf).withColumn("score", C.slot_score(F.col("a"), F.col("b")))
    return p.filter("score is not null").select("revision_id", "i", "j", F.round("score", 6).alias("score"))


@query(f"with {SIDES} select revision_id, i, arg_min(j, (dist, j)) as nearest, round(min(dist), 6) as distance from geo where ahash = bhash group by all")
def join_figure_identity(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest figure of equal content (top1_nearest)."""
    p = figure_pairs(spark, sf).filter("ahash = bhash").withColumn("d", C.distance(F.col("a"), F.col("b")))
    return p.groupBy("revision_id", "i").agg(F.min_by("j", F.struct("d", "j")).alias("nearest"), F.round(F.min("d"), 6).alias("distance"))


@query(f"""with {SIDES}, m as (select * from geo where ahash = bhash) select distinct p.revision_id, p.i, p.j from m p join m q on q.revision_id = p.revision_id and q.i <> p.i
where not (abs(p.ax - p.bx) <= 1.5 and abs(p.ay - p.by_) <= 1.5 and abs(p.aw - p.bw) <= 1.5 and abs(p.ah - p.bh) <= 1.5)
  and greatest(least(p.bx + p.bw, q.ax + q.aw) - greatest(p.bx, q.ax), 0) * greatest(least(p.by_ + p.bh, q.ay + q.ah) - greatest(p.by_, q.ay), 0) / least(p.bw * p.bh, q.aw * q.ah) >= 0.6
  and greatest(least(q.bx + q.bw, p.ax + p.aw) - greatest(q.bx, p.ax), 0) * greatest(least(q.by_ + q.bh, p.ay + p.ah) - greatest(q.by_, p.ay), 0) / least(q.bw * q.bh, p.aw * p.ah) >= 0.6""")
def join_figure_swap(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of equal content that trade places with another such pair."""
    m = figure_pairs(spark, sf).filter("ahash = bhash")
    p, q = m.filter(~C.close(F.col("a"), F.col("b"))).alias("p"), m.alias("q")
    trades = (C.overlap_share(F.col("p.b"), F.col("q.a")) >= 0.6) & (C.overlap_share(F.col("q.b"), F.col("p.a")) >= 0.6)
    on = (F.col("p.revision_id") == F.col("q.revision_id")) & (F.col("p.i") != F.col("q.i")) & trades
    return p.join(q, on, "left_semi").select("revision_id", "i", "j").distinct()


@query("""with r as (select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_partkey, l_linenumber) as after_page from lineitem)
select l_orderkey, l_linenumber, exists (select 1 from r q where q.l_orderkey = r.l_orderkey and ((q.l_linenumber < r.l_linenumber and q.after_page > r.after_page) or (q.l_linenumber > r.l_linenumber and q.after_page < r.after_page))) as moved from r""")
def join_moved_inversion(spark: SparkSession, sf: str) -> DataFrame:
    """Two-sided pairs that cross another one. Running extremes tell it in two windows, without a self-join."""
    w = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_linenumber")
    r = B.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(w).alias("after_page"))
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    above, below = F.max("after_page").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.min("after_page").over(by.rowsBetween(1, Window.unboundedFollowing))
    return r.select("l_orderkey", "l_linenumber", (F.coalesce(above > F.col("after_page"), F.lit(False)) | F.coalesce(below < F.col("after_page"), F.lit(False))).alias("moved"))


@query(f"""with {FIGURES}, s as (select *, least(greatest(x * 612 / 1224, 0), 612) as px, least(greatest(y * 792 / 1584, 0), 792) as py from figures),
c as (select *, least(greatest(8.0 / 100 * greatest(w, h), 32), 96) as pad from s)
select revision_id, figure_index, round(px, 6) as x, round(py, 6) as y, round(least(greatest((x + w) * 612 / 1224, px), 612) - px, 6) as width, round(least(greatest((y + h) * 792 / 1584, py), 792) - py, 6) as height,
  round(greatest(x - pad, 0), 6) as crop_x, round(least(x + w + pad, 612) - greatest(x - pad, 0), 6) as crop_width from c""")
def math_scale_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Pixel boxes in page points, and focus crops (math_focus_crop)."""
    page = (612.0, 792.0)
    f = B.figures(spark, sf).withColumn("s", C.scaled(F.col("bounds"), (1224, 1584), page)).withColumn("c", C.focus_crop(F.col("bounds"), page))
    r = lambda c, n: F.round(F.col(c), 6).alias(n)
    return f.select("revision_id", "figure_index", r("s.x", "x"), r("s.y", "y"), r("s.width", "width"), r("s.height", "height"), r("c.x", "crop_x"), r("c.width", "crop_width"))


@query(f"with {FIGURES} select revision_id, figure_index, printf('%.2f:%.2f:%.2f:%.2f', x, y, w, h) as key from figures where w > 1 and h > 1")
def math_bounds_key(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of figures larger than a point (flt_figure_size)."""
    b = F.col("bounds")
    return B.figures(spark, sf).filter((b.width > 1) & (b.height > 1)).select("revision_id", "figure_index", C.bounds_key(b).alias("key"))


@query(f"with {FIGURES} select revision_id, figure_index, greatest(round(w * 144 / 72), 1)::bigint as width, greatest(round(h * 144 / 72), 1)::bigint as height from figures")
def prj_page_pixels(spark: SparkSession, sf: str) -> DataFrame:
    b = F.col("bounds")
    return B.figures(spark, sf).select("revision_id", "figure_index", C.page_pixels(b.width, 144).alias("width"), C.page_pixels(b.height, 144).alias("height"))


@query("""select o_orderstatus as phase, min(o_totalprice) as min, round(quantile_cont(o_totalprice, 0.5), 4) as p50, round(avg(o_totalprice), 4) as mean, max(o_totalprice) as max from orders group by 1""")
def agg_benchmark_summary(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("o_totalprice")
    g = B.table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("phase"))
    return g.agg(F.min(p).alias("min"), F.round(F.percentile(p, 0.5), 4).alias("p50"), F.round(F.avg(p), 4).alias("mean"), F.max(p).alias("max"))


# --- rasters and fingerprints --------------------------------------------------------------------------------------------

PIXELS = f"""{EDGES}, px as (select from_id, list_transform(regexp_extract_all(before, '(?s).'), lambda c: case when regexp_matches(c, '^[\\x09-\\x0d ]$') then 255 else ascii(c) % 200 end) as b,
  list_transform(regexp_extract_all(after, '(?s).'), lambda c: case when regexp_matches(c, '^[\\x09-\\x0d ]$') then 255 else ascii(c) % 200 end) as a from edges)"""


@query(f"""with {PIXELS} select from_id, greatest(len(b), len(a)) as pixels,
  len(list_filter(list_zip(b, a), lambda z: abs(coalesce(z[1], 255) - coalesce(z[2], 255)) > 8)) as changed,
  len(list_filter(b, lambda v: v * 10000 < 2450000)) as before_content, len(list_filter(a, lambda v: v * 10000 < 2450000)) as after_content from px""")
def agg_changed_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Changed and content pixels of every edge's character rasters without a shift; what a side lacks is white
    (prd_pixel_changed, prd_content_pixel)."""
    # by Arrow: as higher-order functions over an array of characters this took some ten times as long
    kind = pa.struct([(n, pa.int64()) for n in ("pixels", "changed", "before_content", "after_content")])

    def run(before: pa.Array, after: pa.Array) -> pa.Array:
        rows = []
        for a, b in zip(before, after, strict=True):
            x, y = B.grey(a.as_py()), B.grey(b.as_py())
            p, q = (np.pad(v, (0, max(len(x), len(y)) - len(v)), constant_values=255) for v in (x, y))
            rows.append({"pixels": len(p), "changed": int((np.abs(p - q) > 8).sum()), "before_content": int((x < 245).sum()), "after_content": int((y < 245).sum())})
        return pa.array(rows, kind)

    udf = F.arrow_udf(run, "struct<pixels:long,changed:long,before_content:long,after_content:long>")
    return B.next_id_edges(B.documents(spark, sf)).select("from_id", udf("before", "after").alias("p")).select("from_id", "p.*")


@query("""with f as (select vec_id, list_transform(embedding, lambda v: least(greatest(floor((v::double + 0.6) * 212.5 + 0.5), 0), 255)::int) as s from embeddings),
p as (select a.vec_id, list_zip(a.s, b.s) as z, len(a.s) as n from f a join f b on b.vec_id = a.vec_id + 1),
m as (select vec_id, 1 - list_sum(list_transform(z, lambda x: abs(x[1] - x[2]))) / (n * 255.0) as alike,
  len(list_filter(z, lambda x: x[1] < 245 and x[2] < 245)) as both_, len(list_filter(z, lambda x: x[1] < 245 or x[2] < 245)) as either from p)
select vec_id, round(least(greatest(0.55 * alike + 0.35 * case when either = 0 then 1 else both_::double / either end + 0.1, 0), 1), 6) as similarity from m""")
def sim_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """Similarity of each grey fingerprint and the next one; equal dimensions."""
    f = B.fingerprints(spark, sf)
    b = f.select((F.col("vec_id") - 1).alias("vec_id"), F.col("samples").alias("other"))
    z = F.arrays_zip(F.col("samples").alias("p"), F.col("other").alias("q"))
    pairs = f.join(b, "vec_id").withColumn("z", z)
    alike = 1 - F.aggregate("z", F.lit(0), lambda n, x: n + F.abs(x.p - x.q)) / (F.size("z") * 255.0)
    count = lambda test: F.size(F.filter("z", test))
    both, either = count(lambda x: C.is_ink(x.p, x.p, x.p) & C.is_ink(x.q, x.q, x.q)), count(lambda x: C.is_ink(x.p, x.p, x.p) | C.is_ink(x.q, x.q, x.q))
    score = 0.55 * alike + 0.35 * F.when(either == 0, 1.0).otherwise(both / either) + 0.1
    return pairs.select("vec_id", F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 6).alias("similarity"))


# --- the comparison as a whole -------------------------------------------------------------------------------------------


def _semantic(**more):
    from .options import Limits, Options

    return Options(**({"mode": "semantic", "render": "none", "limits": Limits(pages=None)} | more))


def _copies(spark: SparkSession, sf: str) -> DataFrame:
    """Edges with plain texts: their lines become runs behind the exchange."""
    return B.copy_edges(B.documents(spark, sf))


EDGE = ("from_id", "to_id")

LCS_SQL = """with docs as (select doc_id, coalesce(text, '') as text from documents),
linked as (select lag(doc_id) over w as from_id, doc_id as to_id from docs window w as (partition by string_split(text, chr(10))[1] order by doc_id)),
sides as (select l.from_id, l.to_id, string_split(a.text, chr(10)) as b, string_split(c.text, chr(10)) as a from linked l join docs a on a.doc_id = l.from_id join docs c on c.doc_id = l.to_id),
m as (select from_id, to_id, len(b) as n, len(a) as k, list_prepend(list_transform(range(len(a)), lambda i: 0::bigint), list_transform(b, lambda x: list_transform(a, lambda y: (x = y)::bigint))) as rows from sides)
select from_id, to_id, n, k, list_max(list_reduce(rows, lambda acc, hit: list_transform(range(1, len(acc) + 1), lambda j:
  list_max(list_transform(range(1, j + 1), lambda i: greatest(acc[i], case when hit[i] = 1 then coalesce(acc[i - 1], 0) + 1 else 0 end)))))) as lcs from m"""


@query(LCS_SQL)
def arr_lcs_table(spark: SparkSession, sf: str) -> DataFrame:
    """Longest common subsequence of the lines of copies; off the flow path a page has n + k - 2 lcs changed lines."""
    from .operators.textdiff import common_lines

    def run(before: pa.Array, after: pa.Array) -> pa.Array:
        return pa.array([common_lines(a, b) for a, b in zip(before.to_pylist(), after.to_pylist(), strict=True)], pa.int64())

    from .plans.compare import spread

    e = spread(B.copy_edges(B.documents(spark, sf)), EDGE).select("from_id", "to_id", F.split("before", "\n").alias("b"), F.split("after", "\n").alias("a"))
    return e.select("from_id", "to_id", F.size("b").alias("n"), F.size("a").alias("k"), F.arrow_udf(run, "long")("b", "a").alias("lcs"))


@query()
def op_compare_full(spark: SparkSession, sf: str) -> DataFrame:
    """With character rasters: alignment, changed pixels, regions and the page verdict."""
    from .options import Limits, Options
    from .plans.compare import compared

    p = compared(_copies(spark, sf), EDGE, Options(mode="semantic", limits=Limits(pages=None)))
    return p.select(*EDGE, "pair_index", "status", "changed_pixels", F.round("changed_ratio", 6).alias("changed_ratio"), "dx", "dy", F.round("confidence", 6).alias("confidence"), F.size("regions").alias("regions"), F.concat_ws(",", "warnings").alias("warnings"))


@query()
def join_sequence_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages paired in order by fingerprint, with moved pages (join_moved_pages, op_fingerprint)."""
    from .plans.compare import compared

    return compared(_copies(spark, sf), EDGE, _semantic(page_matching="sequence")).select(*EDGE, "pair_index", "before_page", "after_page", "moved", "status")


@query()
def op_compare_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Positioned-run changes (join_exact_text and join_positional_text in order, anti_removed, anti_added, op_matched_change)."""
    from .plans.compare import compared, text_changes

    c = text_changes(compared(_copies(spark, sf), EDGE, _semantic()), EDGE)
    return c.select(*EDGE, "pair_index", "change_ordinal", "id", "kind", "before_text", "after_text", F.round("before_focus_bounds.x", 3).alias("before_x"), F.round("after_focus_bounds.x", 3).alias("after_x"))


@query()
def op_text_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Diff lines of the pages' hunks with inline marks."""
    from .plans.compare import compared, diff_lines

    return diff_lines(compared(_copies(spark, sf), EDGE, _semantic()), EDGE)


@query()
def op_text_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Review blocks of unequal pages with roles (op_blocks, op_block_classify, op_roles, prj_review_item)."""
    from .plans.compare import compared, review_stream

    s = review_stream(compared(_copies(spark, sf), EDGE, _semantic()), EDGE)
    return s.select(*EDGE, "pair_index", "block_ordinal", "id", "side", "kind", "structure", F.round("confidence", 6).alias("confidence"), "before_text", "after_text", "before_role", "after_role", "changed_lines")


def _rendered(spark: SparkSession, sf: str, sided: bool) -> DataFrame:
    from .plans.compare import compare, revision, spread
    from .render import diff_text

    o = _semantic()

    def run(a: pa.Array, b: pa.Array, before: pa.Array, after: pa.Array) -> pa.Array:
        rows = zip(a.to_pylist(), b.to_pylist(), before, after, strict=True)
        return pa.array([diff_text(compare(revision(x.as_py()), revision(y.as_py()), o), str(i), str(j), sided) for i, j, x, y in rows], pa.string())

    return spread(_copies(spark, sf), EDGE).select(*EDGE, F.arrow_udf(run, "string")("from_id", "to_id", "before", "after").alias("diff"))


@query()
def op_render_text(spark: SparkSession, sf: str) -> DataFrame:
    return _rendered(spark, sf, False)


@query()
def op_render_inline(spark: SparkSession, sf: str) -> DataFrame:
    return _rendered(spark, sf, True)


def _sets(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation's adjacent turns compared as revisions of a set."""
    from .plans.compare import compared
    from .plans.sets import edge_columns

    e = B.turn_edges(B.table(spark, sf, "conversations"))
    revisions = [F.col("from_turn").cast("string").alias("from_revision"), F.col("to_turn").cast("string").alias("to_revision")]
    ordinals = [F.col("edge_index").alias("from_ordinal"), (F.col("edge_index") + 1).alias("to_ordinal")]
    return compared(e.select("set_id", "edge_index", *revisions, *ordinals, "before", "after"), edge_columns("set_id"), _semantic())


def _operations(spark: SparkSession, sf: str) -> DataFrame:
    from .plans.sets import change_operations

    return change_operations(_sets(spark, sf))


@query()
def op_document_set(spark: SparkSession, sf: str) -> DataFrame:
    """Change operations of every conversation's adjacent revisions (op_set_keys, op_set_anchors, agg_change_operations)."""
    return _operations(spark, sf).select("set_id", "op_ordinal", "id", "kind", "source", "page_index", "structure", "comparisons", "changed_lines", F.size("anchors").alias("anchors"), F.size("variants").alias("variants"))


@query()
def op_render_set_inline(spark: SparkSession, sf: str) -> DataFrame:
    """Every set's change operations as a revision-labelled diff."""
    from .__main__ import as_change
    from .render import set_text

    def run(ops: pa.Array) -> pa.Array:
        out = []
        for rows in ops:
            changes = [as_change(o) for o in rows.as_py() or ()]
            who = sorted({(a["ordinal"], a["revision_id"]) for c in changes for a in c["anchors"]})
            out.append(set_text([(w, f"turn {w}") for _, w in who], changes))
        return pa.array(out, pa.string())

    fields = ("op_ordinal", "id", "kind", "source", "page_index", "anchors", "evidence", "changed_pixels")
    sets = _operations(spark, sf).groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("ops"))
    return sets.select("set_id", F.arrow_udf(run, "string")("ops").alias("diff"))


TURN_TOKENS = TURNS + rf""", t as (select set_id, edge_index, before = after as same, {TOK.format('before')} as b, {TOK.format('after')} as a from edges)"""


@query(f"""with {TURN_TOKENS} select set_id, edge_index,
  list_reduce(list_prepend('0', a), lambda n, x: case when b[n::int + 1] = x then (n::int + 1)::varchar else n end)::int = len(b) as subsequence from t""")
def prd_token_subsequence(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each turn's tokens all stand in the next turn, in order."""
    e = B.turn_edges(B.table(spark, sf, "conversations"))
    return e.select("set_id", "edge_index", C.is_subsequence(C.tokens(F.col("before")), C.tokens(F.col("after"))).alias("subsequence"))


@query(f"""with {TURN_TOKENS}, s as (select *, greatest(len(a), len(b)) as most, (len(a) + 1) * (len(b) + 1) > 4096 as large from t),
m as (select *, case when large then null else list_prepend(list_transform(range(len(a)), lambda i: 0::bigint), list_transform(b, lambda x: list_transform(a, lambda y: (x = y)::bigint))) end as rows from s)
select set_id, edge_index, round(case when same or most = 0 then 1.0 when large then
  coalesce(list_min(list_filter(range(1, most + 1), lambda i: a[i] is distinct from b[i])), most + 1)::double - 1
  when len(a) = 0 or len(b) = 0 then 0.0 else
  list_max(list_reduce(rows, lambda acc, hit: list_transform(range(1, len(acc) + 1), lambda j:
  list_max(list_transform(range(1, j + 1), lambda i: greatest(acc[i], case when hit[i] = 1 then coalesce(acc[i - 1], 0) + 1 else 0 end))))))::double end
  / case when same or most = 0 then 1 else most end, 6) as similarity from m""")
def sim_text(spark: SparkSession, sf: str) -> DataFrame:
    """Token similarity of adjacent turns: common subsequence, or over the size limit the common beginning."""
    from .functions import words
    from .plans.compare import spread

    def run(before: pa.Array, after: pa.Array) -> pa.Array:
        return pa.array([words.similarity(a, b) for a, b in zip(before.to_pylist(), after.to_pylist(), strict=True)], pa.float64())

    e = spread(B.turn_edges(B.table(spark, sf, "conversations")), ("set_id", "edge_index"))
    return e.select("set_id", "edge_index", F.round(F.arrow_udf(run, "double")("before", "after"), 6).alias("similarity"))


from . import page_queries, verdict_queries  # noqa: E402,F401  register their queries
