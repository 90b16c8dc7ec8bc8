"""Reading order, rasters, regions and the review layer as registered queries: the kernels of ``operators`` by Arrow over
bound tables, or columns where a step is one, against SQL that computes the same by other means."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import words
from .functions import columns as C
from .functions.boxes import Box
from .operators import matching, raster, reading, review
from .operators.reading import Fragment, Run
from .queries import DOCS, EDGES, FIGURES, JOIN_SQL, MARKER, RUNS, SIDES, TOK, TURNS, WS, figure_pairs, hunks, query
from .sources import bindings as B


def mapped(rows: DataFrame, keys: list[str], kind: str, run: Callable, *columns: str | Column) -> DataFrame:
    """``keys`` and the structs of an array column that ``run`` makes of each row's values, flattened."""
    from .plans.compare import _arrow

    arrow = _arrow(f"array<struct<{kind}>>")
    udf = F.arrow_udf(lambda *values: pa.array([run(*(x.as_py() for x in row)) for row in zip(*values, strict=True)], arrow), f"array<struct<{kind}>>")
    return rows.select(*keys, F.explode(udf(*columns)).alias("__r")).select(*keys, "__r.*")


# --- reading order ---------------------------------------------------------------------------------------------------------

SPLIT_WORDS = f"""{RUNS}, w as (select revision_id, page_index, run_index, y, text, regexp_extract_all(text, '[^{WS}]+') as ws from runs)"""


def word_runs(line: str, y: float) -> list[Run]:
    """A line's words as runs 60 points apart, with a gap of 120 more after every fourth."""
    return [Run(w, Box(72.0 + 60 * k + 120 * (k // 4), y, float(min(6 * len(w), 50)), 12.0)) for k, w in enumerate(x for x in words.SPACES.split(line) if x)]


def pages_of_lines(spark: SparkSession, sf: str) -> DataFrame:
    return B.with_lines(B.documents(spark, sf)).select(F.col("doc_id").alias("revision_id"), "lines")


def _grouped(lines: list[str]) -> list[dict]:
    out = []
    for p in range(0, len(lines), B.LINES):
        runs = [r for k, t in enumerate(lines[p : p + B.LINES]) for r in word_runs(t, 10.0 + 16 * k)]
        for k, members in enumerate(reading.grouped(reading.clean(runs))):
            line = reading.line_of(members)
            out.append({"page_index": p // B.LINES, "line": k, "n": len(members), "digest": hashlib.md5(line.text.encode()).hexdigest(), "x": line.box.x, "y": line.box.y, "width": line.box.width})
    return out


@query(f"""with {SPLIT_WORDS}, parts as (select revision_id, page_index, run_index, y, ws, unnest(range((len(ws) + 3) // 4)) as g from w where len(ws) > 0),
lines as (select *, ws[4 * g + 1 : 4 * g + 4] as own from parts)
select revision_id, page_index, (row_number() over (partition by revision_id, page_index order by run_index, g) - 1)::int as line, len(own)::int as n,
  md5(list_reduce(own, lambda l, r: {JOIN_SQL.format(l='l', r='r')})) as digest, 72.0 + 360 * g as x, y, (60.0 * (len(own) - 1) + least(6 * length(own[-1]), 50))::double as width from lines""")
def win_line_grouping(spark: SparkSession, sf: str) -> DataFrame:
    """Words to lines: grouped by level and gap, then joined left to right (win_line_concat, op_normalize_runs)."""
    kind = "page_index:int,line:int,n:int,digest:string,x:double,y:double,width:double"
    return mapped(pages_of_lines(spark, sf), ["revision_id"], kind, _grouped, "lines")


def in_columns(lines: list[str]) -> list[Run]:
    """Lines by turns in a left and a right column; long ones reach over the gap. A run's text is its number."""
    kept = [(k, words.squeeze(t)) for k, t in enumerate(lines)]
    return [Run(str(k), Box(10.0 if k % 2 == 0 else 320.0, 10.0 + 16 * (k // 2), float(min(6 * len(t), 400)), 12.0)) for k, t in kept if t]


def _columns(lines: list[str]) -> list[dict]:
    out = []
    for p in range(0, len(lines), B.LINES):
        runs = reading.down_the_page(in_columns(lines[p : p + B.LINES]))
        order = reading.ordered(runs)
        out.append({"page_index": p // B.LINES, "split": reading.column_split(runs, True), "reading": ",".join(r.text for r in order)})
    return out


@query(rf"""with {RUNS}, boxed as (select revision_id, page_index, run_index as k, case when run_index % 2 = 0 then 10.0 else 320.0 end::double as x, (10.0 + 16 * (run_index // 2))::double as y,
  least(6 * length(trim(regexp_replace(text, '[{WS}]+', ' ', 'g'))), 400)::double as w from runs where trim(regexp_replace(text, '[{WS}]+', ' ', 'g')) <> ''),
every as (select distinct revision_id, page_index from runs),
edges as (select distinct revision_id, page_index, unnest([x, x + w]) as e from boxed),
gaps as (select *, lead(e) over (partition by revision_id, page_index order by e) as f from edges),
counted as (select g.revision_id, g.page_index, e, f, count(*) as n, count(*) filter (x + w <= (e + f) / 2) as l, count(*) filter (x >= (e + f) / 2) as r
  from gaps g join boxed using (revision_id, page_index) where f - e >= 24 group by all),
best as (select revision_id, page_index, arg_max((e + f) / 2, (least(l, r), f - e, -e)) as split from counted where n >= 4 and least(l, r) >= 2 and n - l - r <= n // 4 group by all),
sided as (select b.*, split, case when split is null then 0 when x + w <= split then 1 when x >= split then 3 else 2 end as side from boxed b left join best using (revision_id, page_index)),
tall as (select *, min(y) filter (side in (1, 3)) over p as top, max(y) filter (side in (1, 3)) over p as low, count(*) filter (side = 1) over p as l, count(*) filter (side = 3) over p as r
  from sided window p as (partition by revision_id, page_index)),
ranked as (select *, case when split is null then 0 when l < 2 or r < 2 or side <> 2 then side when y <= top then 0 when y > low then 4 else 2 end as part from tall)
select revision_id, page_index::int as page_index, any_value(split) as split, coalesce(string_agg(k::varchar, ',' order by part, y, x) filter (k is not null), '') as reading from every left join ranked using (revision_id, page_index) group by all""")
def win_column_order(spark: SparkSession, sf: str) -> DataFrame:
    """The gap that splits a page into columns, and the order of its lines around it (win_column_split, set_union_bands)."""
    return mapped(pages_of_lines(spark, sf), ["revision_id"], "page_index:int,split:double,reading:string", _columns, "lines")


def fragment_run(line: str) -> Run:
    """A line as one run whose words are fragments 60 points apart."""
    parts = [Fragment(w, Box(60.0 * k, 10.0, float(min(6 * len(w), 58)), 12.0)) for k, w in enumerate(x for x in words.SPACES.split(line) if x)]
    return Run(line, Box(0.0, 10.0, 600.0, 12.0), tuple(parts))


def _items(lines: list[str]) -> list[dict]:
    return [{"k": k, "is_item": matching.is_list_item(r), "is_row": matching.is_table_row(r)} for k, r in enumerate(map(fragment_run, lines))]


@query(f"""with {DOCS}, split as (select doc_id, string_split(text, chr(10)) as ls from docs), flat as (select doc_id, unnest(ls) as text, unnest(range(len(ls)))::int as k from split),
w as (select *, regexp_extract_all(text, '[^{WS}]+') as ws from flat)
select doc_id as revision_id, k, regexp_matches(text, '{MARKER}') or regexp_matches(case when len(ws) = 0 then text else array_to_string(ws[1:2], ' ') end, '{MARKER}') as is_item,
  contains(text, '|') or contains(text, chr(9)) or len(list_filter(ws[1:len(ws) - 1], lambda x: 60 - least(6 * length(x), 58) >= 24)) >= 2 as is_row from w""")
def prd_list_item_run(spark: SparkSession, sf: str) -> DataFrame:
    """Runs that are list items or, by marks or wide gaps between fragments, table rows (prd_table_row_run)."""
    return mapped(pages_of_lines(spark, sf), ["revision_id"], "k:int,is_item:boolean,is_row:boolean", _items, "lines")


# --- tokens ----------------------------------------------------------------------------------------------------------------


def turns(spark: SparkSession, sf: str) -> DataFrame:
    return B.turn_edges(B.table(spark, sf, "conversations"))


TURN_KEYS = ["set_id", "edge_index"]
TOKENS = f"{TURNS}, t as (select set_id, edge_index, before, after, {TOK.format('before')} as b, {TOK.format('after')} as a from edges)"
PREFIX = "coalesce(list_min(list_filter(range(1, least(len(b), len(a)) + 1), lambda i: b[i] <> a[i])), least(len(b), len(a)) + 1) - 1"
SUFFIX = "least(coalesce(list_min(list_filter(range(1, least(len(b), len(a)) + 1), lambda i: b[len(b) + 1 - i] <> a[len(a) + 1 - i])), least(len(b), len(a)) + 1) - 1, least(len(b), len(a)) - p)"
AFFIX = f"{TOKENS}, pre as (select *, {PREFIX} as p from t), affix as (select *, {SUFFIX} as q from pre)"


@query(f"""with {TOKENS}, z as (select set_id, edge_index, list_zip(a[1:len(a) - 1], a[2:len(a)]) as z from t)
select set_id, edge_index, len(list_filter(z, lambda x: not (x[2][1] in ('.', ',', ';', ':', '!', '?', '%', ')', ']', '}}', '''', '’') or right(x[1], 1) in ('(', '[', '{{', '''', '’'))))::int as gaps from z""")
def str_token_space(spark: SparkSession, sf: str) -> DataFrame:
    """Between how many neighbouring tokens of a turn a space stands."""
    count = lambda text: [{"gaps": sum(map(words.token_gap, t, t[1:]))} for t in [words.tokens(text)]]
    return mapped(turns(spark, sf), TURN_KEYS, "gaps:int", count, "after")


@query(f"with {AFFIX} select set_id, edge_index, p::int as prefix, q::int as suffix from affix")
def arr_common_affix(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens that adjacent turns have in common at their beginnings and ends."""
    both = lambda b, a: [dict(zip(("prefix", "suffix"), words.affixes(words.tokens(b), words.tokens(a)), strict=True))]
    return mapped(turns(spark, sf), TURN_KEYS, "prefix:int,suffix:int", both, "before", "after")


@query(f"""with {AFFIX}, f as (select *, 6.0 * length(before) as w, len(b) - p - q as changed, 72 + 6.0 * length(before) * p / len(b) as start from affix)
select set_id, edge_index, round(case when len(b) = 0 or len(a) = 0 then 72.0 else start end, 6) as x,
  round(case when len(b) = 0 or len(a) = 0 then w else least(case when changed > 0 then greatest(w * changed / len(b), 8.4) else least(8.4, greatest(w, 1)) end, greatest(72 + w - start, 0)) end, 6) as width from f""")
def arr_focus_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """The part of a run's box, by tokens, that holds what the other run lacks."""

    def spot(before: str, after: str) -> list[dict]:
        old, new = (Run(t, Box(72.0, 10.0, 6.0 * len(t), 12.0)) for t in (before, after))
        box = matching.token_focus(old, new)
        return [{"x": round(box.x, 6), "width": round(box.width, 6)}]

    return mapped(turns(spark, sf), TURN_KEYS, "x:double,width:double", spot, "before", "after")


# --- rectangles ------------------------------------------------------------------------------------------------------------


@query(f"""with {SIDES}, d as (select *, least(aw, bw) / greatest(aw, bw) as wide, greatest(aw, ah, bw, bh) as most from geo)
select revision_id, i, j, round(wide, 6) as dimension, round(abs(ay + ah / 2 - by_ - bh / 2), 6) as line_distance,
  case when case when inter > 0 then inter / (aw * ah + bw * bh - inter) >= 0.12 else dist <= 1.5 * most end then 1.0 when dist <= 3 * most then 0.5 else 0.0 end as geometry from d""")
def sim_block_geometry(spark: SparkSession, sf: str) -> DataFrame:
    """sim_dimension, dist_line and sim_block_geometry on figure pairs."""
    a, b = F.col("a"), F.col("b")
    return figure_pairs(spark, sf).select(
        "revision_id", "i", "j", F.round(C.dimension_similarity(a.width, b.width), 6).alias("dimension"),
        F.round(C.line_distance(a, b), 6).alias("line_distance"), C.block_geometry(a, b).alias("geometry"),
    )


# --- rasters: embeddings as 8 x 8 grey images, each with the next --------------------------------------------------------------

IMAGES = """f as (select vec_id, list_transform(embedding, lambda v: least(greatest(floor((v::double + 0.6) * 212.5 + 0.5), 0), 255)::int) as s from embeddings),
images as (select a.vec_id, a.s as old, b.s as new from f a join f b on b.vec_id = a.vec_id + 1)"""
SHIFTS = f"""{IMAGES}, shifts as (select unnest(range(-2, 3)) as dx), grid as (select a.dx, b.dx as dy from shifts a, shifts b),
scores as (select vec_id, dx::int as dx, dy::int as dy, len(list_filter(range(64), lambda p: abs(old[p + 1] - case when p % 8 + dx between 0 and 7 and p // 8 + dy between 0 and 7
  then new[(p // 8 + dy) * 8 + p % 8 + dx + 1] else 255 end) > 8))::int as mismatches from images, grid)"""


def images(spark: SparkSession, sf: str) -> DataFrame:
    f = B.fingerprints(spark, sf).select("vec_id", "samples")
    after = f.select((F.col("vec_id") - 1).alias("vec_id"), F.col("samples").alias("new"))
    return f.withColumnRenamed("samples", "old").join(after, "vec_id")


def image(samples: list[int]) -> np.ndarray:
    out = np.repeat(np.array(samples, np.uint8).reshape(8, 8, 1), 4, 2)
    out[:, :, 3] = 255
    return out


@query(f"with {SHIFTS} select * from scores")
def agg_alignment_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The mismatches of every shift up to two pixels; what a shift uncovers is white (join_alignment_pixels, prj_project_image)."""
    grid = F.explode(F.expr("flatten(transform(sequence(-2, 2), x -> transform(sequence(-2, 2), y -> struct(x as dx, y as dy))))"))
    i = images(spark, sf).withColumn("at", grid).select("vec_id", "old", "new", "at.*")
    seen = "if(p % 8 + dx between 0 and 7 and p div 8 + dy between 0 and 7, new[cast((p div 8 + dy) * 8 + p % 8 + dx as int)], 255)"
    return i.select("vec_id", "dx", "dy", F.expr(f"size(filter(sequence(0, 63), p -> abs(old[p] - {seen}) > 8))").alias("mismatches"))


def _aligned(old: list[int], new: list[int]) -> list[dict]:
    a = raster.align(image(old), image(new), 8, 8, raster.Options(max_shift=2, sample_step=1))
    return [{"dx": a.dx, "dy": a.dy, "confidence": round(a.confidence, 6)}]


@query(f"""with {SHIFTS}, m as (select vec_id, arg_min({{'dx': dx, 'dy': dy}}, (mismatches, abs(dx) + abs(dy), dy, dx)) as best, min(mismatches) as least, max(mismatches) as most from scores group by 1)
select vec_id, best.dx as dx, best.dy as dy, round(case when most = 0 then 1.0 else 1 - least::double / most end, 6) as confidence from m""")
def top1_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """The shift with the fewest mismatches, and how sure it is (conf_alignment)."""
    return mapped(images(spark, sf), ["vec_id"], "dx:int,dy:int,confidence:double", _aligned, "old", "new")


def _compared(old: list[int], new: list[int]) -> raster.RasterDiff:
    return raster.compare(image(old), image(new), raster.Options(max_shift=0, sample_step=1, channel_tolerance=48, min_region_area=3), preview=True)


@query(f"""with recursive {IMAGES}, px as (select vec_id, old, new, unnest(range(64)) as p from images), changed as (select vec_id, p, p % 8 as x, p // 8 as y, old[p + 1] < 245 as b, new[p + 1] < 245 as a
  from px where abs(old[p + 1] - new[p + 1]) > 48),
reach as (select vec_id, p as start, p, x, y from changed union select r.vec_id, r.start, c.p, c.x, c.y from reach r join changed c on c.vec_id = r.vec_id and abs(c.x - r.x) <= 1 and abs(c.y - r.y) <= 1),
label as (select vec_id, p, min(start) as label from reach group by all),
region as (select vec_id, label, min(x)::int as x, min(y)::int as y, (max(x) - min(x) + 1)::int as width, (max(y) - min(y) + 1)::int as height, count(*) as changed_pixels,
  count(*) filter (b) as before_content_pixels, count(*) filter (a) as after_content_pixels from changed join label using (vec_id, p) group by all having count(*) >= 3)
select vec_id, 'region-' || row_number() over (partition by vec_id order by label) as id, x, y, width, height, changed_pixels, before_content_pixels, after_content_pixels,
  case when before_content_pixels = 0 and after_content_pixels > 0 then 'added' when after_content_pixels = 0 and before_content_pixels > 0 then 'removed' else 'modified' end as type from region""")
def agg_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Components of changed pixels with their content counts and types (flt_min_region_area, op_visual_type)."""
    kind = "id:string,x:int,y:int,width:int,height:int,changed_pixels:long,before_content_pixels:long,after_content_pixels:long"
    fields = ("id", "x", "y", "width", "height", "changed", "before_content", "after_content")
    row = lambda old, new: [dict(zip([k.split(":")[0] for k in kind.split(",")], (getattr(r, f) for f in fields), strict=True)) for r in _compared(old, new).regions]
    r = mapped(images(spark, sf), ["vec_id"], kind, row, "old", "new")
    return r.withColumn("type", C.visual_type(F.col("before_content_pixels"), F.col("after_content_pixels")))


@query(f"""with {IMAGES}, z as (select vec_id, list_transform(list_zip(old, new), lambda x: {{'s': x[1], 'hit': abs(x[1] - x[2]) > 48}}) as z from images),
n as (select *, len(list_filter(z, lambda x: x.hit)) as hits from z)
select vec_id, hits::int as changed, list_sum(list_transform(z, lambda x: case when hits = 0 then 255 when x.hit then 235 else x.s // 3 + 170 end))::bigint as red,
  list_sum(list_transform(z, lambda x: case when hits = 0 then 255 when x.hit then 45 else x.s // 3 + 170 end))::bigint as green from n""")
def prj_faded_preview(spark: SparkSession, sf: str) -> DataFrame:
    """Sums of the preview's channels: changed pixels in red on a faded page, white if nothing changed (op_compare_images)."""

    def sums(old: list[int], new: list[int]) -> list[dict]:
        d = _compared(old, new)
        return [{"changed": d.changed, "red": int(d.preview[..., 0].sum()), "green": int(d.preview[..., 1].sum())}]

    return mapped(images(spark, sf), ["vec_id"], "changed:int,red:long,green:long", sums, "old", "new")


# --- the review layer: a part's order lines as boxes on a page -----------------------------------------------------------------

BOXES = """boxes as (select l_partkey as part, row_number() over (partition by l_partkey order by l_orderkey, l_linenumber, (4 * l_quantity)::int, (30 + round(100 * l_discount))::int, l_suppkey % 97) as k, (40 * l_linenumber)::int as x, (4 * l_quantity)::int as y,
  (30 + round(100 * l_discount))::int as w, 40 as h, (1 + l_suppkey % 97)::int as changed from lineitem),
sorted as (select *, row_number() over (partition by part order by y, x, k) as n from boxes)"""


def part_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Per part the boxes of its order lines; a part has some thirty, at any scale."""
    box = F.struct("l_orderkey", "l_linenumber", (40 * F.col("l_linenumber")).cast("int").alias("x"), (4 * F.col("l_quantity")).cast("int").alias("y"), (30 + F.round(100 * F.col("l_discount"))).cast("int").alias("w"), (1 + F.col("l_suppkey") % 97).cast("int").alias("changed"))
    return B.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(F.array_sort(F.collect_list(box)).alias("boxes"))


def _clusters(rows: list[dict]) -> list[dict]:
    regions = [raster.Region(str(k), r["x"], r["y"], r["w"], 40, r["changed"], 0, r["changed"]) for k, r in enumerate(rows)]
    return [{"rank": k, "x": int(b.x), "y": int(b.y), "width": int(b.width), "height": int(b.height), "changed": n} for k, (b, n, _, _) in enumerate(review.clusters(regions), 1)]


@query(f"""with recursive {BOXES}, fold as (select part, 1 as n, [{{'x': x, 'y': y, 'w': w, 'h': h, 'c': changed}}] as gs from sorted where n = 1 union all
  select s.part, s.n::int, case when spot is null then list_append(gs, {{'x': s.x, 'y': s.y, 'w': s.w, 'h': s.h, 'c': s.changed}}) else list_transform(list_zip(gs, range(1, len(gs) + 1)), lambda z:
    case when z[2] = spot then {{'x': least(z[1].x, s.x), 'y': least(z[1].y, s.y), 'w': greatest(z[1].x + z[1].w, s.x + s.w) - least(z[1].x, s.x), 'h': greatest(z[1].y + z[1].h, s.y + s.h) - least(z[1].y, s.y), 'c': z[1].c + s.changed}} else z[1] end) end
  from (select f.part, f.n, f.gs, s.n as m, s, list_min(list_filter(range(1, len(f.gs) + 1), lambda i: greatest(f.gs[i].x - s.x - s.w, s.x - f.gs[i].x - f.gs[i].w, 0) <= 18 and greatest(f.gs[i].y - s.y - s.h, s.y - f.gs[i].y - f.gs[i].h, 0) <= 18)) as spot
    from fold f join sorted s on s.part = f.part and s.n = f.n + 1)),
last as (select part, arg_max(gs, n) as gs from fold group by 1), flat as (select part, unnest(gs) as g, unnest(range(len(gs))) as o from last),
top as (select part, g, row_number() over (partition by part order by g.c desc, o) as rank from flat)
select part, rank::int as rank, g.x::int as x, g.y::int as y, g.w::int as width, g.h::int as height, g.c::int as changed from top where rank <= 24""")
def topk_visual_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Regions, top down, join the first cluster within reach; the 24 largest clusters stay (win_visual_clusters)."""
    return mapped(part_boxes(spark, sf), ["part"], "rank:int,x:int,y:int,width:int,height:int,changed:int", _clusters, "boxes")


def _text_groups(rows: list[dict]) -> list[dict]:
    changes = [matching.Change(str(k), "modified", after_box=Box(r["x"], r["y"], r["w"], 40), after_focus=Box(r["x"], r["y"], r["w"], 40)) for k, r in enumerate(rows)]
    return [{"number": n, "members": len(g), "first": int(g[0].id) + 1} for n, g in enumerate(review.text_groups(changes), 1)]


@query(f"""with recursive {BOXES}, fold as (select part, n::int as n, x as fx, y as fy, w as fw, k as fk, 1 as g from sorted where n = 1 union all
  select s.part, s.n::int, case when same then f.fx else s.x end, case when same then f.fy else s.y end, case when same then f.fw else s.w end, case when same then f.fk else s.k end, case when same then f.g else f.g + 1 end
  from (select f, s, (greatest(least(f.fy + 40, s.y + 40) - greatest(f.fy, s.y), 0) / 40.0 >= 0.35 or abs(f.fy - s.y) <= 28) and greatest(f.fx - s.x - s.w, s.x - f.fx - f.fw, 0) <= 320 as same
    from fold f join sorted s on s.part = f.part and s.n = f.n + 1))
select part, g::int as number, count(*)::int as members, any_value(fk)::int as first from fold group by part, g""")
def win_semantic_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Changes, top down, stay with the group whose first one is on their line."""
    return mapped(part_boxes(spark, sf), ["part"], "number:int,members:int,first:int", _text_groups, "boxes")


# --- lines, content and JSON -----------------------------------------------------------------------------------------------


@query(f"""with {EDGES}, b as (select from_id, unnest(ls) as bt, unnest(range(len(ls))) as k from (select from_id, string_split(before, chr(10)) as ls from edges)),
a as (select from_id, unnest(ls) as at_, unnest(range(len(ls))) as k from (select from_id, string_split(after, chr(10)) as ls from edges)),
changed as (select from_id, k::int as k, bt is distinct from at_ as hit, (max(k) over (partition by from_id))::int as last from b full join a using (from_id, k)),
spans as (select from_id, k, greatest(k - 3, 0) as a, least(k + 4, last + 1) as b from changed where hit),
cut as (select *, case when a <= max(b) over (partition by from_id order by k rows between unbounded preceding and 1 preceding) then 0 else 1 end as starts from spans),
num as (select *, sum(starts) over (partition by from_id order by k) as hunk from cut)
select from_id, hunk::bigint as hunk, min(a)::int as first_line, max(b)::int as end_line, count(*) as changed from num group by all""")
def win_hunks(spark: SparkSession, sf: str) -> DataFrame:
    """Hunks with three lines of context around the lines that differ by position (the diff of oversize pages)."""
    e = B.next_id_edges(B.documents(spark, sf))
    z = e.select("from_id", F.posexplode(F.arrays_zip(F.split("before", "\n").alias("b"), F.split("after", "\n").alias("a"))).alias("k", "z"))
    return hunks(z.select("from_id", "k", (~F.col("z.b").eqNullSafe(F.col("z.a"))).alias("hit")), ["from_id"], "k", "hit", 3)


@query(f"""with {EDGES}, b as (select from_id, unnest(ls) as bt, unnest(range(len(ls))) as k from (select from_id, string_split(before, chr(10)) as ls from edges)),
a as (select from_id, unnest(ls) as at_, unnest(range(len(ls))) as k from (select from_id, string_split(after, chr(10)) as ls from edges)),
changed as (select from_id, k::int as k, row_number() over (partition by from_id order by k) as n from b full join a using (from_id, k) where bt is distinct from at_)
select from_id, k, n::int as n from changed where n <= 16""")
def lim_changes_viewer(spark: SparkSession, sf: str) -> DataFrame:
    """The first sixteen changes of an edge, by position, as the inspector lists them."""
    e = B.next_id_edges(B.documents(spark, sf))
    z = F.arrays_zip(F.split("before", "\n").alias("b"), F.split("after", "\n").alias("a"))
    ranked = F.transform(z, lambda p, k: F.struct(k.alias("k"), (~p.b.eqNullSafe(p.a)).alias("hit")))
    first = F.slice(F.filter(ranked, lambda p: p.hit), 1, review.MOST_LISTED)
    return e.select("from_id", F.posexplode(first).alias("n", "p")).select("from_id", F.col("p.k").alias("k"), (F.col("n") + 1).alias("n"))


@query(f"with {DOCS} select min(doc_id) as first, count(*) as copies from docs group by text")
def math_hash_fnv(spark: SparkSession, sf: str) -> DataFrame:
    """Content known by 64 bits that are only compared: each class of equal texts."""
    h = F.xxhash64(F.col("text").cast("binary"))
    return B.documents(spark, sf).groupBy(h.alias("h")).agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).drop("h")


@query(f"with {FIGURES} select to_json({{'revision_id': revision_id, 'figure_index': figure_index, 'content_hash': content_hash, 'is_large': w > 35}}) as row from figures")
def json_serialize(spark: SparkSession, sf: str) -> DataFrame:
    """Rows as JSON objects, keys in the order of the columns (sink_json)."""
    return B.figures(spark, sf).select(F.to_json(F.struct("revision_id", "figure_index", "content_hash", (F.col("bounds.width") > 35).alias("is_large"))).alias("row"))


# --- edit walks and greedy matching, as recursive SQL ------------------------------------------------------------------------

GAPLESS = "({t}[1] in ('.', ',', ';', ':', '!', '?', '%', ')', ']', '}}', '''', '’') or right({p}, 1) in ('(', '[', '{{', '''', '’'))"
WALK = f"""with recursive {TOKENS}, sized as (select *, len(b) as n, len(a) as m from t),
hits as (select *, list_transform(b, lambda x: list_transform([list_filter(range(1, m + 1), lambda i: a[i] = x)], lambda f: list_transform(range(1, m + 2), lambda j: coalesce(list_min(list_filter(f, lambda i: i >= j)), 0)))[1]) as h from sized),
tables as (select set_id, edge_index, n, m, b, a, before, after, list_reduce(list_prepend([list_transform(range(m + 1), lambda i: 0::bigint)], list_transform(list_reverse(h), lambda r: [r])),
  lambda acc, e: list_prepend(list_transform(range(1, m + 2), lambda j: greatest(acc[1][j], case when e[1][j] > 0 then acc[1][e[1][j] + 1] + 1 else 0 end)), acc)) as c from hits),
walk as (select set_id, edge_index, 0::bigint as step, 0::bigint as i, 0::bigint as j, '' as op from tables union all
  select w.set_id, w.edge_index, step + 1, i + case when op_ in ('=', '-') then 1 else 0 end, j + case when op_ in ('=', '+') then 1 else 0 end, op_ from (
    select w.*, case when i < n and j < m and b[i + 1] = a[j + 1] then '=' when i < n and (j = m or c[i + 2][j + 1] >= c[i + 1][j + 2]) then '-' else '+' end as op_
    from walk w join tables using (set_id, edge_index) where i < n or j < m) w),
shown as (select set_id, edge_index, step, 'before' as side, case op when '=' then 'equal' else 'removed' end as kind, b[i] as token from walk join tables using (set_id, edge_index) where op in ('=', '-')
  union all select set_id, edge_index, step, 'after', case op when '=' then 'equal' else 'added' end, a[j] from walk join tables using (set_id, edge_index) where op in ('=', '+')),
lagged as (select *, lag(token) over p as last, lag(kind) over p as was from shown window p as (partition by set_id, edge_index, side order by step)),
spaced as (select *, case when last is null or {GAPLESS.format(t='token', p='last')} then '' else ' ' end || token as part, sum(case when was = kind then 0 else 1 end) over (partition by set_id, edge_index, side order by step) as number from lagged),
spans as (select set_id, edge_index, side, number, kind, string_agg(part, '' order by step) as text from spaced group by all),
sides as (select set_id, edge_index, side, count(distinct kind) as kinds, string_agg(case kind when 'equal' then text else case when text[1] = ' ' then ' ' else '' end || case kind when 'added' then '{{+' else '[-' end || ltrim(text, ' ') ||
  case kind when 'added' then '+}}' else '-]' end end, '' order by number) as marked, list(text order by number) filter (kind <> 'equal') as changed from spans group by all)"""


def line_of(column: str) -> str:
    return f"replace(replace({column}, chr(13), '\\n'), chr(10), '\\n')"


@query(f"""{WALK} select t.set_id, t.edge_index, case when o.kinds = 2 then o.marked else {line_of('t.before')} end as before, case when w.kinds = 2 then w.marked else {line_of('t.after')} end as after,
  coalesce(regexp_replace(list_reduce(o.changed, lambda l, r: {JOIN_SQL.format(l='l', r='r')}), '^[{WS}]+|[{WS}]+$', '', 'g'), '') as removed,
  coalesce(regexp_replace(list_reduce(w.changed, lambda l, r: {JOIN_SQL.format(l='l', r='r')}), '^[{WS}]+|[{WS}]+$', '', 'g'), '') as added,
  case when n < m and c[1][1] = n then 'added' when m < n and c[1][1] = m then 'removed' else 'modified' end as kind
from tables t left join sides o on o.set_id = t.set_id and o.edge_index = t.edge_index and o.side = 'before' left join sides w on w.set_id = t.set_id and w.edge_index = t.edge_index and w.side = 'after'""")
def str_inline_words(spark: SparkSession, sf: str) -> DataFrame:
    """Adjacent turns' inline diffs, the text that only one side has (str_changed_span), and the kind of edit (op_matched_change)."""

    def row(a: str, b: str) -> list[dict]:
        old, new = words.inline(a, b)
        texts = {k: words.changed_text(a, b, k) for k in ("removed", "added")}
        return [{"before": words.marked_line(a, old), "after": words.marked_line(b, new), **texts, "kind": words.edit_kind(a, b)}]

    from .plans.compare import spread

    return mapped(spread(turns(spark, sf), TURN_KEYS), TURN_KEYS, "before:string,after:string,removed:string,added:string,kind:string", row, "before", "after")


FIGURE_ORDER = "l_linenumber, l_quantity, l_discount, l_suppkey % 7"


@query(f"""with recursive figures as (select l_orderkey as revision_id, row_number() over (partition by l_orderkey order by {FIGURE_ORDER}) - 1 as k, (40 * l_linenumber)::double as x, (10 * l_quantity)::double as y,
  (30 + 100 * l_discount)::double as w, 40::double as h, l_suppkey % 7 as hash from lineitem),
revisions as (select distinct a.revision_id from figures a join figures b on b.revision_id = a.revision_id + 1),
pairs as (select a.revision_id, a.k as i, b.k as j, a.x ax, a.y ay, a.w aw, a.h ah, b.x bx, b.y as by_, b.w bw, b.h bh, a.hash = b.hash as exact,
  greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0) as inter,
  sqrt(power(a.x + a.w / 2 - b.x - b.w / 2, 2) + power(a.y + a.h / 2 - b.y - b.h / 2, 2)) as dist from figures a join figures b on b.revision_id = a.revision_id + 1),
scored as (select *, {'0.65 * inter / least(aw * ah, bw * bh) + 0.2 * least(aw * ah, bw * bh) / greatest(aw * ah, bw * bh) + 0.15 * greatest(0, 1 - dist / 64)'} as score from pairs),
near as (select f.revision_id, f.k as i, list(j order by dist, j) filter (exact) as same, list({{'j': j, 's': score}} order by score desc, j desc) filter ((inter / least(aw * ah, bw * bh) >= 0.2 or dist <= 64) and score >= 0.3) as slots
  from figures f join revisions using (revision_id) left join scored p on p.revision_id = f.revision_id and p.i = f.k group by all),
exact as (select revision_id, -1::bigint as i, []::bigint[] as used, null::bigint as j from revisions union all
  select e.revision_id, n.i, case when free is null then used else list_append(used, free) end, free from (select e.*, n, list_filter(coalesce(n.same, []), lambda x: not list_contains(e.used, x))[1] as free
    from exact e join near n on n.revision_id = e.revision_id and n.i = e.i + 1) e),
done as (select revision_id, arg_max(used, i) as used from exact group by 1),
slot as (select revision_id, -1::bigint as i, used, null::bigint as j, null::double as score from done union all
  select s.revision_id, n.i, case when best is null then used else list_append(used, best.j) end, best.j, best.s from (select s.*, n, case when e.j is null then list_filter(coalesce(n.slots, []), lambda x: not list_contains(s.used, x.j))[1] end as best
    from slot s join near n on n.revision_id = s.revision_id and n.i = s.i + 1 join exact e on e.revision_id = s.revision_id and e.i = s.i + 1) s),
matches as (select revision_id, i, j, 1::double as confidence, true as exact from exact where j is not null union all select revision_id, i, j, score, false from slot where j is not null),
boxed as (select m.revision_id, m.i, m.j, m.confidence, m.exact, p.* exclude (revision_id, i, j, exact) from matches m join scored p using (revision_id, i, j)),
same as (select * from boxed where exact),
told as (select b.revision_id, b.i, b.j, confidence, b.exact, case when not b.exact then 'modified' when exists (select 1 from same q where q.revision_id = b.revision_id and q.i <> b.i
    and greatest(least(b.bx + b.bw, q.ax + q.aw) - greatest(b.bx, q.ax), 0) * greatest(least(b.by_ + b.bh, q.ay + q.ah) - greatest(b.by_, q.ay), 0) / least(b.bw * b.bh, q.aw * q.ah) >= 0.6
    and greatest(least(q.bx + q.bw, b.ax + b.aw) - greatest(q.bx, b.ax), 0) * greatest(least(q.by_ + q.bh, b.ay + b.ah) - greatest(q.by_, b.ay), 0) / least(q.bw * q.bh, b.aw * b.ah) >= 0.6) then 'swapped' else 'moved' end as status
  from boxed b where not (exact and abs(ax - bx) <= 1.5 and abs(ay - by_) <= 1.5 and abs(aw - bw) <= 1.5 and abs(ah - bh) <= 1.5)),
rows_ as (select revision_id, status, confidence, case when exact then 0 else 1 end as part, i as at_ from told
  union all select f.revision_id, 'removed', 1::double, 2, k from figures f join revisions using (revision_id) anti join matches m on m.revision_id = f.revision_id and m.i = f.k
  union all select r.revision_id, 'added', 1::double, 3, k from figures f join revisions r on f.revision_id = r.revision_id + 1 anti join matches m on m.revision_id = r.revision_id and m.j = f.k)
select revision_id, 'figure-' || row_number() over (partition by revision_id order by part, at_) as id, status, round(confidence, 6) as confidence from rows_""")
def op_compare_figures(spark: SparkSession, sf: str) -> DataFrame:
    """Figures of each order against the next: identity, slot, swap, leftovers (join_figure_slot, set_union_figures)."""
    from .operators.figures import Figure, compare
    from .plans.compare import spread

    order = lambda r: (r["figure_index"], r["bounds"]["y"], r["bounds"]["width"], r["content_hash"])
    read = lambda rows: [Figure(Box(**r["bounds"]), r["content_hash"]) for r in sorted(rows or (), key=order)]
    row = lambda a, b: [{"id": d.id, "status": d.status, "confidence": round(d.confidence, 6)} for d in compare(read(a), read(b))]
    f = B.figures(spark, sf).groupBy("revision_id").agg(F.collect_list(F.struct("figure_index", "bounds", "content_hash")).alias("before"))
    after = f.select((F.col("revision_id") - 1).alias("revision_id"), F.col("before").alias("after"))
    return mapped(spread(f.join(after, "revision_id"), ("revision_id",)), ["revision_id"], "id:string,status:string,confidence:double", row, "before", "after")
