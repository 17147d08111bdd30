"""Queries on scripts, fitted text, strips and overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import fit, geometry, script, text
from quire.operators import fonts, overlay, segments, translate
from quire.operators.layout import PAGE
from quire.plans.base import BLANK, TABLES, d_collapse, d_fields, d_trim, query
from quire.plans.pages import blocks
from quire.session import staged
from quire.sources import virtual as v

D_SCRIPTS = (("arabic", "Arabic"), ("hebrew", "Hebrew"), ("devanagari", "Devanagari"), ("cjk", "Han"), ("thai", "Thai"), ("korean", "Hangul"), ("cyrillic", "Cyrillic"))
NAMED = "".join(rf"\p{{{n}}}" for _, n in D_SCRIPTS)


def d_count(s: str, pattern: str) -> str:
    return f"len(regexp_extract_all({s}, '{pattern}'))"


def d_script(s: str) -> str:
    counts = [f"{{n: {d_count(s, f'[{chr(92)}p{{{n}}}]')}, p: {-i}, s: '{k}'}}" for i, (k, n) in enumerate(D_SCRIPTS)]
    rest = f"regexp_replace({s}, '[{NAMED}]+', '', 'g')"
    counts.append("{n: " + d_count(rest, r"\p{L}") + f", p: {-len(D_SCRIPTS)}, s: 'latin'}}")
    best = f"list_sort([{', '.join(counts)}], 'DESC')[1]"
    return f"case when {best}.n > 0 then {best}.s else 'latin' end"


def d_rtl(s: str) -> str:
    rtl = r"\p{Arabic}\p{Hebrew}\p{Syriac}\p{Thaana}"
    return f"{d_count(s, f'[{rtl}]')} > " + d_count(f"regexp_replace({s}, '[{rtl}]+', '', 'g')", r"\p{L}")


def d_ratio(s: str) -> str:
    return f"(case when ({d_script(s)}) in ('cjk', 'korean') then 1.0::double else 0.5::double end)"


def d_limit(w: str, s: str, ratio: str) -> str:
    return f"greatest(1, trunc({w} / ({s} * {ratio}))::int)"


def d_wrap(words: str, limit: str) -> str:
    last = "regexp_extract(a, '[^' || chr(10) || ']*$')"
    return f"case when len({words}) = 0 then [''] else string_split(list_reduce({words}, lambda a, x: a || (case when length({last}) + 1 + length(x) <= {limit} then ' ' else chr(10) end) || x), chr(10)) end"


FORMULA = r"[\x{25A1}\x{25A0}\x{25FB}\x{25FC}\x{FFFD}]"

TABLES["translated"] = (
    ("blocks",),
    f"select *, case when {d_trim('text')} = '' then text else '[de] ' || {d_collapse('text')} end as translated from blocks",
)
TABLES["fit_in"] = (
    ("translated",),
    f"select doc_id, page, block_no, w, h, {d_fields('translated')} as words, {d_ratio('translated')} as ratio, case when font_size > 0 then font_size else 12.0::double end as s0 from translated where {d_trim('translated')} <> ''",
)
TABLES["fit_sizes"] = (("fit_in",), "select *, s0 - 0.5::double * k as s from (select *, unnest(range(0, trunc(s0 * 0.8::double)::int + 3)) as k from fit_in) where k = 0 or s0 - 0.5::double * (k - 1) >= s0 * 0.6::double")
TABLES["fit_tried"] = (("fit_sizes",), f"select * from (select doc_id, page, block_no, h, k, s, {d_wrap('words', d_limit('w', 's', 'ratio'))} as lines from fit_sizes) where s * 1.35::double * len(lines) <= h")
TABLES["fit_first"] = (("fit_tried",), "select doc_id, page, block_no, arg_min(lines, k) as lines, arg_min(s, k) as font_size, any_value(h) as box_height from fit_tried group by all")
TABLES["fit_small"] = (
    ("fit_in",),
    f"select *, s * 1.35::double as line_h, s * 1.35::double * len(lines) as high, greatest(1, trunc(h * 1.5::double / (s * 1.35::double))::int) as most from (select doc_id, page, block_no, h, s0 * 0.6::double as s, {d_wrap('words', d_limit('w', '(s0 * 0.6::double)', 'ratio'))} as lines from fit_in)",
)
TABLES["fitted"] = (
    ("fit_first", "fit_small"),
    """select doc_id, page, block_no, lines, font_size, font_size * 1.35::double as line_height, box_height, false as overflow from fit_first
    union all select doc_id, page, block_no, case when high <= h * 1.5::double or len(lines) <= most then lines else list_append(lines[:most - 1], case when length(lines[most]) > 3 then left(lines[most], length(lines[most]) - 3) || '...' else lines[most] end) end,
    s, line_h, case when high <= h * 1.5::double then high else h * 1.5::double end, true from fit_small f where not exists (select 1 from fit_first g where g.doc_id = f.doc_id and g.page = f.page and g.block_no = f.block_no)""",
)
TABLES["diagrams"] = (
    ("blocks",),
    """select doc_id, page, min(y) as y_low, max(t) as y_high, count(*) as n_images from (
    select *, sum(fresh) over (partition by doc_id, page order by t desc, block_no) as island from (
    select *, case when t <= min(y) over (partition by doc_id, page order by t desc, block_no rows between unbounded preceding and 1 preceding) or row_number() over (partition by doc_id, page order by t desc, block_no) = 1 then 1 else 0 end as fresh
    from (select *, y + h as t from blocks where block_type = 'image'))) group by doc_id, page, island""",
)
TABLES["strips"] = (
    ("diagrams", "blocks"),
    f"""select *, row_number() over (partition by doc_id, page order by y_high desc, y_low desc)::int as seg_no from (
    select doc_id, page, false as is_diagram, y_high as y_low, above as y_high from (select *, coalesce(lag(y_low) over (partition by doc_id, page order by y_high desc, y_low desc), 792.0::double) as above from diagrams) where above > y_high
    union all select doc_id, page, true, y_low, y_high from diagrams
    union all select doc_id, page, false, 0.0::double, min(y_low) from diagrams group by doc_id, page having min(y_low) > 0
    union all select doc_id, page, false, least(792.0::double, min(y)), greatest(0.0::double, max(y + h)) from blocks b where {d_trim('text')} <> '' and not exists (select 1 from diagrams g where g.doc_id = b.doc_id and g.page = b.page) group by doc_id, page)""",
)
TABLES["placed"] = (
    ("strips", "translated"),
    f"""select * from (select b.*, s.seg_no, row_number() over (partition by b.doc_id, b.page, b.block_no order by abs(b.y + b.h / 2 - (s.y_low + s.y_high) / 2), s.seg_no) as nth,
    bool_or(s.is_diagram) over (partition by b.doc_id, b.page) as framed from translated b join strips s on b.doc_id = s.doc_id and b.page = s.page and (s.is_diagram or b.block_type <> 'image'))
    where nth = 1 and (framed or {d_trim('text')} <> '')""",
)
TABLES["pads"] = (
    ("placed",),
    """select doc_id, page, seg_no, case when max(h) = 0 then 12.0::double else least(greatest(greatest(max(h) * 1.75::double, case when min(h) > 0 then min(h) * 2 else 0.0::double end), 12.0::double), 28.0::double) end as pad from placed group by all""",
)
TABLES["refined"] = (
    ("strips", "pads"),
    """select doc_id, page, seg_no, is_diagram, y_low, y_high, case when grown then lo else y_low end as render_low, case when grown then hi else y_high end as render_high from (
    select *, is_diagram and pad is not null and hi > lo as grown from (
    select *, least(case when not up then least(y_high + pad, up_low + least(pad * 0.5::double, 8.0::double)) else y_high + pad end, 792.0::double) as hi,
    greatest(case when not down then greatest(y_low - pad, down_high - least(pad * 0.5::double, 8.0::double)) else y_low - pad end, 0.0::double) as lo from (
    select s.*, pad, lag(is_diagram) over w as up, lag(y_low) over w as up_low, lead(is_diagram) over w as down, lead(y_high) over w as down_high
    from strips s left join pads using (doc_id, page, seg_no) window w as (partition by doc_id, page order by seg_no))))""",
)
TABLES["laid"] = (
    ("refined",),
    """select *, out_low - case when is_diagram then render_low else y_low end as delta from (select *, total_height - top_m - used as out_low from (
    select *, case when total = 0 then 792.0::double else total end as total_height from (
    select *, top_m + bottom_m + sum(out_h) over (partition by doc_id, page) as total, sum(out_h) over (partition by doc_id, page order by seg_no) as used from (
    select *, case when is_diagram then (render_high - render_low) * 2 + 10.0::double else render_high - render_low end as out_h,
    greatest(0.0::double, 792.0::double - first_value(render_high) over (partition by doc_id, page order by seg_no)) as top_m,
    greatest(0.0::double, last_value(render_low) over (partition by doc_id, page order by seg_no rows between unbounded preceding and unbounded following)) as bottom_m from refined))))""",
)
TABLES["shown"] = (
    ("placed", "laid", "fitted"),
    f"""select p.doc_id, p.page, p.block_no, p.x, p.y, p.w, p.h, p.font_size, p.block_type, p.translated, l.delta, f.lines, f.font_size as fit_size, f.line_height, greatest(p.h, f.box_height) as box_h
    from placed p join laid l using (doc_id, page, seg_no) join fitted f using (doc_id, page, block_no) where {d_trim('p.translated')} <> '' and not regexp_matches(p.text, '{FORMULA}')""",
)
RECTS = "select doc_id, page, block_no, round(x - font_size * 0.3::double, 6) as rect_x, round(y + delta - font_size * 0.5::double, 6) as rect_y, round(w + font_size * 0.3::double * 2, 6) as rect_w, round(box_h + font_size * 0.5::double * 2, 6) as rect_h from shown"
OVERLAY = f"""select doc_id, page, block_no, (i - 1)::int as line_no, lines[i] as text, round(case when rtl then x + w else x end, 6) as line_x, round(y + delta + box_h - i * line_height, 6) as line_y, round(fit_size, 6) as size,
    case when block_type = 'title' then 'bold' else 'regular' end as slot, rtl from (select *, generate_subscripts(lines, 1) as i, {d_rtl('translated')} as rtl from shown) where y + delta + box_h - i * line_height >= y + delta - font_size * 0.5::double"""


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals: sums over a window may differ in their last bits."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def translated(spark: SparkSession, d: str) -> DataFrame:
    return translate.translated(blocks(spark, d))


def placed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(blocks with their strips, refined and laid-out strips)."""
    b = staged(translated(spark, d), "blocks")
    strips = staged(segments.segments(b), "strips")
    p = staged(segments.assigned(b, strips), "placed")
    return p, segments.laid_out(segments.refined(strips, p))


def shown(spark: SparkSession, d: str) -> DataFrame:
    p, strips = placed(spark, d)
    return overlay.shown(p.join(strips.select(*PAGE, "seg_no", "delta"), [*PAGE, "seg_no"]))


@query("q_dominant_script", f"select doc_id, page, list_sort(list({{n: n, p: p, s: s}}), 'DESC')[1].s as script from (select doc_id, page, s, count(*) as n, -list_position(['arabic', 'hebrew', 'devanagari', 'cjk', 'thai', 'korean', 'cyrillic', 'latin'], s) as p from (select doc_id, page, {d_script('text')} as s from blocks) group by all) group by all", "blocks")
def dominant_script(spark: SparkSession, d: str) -> DataFrame:
    order = F.array(*[F.lit(s) for s, _ in script.SCRIPTS], F.lit("latin"))
    g = blocks(spark, d).groupBy(*PAGE, script.detect_script(F.col("text")).alias("s")).agg(F.count("*").alias("n"))
    return g.groupBy(*PAGE).agg(F.max(F.struct("n", (-F.array_position(order, F.col("s"))).alias("p"), "s")).alias("m")).select(*PAGE, F.col("m.s").alias("script"))


@query("q_diagram_regions", "select doc_id, page, y_low, y_high, n_images from diagrams", "diagrams")
def diagram_regions(spark: SparkSession, d: str) -> DataFrame:
    return segments.diagram_regions(blocks(spark, d)).select(*PAGE, "y_low", "y_high", "n_images")


@query("q_segments", "select doc_id, page, seg_no, is_diagram, y_low, y_high from strips", "strips")
def segments_(spark: SparkSession, d: str) -> DataFrame:
    return segments.segments(staged(blocks(spark, d), "blocks")).select(*PAGE, "seg_no", "is_diagram", "y_low", "y_high")


@query("q_nearest_segment", "select doc_id, page, block_no, seg_no from placed", "placed")
def nearest_segment(spark: SparkSession, d: str) -> DataFrame:
    b = staged(blocks(spark, d), "blocks")
    return segments.assigned(b, segments.segments(b)).select(*PAGE, "block_no", "seg_no")


@query("q_diagram_padding", "select doc_id, page, seg_no, pad from pads", "pads")
def diagram_padding(spark: SparkSession, d: str) -> DataFrame:
    b = staged(blocks(spark, d), "blocks")
    return segments.paddings(segments.assigned(b, segments.segments(b)))


@query("q_refined_bounds", "select * from refined", "refined")
def refined_bounds(spark: SparkSession, d: str) -> DataFrame:
    b = staged(blocks(spark, d), "blocks")
    s = staged(segments.segments(b), "strips")
    return segments.refined(s, segments.assigned(b, s))


@query("q_output_height", "select doc_id, page, round(any_value(total_height), 6) as total_height from laid group by all", "laid")
def output_height(spark: SparkSession, d: str) -> DataFrame:
    return rounded(placed(spark, d)[1].groupBy(*PAGE).agg(F.first("total_height").alias("total_height")))


@query("q_output_cursor", "select doc_id, page, seg_no, round(out_low, 6) as out_low, round(delta, 6) as delta from laid", "laid")
def output_cursor(spark: SparkSession, d: str) -> DataFrame:
    return rounded(placed(spark, d)[1].select(*PAGE, "seg_no", "out_low", "delta"))


@query("q_fit_text", "select doc_id, page, block_no, array_to_string(lines, '|') as lines, font_size, line_height, box_height, overflow from fitted", "fitted")
def fit_text(spark: SparkSession, d: str) -> DataFrame:
    b = translated(spark, d).filter(~text.is_blank(F.col("translated"))).withColumn("f", fit.fit_text(F.col("translated"), F.col("w"), F.col("h"), F.col("font_size")))
    return b.select(*PAGE, "block_no", F.array_join("f.lines", "|").alias("lines"), "f.font_size", "f.line_height", "f.box_height", "f.overflow")


@query("q_wrap_text", f"select doc_id, line_no, array_to_string({d_wrap('ws', d_limit('200.0::double', '12.0::double', '0.5::double'))}, '|') as wrapped from (select *, {d_fields('text')} as ws from all_lines)", "all_lines")
def wrap_text(spark: SparkSession, d: str) -> DataFrame:
    return v.all_lines(spark, d).select("doc_id", "line_no", F.array_join(fit.wrap_text(F.col("text"), F.lit(200.0), F.lit(12.0), F.lit(0.5)), "|").alias("wrapped"))


@query("q_measure_width", f"select doc_id, line_no, length(text) * font_size * {d_ratio('text')} as width from all_lines", "all_lines")
def measure_width(spark: SparkSession, d: str) -> DataFrame:
    return v.all_lines(spark, d).select("doc_id", "line_no", fit.text_width(F.col("text"), F.col("font_size")).alias("width"))


@query("q_cover_rects", RECTS, "shown")
def cover_rects(spark: SparkSession, d: str) -> DataFrame:
    return rounded(overlay.cover_rects(shown(spark, d)))


@query("q_overlay_lines", OVERLAY, "shown")
def overlay_lines(spark: SparkSession, d: str) -> DataFrame:
    return rounded(overlay.overlay_lines(shown(spark, d)))


@query("q_flagship", f"select doc_id, page, count(*) as n_lines, count(distinct block_no) as n_blocks, sum(length(text))::bigint as n_chars, round(min(line_y), 4) as lowest, round(max(line_y), 4) as highest, count(*) filter (slot = 'bold') as n_bold from ({OVERLAY}) group by all", "shown")
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Documents to rendered lines: layout, merging, translation, strips and overlays, summed up by page."""
    g = overlay.overlay_lines(shown(spark, d)).groupBy(*PAGE)
    return g.agg(F.count("*").alias("n_lines"), F.countDistinct("block_no").alias("n_blocks"), F.sum(F.length("text")).alias("n_chars"), F.round(F.min("line_y"), 4).alias("lowest"), F.round(F.max("line_y"), 4).alias("highest"), F.count_if(F.col("slot") == "bold").alias("n_bold"))


@query(
    "q_overlay_image_mode",
    f"select doc_id, page, block_no, (i - 1)::int as line_no, lines[i] as text, round(case when {d_rtl('translated')} then x + w else x end, 6) as line_x, round(y + h - i * line_height, 6) as line_y, round(size, 6) as size from (select t.*, f.lines, f.line_height, f.font_size as size, generate_subscripts(f.lines, 1) as i from translated t join fitted f using (doc_id, page, block_no)) where y + h - i * line_height >= y",
    "translated",
    "fitted",
)
def overlay_image_mode(spark: SparkSession, d: str) -> DataFrame:
    return rounded(overlay.image_mode_lines(translated(spark, d)))


@query("q_translate_passthrough", f"select doc_id, page, block_no, text as translated from blocks where {d_trim('text')} = ''", "blocks")
def translate_passthrough(spark: SparkSession, d: str) -> DataFrame:
    return translated(spark, d).filter(text.is_blank(F.col("text"))).select(*PAGE, "block_no", "translated")


@query("q_translate_stub", "select doc_id, page, block_no, translated from translated", "translated")
def translate_stub(spark: SparkSession, d: str) -> DataFrame:
    return translated(spark, d).select(*PAGE, "block_no", "translated")


@query("q_estimate_cost", f"select doc_id, i as input_tokens, trunc(i * 1.2::double)::bigint as output_tokens, i / 1e6 * 0.15::double + trunc(i * 1.2::double) / 1e6 * 0.6::double as cost_usd from (select doc_id, trunc(sum(len({d_fields('text')})) * 1.33::double)::bigint as i from blocks group by doc_id)", "blocks")
def estimate_cost(spark: SparkSession, d: str) -> DataFrame:
    return translate.cost(blocks(spark, d), "doc_id")


@query(
    "q_batch_prompt",
    f"""select doc_id, page, count(*)::int as n_blocks, '[' || string_agg('{{"id":' || n || ',"text":' || replace(replace(replace(to_json(t)::varchar, '<', '\\u003c'), '>', '\\u003e'), '&', '\\u0026') || ',"type":"' || block_type || '"}}', ',' order by n) || ']' as items
    from (select doc_id, page, row_number() over (partition by doc_id, page order by block_no) - 1 as n, case when block_type = 'table' then text else {d_collapse('text')} end as t, block_type from blocks where {d_trim('text')} <> '') group by all""",
    "blocks",
)
def batch_prompt(spark: SparkSession, d: str) -> DataFrame:
    return translate.batch_prompts(blocks(spark, d))


def d_samples() -> str:
    rows = ", ".join("(%d, %s)" % (i, " || ".join(f"chr({ord(c)})" for c in s) or "''") for i, s in enumerate(v.SAMPLES))
    return f"select * from (values {rows}) t(id, text)"


TABLES["samples"] = ((), d_samples())
TABLES["texts"] = (("samples",), "select id::bigint as id, text from samples union all select 1000 + doc_id, text from documents")


def texts(spark: SparkSession, d: str) -> DataFrame:
    """The literals and all documents, whole."""
    docs = v.read(spark, d, "documents").select((F.col("doc_id") + 1000).alias("id"), "text")
    return v.samples(spark).select(F.col("id").cast("long").alias("id"), "text").unionByName(docs)


@query("q_is_rtl", f"select id, {d_rtl('text')} as rtl from texts", "texts")
def is_rtl(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).select("id", script.is_rtl(F.col("text")).alias("rtl"))


@query("q_detect_script", f"select id, {d_script('text')} as script from texts", "texts")
def detect_script(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).select("id", script.detect_script(F.col("text")).alias("script"))


@query("q_char_ratio", f"select id, {d_ratio('text')} as ratio from texts", "texts")
def char_ratio(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).select("id", script.char_ratio(F.col("text")).alias("ratio"))


@query("q_formula_blocks", f"select id, regexp_matches(text, '{FORMULA}') as formula from texts", "texts")
def formula_blocks(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).select("id", text.is_formula(F.col("text")).alias("formula"))


def d_win(c: str) -> str:
    pairs = " ".join(f"when {a} then {b}" for a, b in text.WIN_ANSI.items())
    num = lambda xs: ", ".join(map(str, xs))
    return f"case when {c} between 32 and 126 or {c} between 160 and 255 then {c} when {c} in ({num(text.WIN_ANSI)}) then case {c} {pairs} end when {c} in ({num(text.BULLETS)}) then 149 when {c} in ({num(text.DASHES)}) then 150 when {c} between 8592 and 8703 then 45 when {c} in ({num(text.SPACES)}) then 32 else 63 end"


@query("q_winansi", f"select code_point, ({d_win('code_point')})::int as byte from (select distinct unicode(c)::int as code_point from (select unnest(string_split(text, '')) as c from samples union select unnest(string_split(text, '')) from documents) where c <> '')", "samples")
def winansi(spark: SparkSession, d: str) -> DataFrame:
    both = v.samples(spark).select("text").unionByName(v.read(spark, d, "documents").select("text"))
    codes = both.select(F.explode(F.array_distinct(F.split("text", ""))).alias("c")).filter("c <> ''").select(F.ascii("c").alias("code_point")).distinct()
    return codes.select("code_point", text.win_ansi(F.col("code_point")).alias("byte"))


ESCAPED = f"array_to_string(list_transform(list_transform(list_transform(list_filter(string_split(text, ''), lambda x: x <> ''), lambda x: unicode(x)), lambda c: ({d_win('c')})::int), lambda b: case when b in (40, 41, 92) then '5C' else '' end || lpad(to_hex(b), 2, '0')), '')"


@query("q_pdf_escape", f"select id, {ESCAPED} as escaped from texts", "texts")
def pdf_escape(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).select("id", text.pdf_escape(F.col("text")).alias("escaped"))


FONT_SQL = "case " + " ".join(f"when script = '{k}' then '{f}'" for k, f in fonts.FONTS.items()) + " else 'NotoSans-Regular.ttf' end"
#: A script's own font file, as settings may name it.
OWN_FONTS = {"thai": "/own/thai.ttf", "cyrillic": "", "latin": "/own/latin.ttf"}


@query("q_font_resolve", f"select id, script, file, case when script = 'thai' then '/own/thai.ttf' when script = 'latin' then '/own/latin.ttf' when length(script) % 2 = 0 then '/cache/' || file else 'fetch:' || file end as path from (select id, script, {FONT_SQL} as file from (select id, {d_script('text')} as script from texts))", "texts")
def font_resolve(spark: SparkSession, d: str) -> DataFrame:
    scripts = texts(spark, d).select("id", script.detect_script(F.col("text")).alias("script"))
    return fonts.resolved(scripts, OWN_FONTS, F.length("script") % 2 == 0)


@query("q_fonts_missing", f"select distinct file from (select {FONT_SQL} as file from (select {d_script('text')} as script from texts)) where file not in ('NotoSans-Regular.ttf', 'NotoSansKR-Regular.ttf')", "texts")
def fonts_missing(spark: SparkSession, d: str) -> DataFrame:
    """The files that the documents' scripts need, but for two that are there."""
    scripts = texts(spark, d).select(script.detect_script(F.col("text")).alias("script"))
    return fonts.missing(fonts.resolved(scripts, {}, F.lit(False)), spark.createDataFrame([("NotoSans-Regular.ttf",), ("NotoSansKR-Regular.ttf",)], "file string"))


@query("q_error_class", "select id, case when contains(lower(text), 'encrypted') or contains(lower(text), 'password') then 'encrypted' else 'other' end as class from texts", "texts")
def error_class(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).select("id", text.error_class(F.col("text")).alias("class"))


@query("q_net_q_depth", f"select id, (len(list_filter(string_split(text, chr(10)), lambda x: {d_trim('x')} = 'q')) - len(list_filter(string_split(text, chr(10)), lambda x: {d_trim('x')} = 'Q')))::int as depth from texts", "texts")
def net_q_depth(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).select("id", text.net_q_depth(F.col("text")).alias("depth"))


@query("q_media_box", "select p_partkey as id, case when p_partkey % 3 = 0 then 612.0::double else p_size + 1.0::double end as w, case when p_partkey % 3 = 0 then 792.0::double else p_partkey + 100.0::double end as h from part")
def media_box(spark: SparkSession, d: str) -> DataFrame:
    box = F.expr("case when p_partkey % 3 = 0 then array(cast(p_partkey as double)) else array(10.0D, 20.0D, p_size + 11.0D, p_partkey + 120.0D) end")
    return v.read(spark, d, "part").select(F.col("p_partkey").alias("id"), geometry.media_box(box).alias("m")).select("id", "m.w", "m.h")


@query("q_map_override", "select p_partkey as id, case when p_size % 2 = 0 then p_brand else 'default' end as regular, 'default' as bold, case when p_size % 2 = 0 then 3 else 2 end::int as n from part")
def map_override(spark: SparkSession, d: str) -> DataFrame:
    base = F.create_map(F.lit("regular"), F.lit("default"), F.lit("bold"), F.lit("default"))
    own = F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("regular"), F.col("p_brand"), F.lit("extra"), F.lit("own"))).otherwise(F.expr("cast(map() as map<string,string>)"))
    m = v.read(spark, d, "part").select(F.col("p_partkey").alias("id"), text.overridden(base, own).alias("m"))
    return m.select("id", F.col("m")["regular"].alias("regular"), F.col("m")["bold"].alias("bold"), F.size("m").alias("n"))


@query("q_config_violations", "select o_orderkey as id, array_to_string(list_filter([case when o_orderkey % 4 = 0 then 'api_key' end, case when o_orderstatus <> 'F' then 'ocr_engine' end, case when o_orderkey % 7 - 2 < 1 then 'workers' end, case when o_orderkey % 20 * 40 not between 72 and 600 then 'dpi' end], lambda x: x is not null), ',') as violations from orders")
def config_violations(spark: SparkSession, d: str) -> DataFrame:
    o, key = v.read(spark, d, "orders"), F.col("o_orderkey")
    rows = o.select(key.alias("id"), F.when(key % 4 != 0, "key").otherwise("").alias("api_key"), F.when(F.col("o_orderstatus") != "F", "other").otherwise("paddleocr").alias("ocr_engine"), (key % 7 - 2).alias("workers"), (key % 20 * 40).alias("dpi"))
    return rows.select("id", text.config_violations().alias("violations"))
