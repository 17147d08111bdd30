"""Queries on recognisers' payloads, jobs, fonts, model answers and colours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import fonts, jobs, ocr, translate
from quire.plans.base import TABLES, d_trim, query
from quire.sources import virtual as v
from quire.sources.virtual import read

PX = "* 300 / 72.0::double"
TABLES["details"] = (
    ("all_lines",),
    f"""select doc_id, page, line_no, case when line_no % 13 = 0 then '' else text end as text, (line_no % 10 + 1) / 10.0::double as confidence, x {PX} as x, y {PX} as y, w {PX} as w, h {PX} as h,
    x {PX} as x0, (x + w) {PX} as x1, (792 - y - h) {PX} as y0, (792 - y) {PX} as y1, case when line_no % 11 = 0 then 3 else 4 end as points from all_lines""",
)
TABLES["boxes"] = (
    ("regions",),
    f"""select doc_id, page, rid, case when inv then x1 else x0 end as a0, case when inv then y1 else y0 end as a1, case when inv then x0 else x1 end as a2, case when inv then y0 else y1 end as a3,
    case when rid = 6 then 'text' else ['doc_title', ' Page_Header', 'footnote', 'chart_title', 'table', 'formula', 'text', 'unknown_label'][rid % 8 + 1] end as label,
    case when rid % 4 = 3 then 0.5::double else (rid + 1) / 10.0::double end as score from (
    select *, (doc_id + rid) % 7 = 0 as inv, x {PX} as x0, (x + w) {PX} as x1, (792 - y - h) {PX} as y0, (792 - y) {PX} as y1 from regions where rid <> 99)""",
)
TABLES["jobs"] = (
    (),
    """select o_orderkey as id, '/in/' || o_orderkey || '.pdf' as input_path, '/in/' || o_orderkey || '_translated.pdf' as output_path, ['de', 'fr', 'es'][(o_orderkey % 3 + 1)::int] as target_lang, (1 + o_orderkey % 7)::int as total_pages,
    case o_orderstatus when 'F' then 'completed' when 'O' then 'pending' else case when o_orderkey % 2 = 0 then 'failed' else 'running' end end as status, o_orderdate::timestamp as updated_at,
    case o_orderkey % 8 when 0 then '/tmp/pt-' || o_orderkey when 1 then '/tmp_evil/' || o_orderkey when 2 then '/data/app/' || o_orderkey when 4 then '/tmp/..' when 5 then '/tmp/a/../b' || o_orderkey when 6 then '/data/app/../x' || o_orderkey when 7 then '/tmp//' else '' end as temp_dir from orders""",
)
TABLES["pages_"] = (
    ("jobs",),
    """select *, case when status = 'failed' then 'timeout' else '' end as error_message, case when status = 'failed' then 1 else 0 end as retries from (
    select id as document_id, p as page_num, case when (id + p) % 3 = 0 then 'scanned' else 'native' end as page_type, case (id * 3 + p) % 5 when 0 then 'pending' when 1 then 'running' when 2 then 'failed' else 'completed' end as status
    from (select id, unnest(range(1, total_pages + 1))::int as p from jobs))""",
)
TABLES["stale"] = (("jobs",), "select *, id % 8 in (0, 2, 5) as safe from jobs where status <> 'completed' and updated_at < timestamp '2001-01-01' - interval 24 hours")
TABLES["glyphs"] = ((), "select font, code_point, gid, 400 + gid % 300 as advance, gid * 13 % 90 as glyph_len from (select font, code_point, 1 + (code_point + 70) % 100 as gid from (select distinct 'Font-' || coalesce(lang, 'any') as font, unicode(c)::int as code_point from (select lang, unnest(string_split(text, '')) as c from documents) where c <> ''))")
TABLES["parts"] = (("glyphs",), "select font, gid, gid // 2 as part from (select distinct font from glyphs), (select unnest(range(1, 101))::int as gid) where gid % 10 = 0")
TABLES["reached"] = (("glyphs", "parts"), "select distinct font, gid from glyphs where gid > 60 union select r.font, p.part from reached r join parts p on p.font = r.font and p.gid = r.gid")
ROOTS = ("/tmp", "/data/app")


@query("q_ocr_normalize", """select doc_id, page, string_agg(text, ' ' order by line_no) as text, coalesce(avg(case when k < n - 1 then confidence else 0.0::double end) filter (text <> '' and points >= 4 and k < n - 2), 0.0::double) as confidence, count(*) filter (text <> '' and points >= 4 and k < n - 2)::int as n_details
    from (select *, row_number() over (partition by doc_id, page order by line_no) - 1 as k, count(*) over (partition by doc_id, page) as n from details) group by all""", "details")
def ocr_normalize(spark: SparkSession, d: str) -> DataFrame:
    return ocr.normalised(v.raw_ocr(spark, d)).select("doc_id", "page", "text", "confidence", F.size("details").alias("n_details"))


@query("q_layout_label_counts", "select label, count(*) as n from boxes group by label", "boxes")
def layout_label_counts(spark: SparkSession, d: str) -> DataFrame:
    return ocr.shaped_regions(v.layout_boxes(spark, d)).groupBy("label").agg(F.count("*").alias("n"))


POINT = "* 72.0::double / 300.0::double"


@query("q_paddle_boxes", f"select doc_id, page, line_no, text, confidence, x0 {POINT} as x, 792.0::double - y0 {POINT} - (y1 - y0) {POINT} as y, (x1 - x0) {POINT} as w, (y1 - y0) {POINT} as h, (y1 - y0) {POINT} * 0.75::double as font_size, case when (y1 - y0) {POINT} * 0.75::double > 16 then 'title' else 'text' end as block_type from details where points >= 4 and text <> ''", "details")
def paddle_boxes(spark: SparkSession, d: str) -> DataFrame:
    return ocr.polygon_lines(v.ocr_details(spark, d))


@query("q_tesseract_boxes", f"select doc_id, page, line_no, text, x {POINT} as x, y {POINT} as y, (x + w - x) {POINT} as w, (y + h - y) {POINT} as h, (y + h - y) {POINT} * 0.75::double as font_size, case when (y + h - y) {POINT} * 0.75::double > 16 then 'title' else 'text' end as block_type from details where text <> ''", "details")
def tesseract_boxes(spark: SparkSession, d: str) -> DataFrame:
    return ocr.box_lines(v.ocr_details(spark, d).drop("bbox", "confidence"))


LABEL_SQL = "case " + " ".join(f"when l = '{k}' then '{t}'" for k, t in ocr.LABELS.items()) + " else 'text' end"


@query("q_layout_regions", f"select doc_id, page, rid, label, score, a0 {POINT} as x, 792.0::double - a1 {POINT} - (a3 - a1) {POINT} as y, (a2 - a0) {POINT} as w, (a3 - a1) {POINT} as h, {LABEL_SQL} as block_type, greatest((a3 - a1) {POINT} * 0.75::double, 1.0::double) as font_size from (select *, lower(trim(label)) as l from boxes) where a2 > a0 and a3 > a1", "boxes")
def layout_regions(spark: SparkSession, d: str) -> DataFrame:
    return ocr.layout_regions(ocr.shaped_regions(v.layout_boxes(spark, d)))


@query("q_label_map", f"select label, {LABEL_SQL} as block_type from (select distinct label, lower(trim(label)) as l from boxes)", "boxes")
def label_map(spark: SparkSession, d: str) -> DataFrame:
    return ocr.shaped_regions(v.layout_boxes(spark, d)).select("label").distinct().select("label", ocr.block_type(F.col("label")).alias("block_type"))


@query("q_assemble_plan", "select document_id, any_value(output_path) as output_path, string_agg('page_' || lpad(page_num::varchar, 4, '0') || '.pdf', ',' order by page_num) as files from pages_ p join jobs j on j.id = p.document_id where p.status = 'completed' group by document_id having count(*) = any_value(total_pages)", "pages_", "jobs")
def assemble_plan(spark: SparkSession, d: str) -> DataFrame:
    return jobs.assembly(v.document_jobs(spark, d), v.page_jobs(spark, d))


@query("q_dry_run_summary", "select document_id, count(*) as total, count(*) filter (page_type = 'native') as native, count(*) filter (page_type = 'scanned') as scanned from pages_ group by all", "pages_")
def dry_run_summary(spark: SparkSession, d: str) -> DataFrame:
    return jobs.dry_run(v.page_jobs(spark, d))


@query("q_stale_jobs", "select id, status, temp_dir, safe from stale", "stale")
def stale_jobs(spark: SparkSession, d: str) -> DataFrame:
    return jobs.stale(v.document_jobs(spark, d), v.NOW, ROOTS).select("id", "status", "temp_dir", "safe")


@query("q_safe_paths", "select id, id % 8 in (0, 2, 5) as safe from jobs", "jobs")
def safe_paths(spark: SparkSession, d: str) -> DataFrame:
    return v.document_jobs(spark, d).select("id", jobs.safe_path(F.col("temp_dir"), *ROOTS).alias("safe"))


@query("q_page_jobs", "select document_id, page_num, case when page_num % 2 = 0 then page_type else 'scanned' end as page_type, 'pending' as status from pages_", "pages_")
def page_jobs(spark: SparkSession, d: str) -> DataFrame:
    kinds = v.page_jobs(spark, d).filter("page_num % 2 = 0").select("document_id", "page_num", "page_type")
    return jobs.page_rows(v.document_jobs(spark, d), kinds)


TABLES["wishes"] = ((), "select distinct '/in/' || o_custkey || '.pdf' as input_path, '/in/' || o_custkey || '_translated.pdf' as output_path, unnest(['de', 'fr', 'es', 'it']) as target_lang from orders")
TABLES["open_jobs"] = (("jobs",), "select '/in/' || o_custkey || '.pdf' as input_path, '/in/' || o_custkey || '_translated.pdf' as output_path, target_lang, min(id) as job_id from jobs join orders on o_orderkey = id where status <> 'completed' group by all")


@query("q_find_job", "select w.*, job_id from wishes w left join open_jobs o on o.input_path = w.input_path and o.output_path = w.output_path and o.target_lang = w.target_lang", "wishes", "open_jobs")
def find_job(spark: SparkSession, d: str) -> DataFrame:
    """A file for each customer, wanted in four languages; the orders are its jobs, so several may be open, or none."""
    owner = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("/in/"), "o_custkey").alias("stem"))
    paths = [F.concat("stem", F.lit(".pdf")).alias("input_path"), F.concat("stem", F.lit("_translated.pdf")).alias("output_path")]
    j = v.document_jobs(spark, d).select("id", "target_lang", "status").join(owner, "id").select("id", "target_lang", "status", *paths)
    wishes = owner.select("stem").distinct().select(*paths, F.explode(F.array(*map(F.lit, ("de", "fr", "es", "it")))).alias("target_lang"))
    return jobs.resumable(wishes, j)


@query("q_cleanup_remaining", "select 'document' as kind, count(*) as n from jobs where id not in (select id from stale where safe) union all select 'page', count(*) from pages_ where document_id not in (select id from stale where safe)", "jobs", "pages_", "stale")
def cleanup_remaining(spark: SparkSession, d: str) -> DataFrame:
    j = v.document_jobs(spark, d)
    left, pages = jobs.cleaned(j, v.page_jobs(spark, d), jobs.stale(j, v.NOW, ROOTS).filter("safe"))
    count = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return count(left, "document").unionByName(count(pages, "page"))


@query("q_count_by_status", "select document_id, status, count(*) as n from pages_ group by all", "pages_")
def count_by_status(spark: SparkSession, d: str) -> DataFrame:
    return jobs.count_by_status(v.page_jobs(spark, d))


@query("q_next_page", "select document_id, min(page_num) as page_num from pages_ where status = 'pending' group by all", "pages_")
def next_page(spark: SparkSession, d: str) -> DataFrame:
    return jobs.next_pages(v.page_jobs(spark, d))


@query("q_resume_state", "select document_id, page_num, case when status in ('running', 'failed') then 'pending' else status end as status, case when status = 'failed' then '' else error_message end as error_message, retries from pages_", "pages_")
def resume_state(spark: SparkSession, d: str) -> DataFrame:
    return jobs.resumed(v.page_jobs(spark, d)).select("document_id", "page_num", "status", "error_message", "retries")


@query("q_claim_pages", "select document_id, page_num, case when status = 'pending' and page_num = min(page_num) filter (status = 'pending') over (partition by document_id) then 'running' else status end as status from pages_", "pages_")
def claim_pages(spark: SparkSession, d: str) -> DataFrame:
    return jobs.claimed(v.page_jobs(spark, d)).select("document_id", "page_num", "status")


def attempts(pages: DataFrame) -> DataFrame:
    """Outcomes of the fixture's pages: each needs up to five retries."""
    late = F.col("retries") < (F.col("document_id") + F.col("page_num")) % 6
    return pages.select("document_id", "page_num", F.when(late, "timeout").alias("error"))


TABLES["rounds"] = (
    ("pages_",),
    """select document_id, page_num, case when open and k > r + 3 then 'failed' else 'completed' end as status, case when open and k > r + 3 then 'timeout' else '' end as error_message, (case when not open then r when k > r + 3 then r + 4 else greatest(k, r) end)::int as retries
    from (select *, status <> 'completed' as open, retries as r, (document_id + page_num) % 6 as k from pages_)""",
)


@query("q_run_rounds", "select * from rounds", "rounds")
def run_rounds(spark: SparkSession, d: str) -> DataFrame:
    return jobs.run_rounds(jobs.resumed(v.page_jobs(spark, d)), attempts).select("document_id", "page_num", "status", "error_message", "retries")


@query(
    "q_settle_jobs",
    "select id, case when failed > 0 or done <> total_pages then 'failed' else 'completed' end as status, case when failed > 0 then failed || ' pages failed' when done <> total_pages then done || ' of ' || total_pages || ' pages are complete' else '' end as error_message from jobs join (select document_id, count(*) filter (status = 'failed') as failed, count(*) filter (status = 'completed') as done from pages_ group by all) on id = document_id",
    "jobs", "pages_",
)
def settle_jobs(spark: SparkSession, d: str) -> DataFrame:
    return jobs.settled(v.document_jobs(spark, d), v.page_jobs(spark, d)).select("id", "status", "error_message")


@query("q_encode_hex", "select doc_id as id, 'Font-' || coalesce(lang, 'any') as font, coalesce(array_to_string(list_transform(list_filter(string_split(text, ''), lambda x: x <> ''), lambda c: lpad(upper(to_hex(case when c = '.' then 0 else 1 + (unicode(c) + 70) % 100 end)), 4, '0')), ''), '') as hex from documents")
def encode_hex(spark: SparkSession, d: str) -> DataFrame:
    texts = v.read(spark, d, "documents").select(F.col("doc_id").alias("id"), v.font_of(), "text")
    return fonts.encoded(texts, v.glyphs(spark, d).filter(F.col("code_point") != ord(".")))


@query("q_glyph_closure", "select font, gid, max(gid) over (partition by font) as max_gid from reached", "reached")
def glyph_closure(spark: SparkSession, d: str) -> DataFrame:
    g = v.glyphs(spark, d)
    tens = F.explode(F.sequence(F.lit(10), F.lit(100), F.lit(10))).alias("gid")
    parts = g.select("font").distinct().select("font", tens).withColumn("part", F.expr("gid div 2"))
    c = fonts.closure(g.filter("gid > 60"), parts)
    return c.join(c.groupBy("font").agg(F.max("gid").alias("max_gid")), "font")


@query("q_gid_runs", "select font, min(gid) as first, max(gid) as last, string_agg(advance::varchar, ' ' order by gid) as widths from (select font, gid, advance, gid - row_number() over (partition by font order by gid) as r from (select distinct font, gid, advance from glyphs)) group by font, r", "glyphs")
def gid_runs(spark: SparkSession, d: str) -> DataFrame:
    return fonts.width_runs(v.glyphs(spark, d))


@query("q_loca_offsets", "select font, gid, padded, coalesce(sum(padded) over (partition by font order by gid rows between unbounded preceding and 1 preceding), 0)::bigint as \"offset\" from (select distinct font, gid, (glyph_len + 3) // 4 * 4 as padded from glyphs)", "glyphs")
def loca_offsets(spark: SparkSession, d: str) -> DataFrame:
    return fonts.offsets(v.glyphs(spark, d))


@query("q_to_unicode", "select font, gid, min(code_point) as code_point, (row_number() over (partition by font order by gid) - 1) // 100 as chunk from glyphs group by font, gid", "glyphs")
def to_unicode(spark: SparkSession, d: str) -> DataFrame:
    return fonts.to_unicode(v.glyphs(spark, d))


def d_hex(n: str) -> str:
    return f"lpad(to_hex({n}), 4, '0')"


HEAD, TAIL = fonts.cmap_text("@")


@query(
    "q_unicode_map",
    f"""select font, replace('{HEAD}', '@', font) || string_agg(t, '' order by chunk) || '{TAIL}' as cmap from (select font, chunk, count(*) || ' beginbfchar' || chr(10) || string_agg('<' || {d_hex("gid")} || '> <' || case when p < 65536 then {d_hex("p")} else {d_hex("55296 + ((p - 65536) >> 10)")} || {d_hex("56320 + ((p - 65536) & 1023)")} end || '>' || chr(10), '' order by gid) || 'endbfchar' || chr(10) as t from (select font, gid, min(code_point) as p, (row_number() over (partition by font order by gid) - 1) // 100 as chunk from glyphs group by font, gid) group by font, chunk) group by font""",
    "glyphs",
)
def unicode_map(spark: SparkSession, d: str) -> DataFrame:
    return fonts.unicode_map(v.glyphs(spark, d))


TABLES["answers"] = (
    (),
    """select conv_id, n + case when conv_id % 10 = 9 then 1 else 0 end as expected, items, n, case conv_id % 4 when 3 then objects else plain end as body from (
    select conv_id, count(*) as n, list(text order by turn) as items, to_json(list(text order by turn))::varchar as plain, to_json(list({'id': k, 'text': text} order by turn))::varchar as objects from (
    select conv_id, turn, text, row_number() over (partition by conv_id order by turn) - 1 as k from conversations) group by conv_id)""",
)


@query("q_extract_json", "select conv_id, body from answers", "answers")
def extract_json(spark: SparkSession, d: str) -> DataFrame:
    return v.responses(spark, d).select("conv_id", translate.extract_json_array(F.col("content")).alias("body"))


@query("q_parse_response", "select conv_id, case when expected <> n then 'expected ' || expected || ' translations, got ' || n end as error, case when expected = n then array_to_string(items, '|') end as translations from answers", "answers")
def parse_response(spark: SparkSession, d: str) -> DataFrame:
    return translate.parsed(v.responses(spark, d)).select("conv_id", "error", F.array_join("translations", "|").alias("translations"))


def d_prompt(prompt: str) -> str:
    return f"replace(replace('{prompt}', '{{source}}', case when source = 'auto' then '{translate.UNKNOWN}' else source end), '{{target}}', 'de')"


@query("q_system_prompts", f"select source, {d_prompt(translate.BATCH_PROMPT)} as batch, {d_prompt(translate.BLOCK_PROMPT)} as block from (select distinct coalesce(lang, 'auto') as source from documents union select 'auto')")
def system_prompts(spark: SparkSession, d: str) -> DataFrame:
    langs = read(spark, d, "documents").select(F.coalesce("lang", F.lit("auto")).alias("source")).union(spark.sql("select 'auto'")).distinct()
    source, target = F.col("source"), F.lit("de")
    return langs.select("source", translate.system_prompt(source, target).alias("batch"), translate.system_prompt(source, target, single=True).alias("block"))


FILTERS = ["FlateDecode", "DCTDecode", "ASCII85Decode", "JPXDecode", "CCITTFaxDecode", "JBIG2Decode", "LZWDecode"]


@query("q_image_streams", f"select p_partkey as id, case when p_partkey % 9 < 7 then list_has_any([{FILTERS}[p_partkey % 7 + 1], {FILTERS}[p_partkey // 7 % 7 + 1]], ['DCTDecode', 'JPXDecode', 'CCITTFaxDecode', 'JBIG2Decode']) else false end as image from part")
def image_streams(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*map(F.lit, FILTERS))
    pair = F.array(F.get(names, F.col("p_partkey") % 7), F.get(names, F.expr("p_partkey div 7 % 7")))
    filters = F.when(F.col("p_partkey") % 9 == 7, F.expr("cast(array() as array<string>)")).when(F.col("p_partkey") % 9 < 7, pair)
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), text.is_image_stream(filters).alias("image"))
