"""Queries on object graphs, content streams, page images, font tables, services' payloads and stored results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import geometry, text
from quire.operators import images, objects, payloads, sfnt, translate
from quire.plans.base import TABLES, query
from quire.session import shared_path, shipped
from quire.sources import virtual as v
from quire.sources.jobstore import JobStore
from quire.sources.pagesource import registered
from quire.sources.virtual import read
from quire.streaming import results

TABLES["edges"] = (
    (),
    """select file, object, ref from (select doc_id as file, n, unnest(range(n)) as object from (select doc_id, len(string_split(text, chr(10))) as n from documents where text is not null)),
    lateral (select unnest([case when object + 1 < n and (object % 7 <> 6 or file % 10 = 0) then object + 1 end, case when object % 7 = 6 and file % 10 <> 0 then (object * 5 + file) % n end,
    case when object % 7 = 6 and file % 10 <> 0 then object // 2 end, case when object % 11 = 5 then n + 3 end, case when object % 13 = 0 then object end]) as ref) where ref is not null""",
)
TABLES["roots"] = ((), "select doc_id as file, 0::bigint as object from documents where text is not null union select doc_id, (len(string_split(text, chr(10))) - 1)::bigint from documents where text is not null and doc_id % 4 = 0")
TABLES["numbers"] = (("reach",), "select file, object, row_number() over (partition by file order by object) as number from reach")
TABLES["reach"] = (("edges", "roots"), "select file, object from roots union select e.file, e.ref as object from reach r join edges e on e.file = r.file and e.object = r.object")


def edges(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Objects of each document as a file: one a line, chains, branchings, cycles and references to nothing; and roots."""
    docs = read(spark, d, "documents").filter("text is not null").select(F.col("doc_id").alias("file"), F.size(F.split("text", "\n")).cast("long").alias("n"))
    rows = docs.select("file", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("object"))
    chain, fork = "object + 1 < n and (object % 7 <> 6 or file % 10 = 0)", "object % 7 = 6 and file % 10 <> 0"
    refs = F.expr(f"array(case when {chain} then object + 1 end, case when {fork} then (object * 5 + file) % n end, case when {fork} then object div 2 end, case when object % 11 = 5 then n + 3 end, case when object % 13 = 0 then object end)")
    roots = docs.select("file", F.explode(F.when(F.col("file") % 4 == 0, F.array(F.lit(0).cast("long"), F.col("n") - 1)).otherwise(F.array(F.lit(0).cast("long")))).alias("object"))
    return rows.select("file", "object", F.explode(refs).alias("ref")).filter("ref is not null"), roots


@query("q_object_closure", "select file, object from reach", "reach")
def object_closure(spark: SparkSession, d: str) -> DataFrame:
    return objects.closure(*edges(spark, d))


@query(
    "q_renumbered",
    "select e.file, a.number, b.number as ref from (select distinct file, object, ref from edges) e join numbers a on a.file = e.file and a.object = e.object join numbers b on b.file = e.file and b.object = e.ref",
    "edges", "numbers",
)
def renumbered(spark: SparkSession, d: str) -> DataFrame:
    e, roots = edges(spark, d)
    return objects.renumbered(objects.closure(e, roots), e)[1]


TABLES["streams"] = ((), "select doc_id, list_transform(string_split(text, chr(10)), lambda x: case length(x) % 3 when 0 then 'q' when 1 then ' Q ' else x end) as ls from documents")
TABLES["signs"] = (
    ("streams",),
    "select doc_id, k, case when trim(l) = 'q' then 1 when trim(l) = 'Q' then -1 else 0 end as s from (select doc_id, unnest(ls) as l, generate_subscripts(ls, 1) as k from streams)",
)
TABLES["depths"] = (("signs",), "select doc_id, coalesce(sum(s), 0)::int as depth, least(0, min(run))::int as lowest from (select doc_id, s, sum(s) over (partition by doc_id order by k) as run from signs) group by doc_id")


@query(
    "q_balanced_content",
    "select doc_id, depth, lowest, -lowest as opened, depth - lowest as closed, md5(repeat('q' || chr(10), -lowest) || array_to_string(ls, chr(10)) || repeat(chr(10) || 'Q', depth - lowest)) as balanced from depths join streams using (doc_id)",
    "depths", "streams",
)
def balanced_content(spark: SparkSession, d: str) -> DataFrame:
    """Each document's lines as a content stream in which many lines save or restore the graphics state."""
    marked = F.transform(F.split("text", "\n"), lambda x: F.when(F.length(x) % 3 == 0, "q").when(F.length(x) % 3 == 1, " Q ").otherwise(x))
    docs = read(spark, d, "documents").filter("text is not null").select("doc_id", F.array_join(marked, "\n").alias("content"))
    b = docs.select("doc_id", text.balance(F.col("content")).alias("b"), F.md5(text.balanced(F.col("content"))).alias("balanced"))
    return b.select("doc_id", "b.*", "balanced")


TABLES["pixels"] = (
    (),
    """select image, x, y, r, 65535 - r as g, r * 7 % 65536 as b from (select vec_id as image, (i - 1) % 8 as x, (i - 1) // 8 as y, least(65535, greatest(0, floor((embedding[i]::double + 1) * 32767.5::double)))::bigint as r
    from (select vec_id, embedding, generate_subscripts(embedding, 1) as i from embeddings))""",
)
TABLES["frames"] = ((), "select vec_id as image, k as id, (vec_id * 3 + k * 5) % 11 - 1 as x, (vec_id + k * 7) % 10 - 1 as y, (vec_id + k) % 6 as w, (vec_id * 7 + k) % 5 as h from embeddings, range(4) t(k) union all select -1, 0, 1, 1, 2, 2")
TABLES["borders"] = (
    ("pixels", "frames"),
    """select image, id, r, g, b from (select *, least(x0 + w, 8) - 1 as x1, least(y0 + h, 8) - 1 as y1 from (select *, greatest(0, least(x, 7)) as x0, greatest(0, least(y, 7)) as y0 from frames where w > 0 and h > 0)) f join pixels p using (image),
    lateral (select unnest(range((p.x between x0 and x1 and p.y = y0)::int + (p.x between x0 and x1 and p.y = y1)::int + (p.y between y0 and y1 and p.x = x0)::int + (p.y between y0 and y1 and p.x = x1)::int)))""",
)


@query(
    "q_background",
    "select image, id, coalesce(r, 1.0::double) as r, coalesce(g, 1.0::double) as g, coalesce(b, 1.0::double) as b, coalesce(r > 0.95 and g > 0.95 and b > 0.95, true) as white, trunc(coalesce(r, 1.0::double) * 255)::int as r8 from frames left join (select image, id, (sum(r) // count(*)) / 65535.0::double as r, (sum(g) // count(*)) / 65535.0::double as g, (sum(b) // count(*)) / 65535.0::double as b from borders group by all) using (image, id)",
    "frames", "borders",
)
def background(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as images of eight by eight pixels, with boxes that may lie beyond them, and one of no image."""
    e = read(spark, d, "embeddings")
    grid = e.select(F.col("vec_id").alias("image"), F.posexplode("embedding").alias("i", "e"))
    red = F.least(F.lit(65535), F.greatest(F.lit(0), F.floor((F.col("e").cast("double") + 1) * 32767.5)))
    pixels = grid.select("image", (F.col("i") % 8).alias("x"), F.expr("cast(i div 8 as int)").alias("y"), red.alias("r")).withColumns({"g": 65535 - F.col("r"), "b": F.col("r") * 7 % 65536})
    frames = e.select(F.col("vec_id").alias("image"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("id"))
    frames = frames.selectExpr("image", "id", "(image * 3 + id * 5) % 11 - 1 as x", "(image + id * 7) % 10 - 1 as y", "(image + id) % 6 as w", "(image * 7 + id) % 5 as h")
    frames = frames.unionByName(spark.sql("select -1L as image, 0L as id, 1L as x, 1L as y, 2L as w, 2L as h"))
    c = F.col
    return images.background(pixels, frames).select("image", "id", "r", "g", "b", geometry.is_white(c("r"), c("g"), c("b")).alias("white"), geometry.to_byte(c("r")).alias("r8"))


def hexed(n: Column, digits: int) -> Column:
    return F.lpad(F.hex(n.cast("long")), digits, "0")


def cmaps(spark: SparkSession, d: str) -> DataFrame:
    """A character map's bytes for each document: its characters' blocks of 16 as segments, every third with a list of glyphs."""
    docs = read(spark, d, "documents").filter("text is not null")
    codes = F.transform(F.array_distinct(F.split("text", "")), lambda c: F.ascii(c))
    blocks = F.array_sort(F.array_distinct(F.transform(F.filter(codes, lambda c: (c > 0) & (c < 0xFFF0)), lambda c: F.floor(c / 16))))
    f = docs.select(F.col("doc_id").alias("font"), blocks.alias("bs")).withColumn("n", F.size("bs") + 1)
    font, n = F.col("font"), F.col("n")
    listed = lambda b: b % 3 == 1
    delta = lambda b: (font * 37 + b) % 65536
    per = lambda one, last: F.concat(F.array_join(F.transform("bs", one), ""), F.lit(last))
    lists = F.array_join(F.transform(F.filter("bs", listed), lambda b: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda j: hexed((j * 5 + b) % 50, 4)), "")), "")
    offset = lambda b, i: F.when(listed(b), hexed((n - i) * 2 + 32 * F.size(F.filter(F.slice("bs", F.lit(1), i), listed)), 4)).otherwise(F.lit("0000"))
    four = F.concat(F.lit("000400000000"), hexed(2 * n, 4), F.lit("0" * 12), per(lambda b: hexed(b * 16 + 15, 4), "FFFF"), F.lit("0000"), per(lambda b: hexed(b * 16, 4), "FFFF"), per(lambda b: hexed(delta(b), 4), "0001"), per(offset, "0000"), lists)
    twelve = F.concat(F.lit("000C0000" + "0" * 16), hexed(n - 1, 8), per(lambda b: F.concat(hexed(b * 16, 8), hexed(b * 16 + 15, 8), hexed(b * 7 + font % 100, 8)), ""))
    f = f.withColumns({"four": four, "twelve": F.when(font % 3 == 0, twelve).otherwise(F.lit(""))})
    record = lambda p, e, at: F.concat(F.when(font % 5 == 4, hexed(F.lit(9), 4)).otherwise(hexed(F.lit(p), 4)), hexed(F.lit(e), 4), hexed(at, 8))
    third = F.when(font % 3 == 0, record(3, 10, 28 + F.floor(F.length("four") / 2))).otherwise(record(1, 0, F.lit(28)))
    data = F.concat(F.lit("00000003"), record(0, 3, F.lit(28)), record(3, 1, F.lit(28)), third, "four", "twelve")
    return f.select("font", F.unhex(F.when(font % 17 == 3, F.substring(data, 1, 2 * 38)).otherwise(data)).alias("data"))


TABLES["fonts"] = ((), "select doc_id as font, case when doc_id % 5 = 4 then 'no usable map' when doc_id % 17 = 3 then 'truncated' end as error, doc_id % 3 = 0 and doc_id % 17 <> 3 as long from documents where text is not null")


@query("q_cmap_choice", "select font, case when error = 'no usable map' then null else 3 end::int as platform, case when error = 'no usable map' then null when long then 10 else 1 end::int as encoding, case when error = 'no usable map' then null when long then 12 else 4 end::int as format, error from fonts", "fonts")
def cmap_choice(spark: SparkSession, d: str) -> DataFrame:
    return sfnt.chosen_map(cmaps(spark, d)).drop("sub")


@query(
    "q_cmap_glyphs",
    """select font, code_point, gid from (select font, b * 16 + j as code_point, case when long then (b * 7 + font % 100 + j) % 65536 when b % 3 <> 1 then (b * 16 + j + font * 37 + b) % 65536 when (j * 5 + b) % 50 > 0 then ((j * 5 + b) % 50 + font * 37 + b) % 65536 else 0 end as gid
    from fonts join (select distinct doc_id as font, unicode(c)::bigint // 16 as b from (select doc_id, unnest(string_split(text, '')) as c from documents) where c <> '' and unicode(c) > 0 and unicode(c) < 65520) using (font), range(16) t(j) where error is null) where gid > 0""",
    "fonts",
)
def cmap_glyphs(spark: SparkSession, d: str) -> DataFrame:
    return sfnt.glyphs_of(sfnt.chosen_map(cmaps(spark, d)))


TAGS = ["cmap", "glyf", "head", "loca", "name", "post"]
TABLES["font_tables"] = ((), f"select doc_id // 6 as font, {TAGS}[(doc_id % 6 + 1)::int] as tag, strlen(text) as length, case when doc_id % 6 = 2 and strlen(text) >= 12 then substr(hex(text), 1, 16) || '00000000' || substr(hex(text), 25) else hex(text) end as digits from documents where text is not null")
TABLES["sums"] = (
    ("font_tables",),
    "select font, tag, any_value(length) as length, (coalesce(sum(('0x' || rpad(w, 8, '0'))::bigint), 0) % 4294967296)::bigint as checksum from (select font, tag, length, unnest(case when length = 0 then ['0'] else regexp_extract_all(digits, '.{1,8}') end) as w from font_tables) group by font, tag",
)


def font_tables(spark: SparkSession, d: str) -> DataFrame:
    """Six documents make a font, their texts its tables."""
    docs = read(spark, d, "documents").filter("text is not null")
    return docs.select(F.expr("doc_id div 6").alias("font"), F.get(F.array(*map(F.lit, TAGS)), (F.col("doc_id") % 6).cast("int")).alias("tag"), F.col("text").cast("binary").alias("data"))


@query("q_font_checksum", "select font, tag, length, checksum from sums", "sums")
def font_checksum(spark: SparkSession, d: str) -> DataFrame:
    return sfnt.checksums(font_tables(spark, d))


@query(
    "q_table_directory",
    """select font, tag, checksum, 12 + 16 * n + coalesce(sum((length + 3) // 4 * 4) over (partition by font order by tag rows between unbounded preceding and 1 preceding), 0)::bigint as "offset", length, n as tables, 16 * s as search_range, case s when 1 then 0 when 2 then 1 else 2 end as entry_selector, 16 * n - 16 * s as range_shift
    from (select *, case when n >= 4 then 4 when n >= 2 then 2 else 1 end as s from (select *, count(*) over (partition by font) as n from sums where length > 0))""",
    "sums",
)
def table_directory(spark: SparkSession, d: str) -> DataFrame:
    return sfnt.directory(font_tables(spark, d))


def layout_payloads(spark: SparkSession, d: str) -> DataFrame:
    """One answer a page of a layout service: coordinates in several shapes, missing scores and labels, and answers that failed."""
    r = v.regions(spark, d).filter("rid <> 99").selectExpr("doc_id", "page", "rid", "cast(x as int) as a", "cast(y as int) as b", "cast(x + w as int) as c", "cast(y + h as int) as e", "block_type")
    where = "case when rid = 5 then '[1,2]' when rid % 3 = 0 then concat('[', a, ',', b, ',', c, '.5,', e, ']') when rid % 3 = 1 then concat('[[', a, ',', b, '],[', c, ',', b, '],[', c, '.5,', e, '],[', a, ',', e, ']]') else concat('[[', a, ',', e, '],[7],[', c, '.5,', b, ']]') end"
    label = "case when rid % 4 = 1 then concat('\"label\":\"\",\"type\":\"', block_type, '\"') when rid % 4 = 2 then '\"class\":1' else concat('\"label\":\"', block_type, '\"') end"
    score = "case when rid = 4 then '\"score\":0,\"prob\":0.25' when rid = 6 then '\"score\":null' else concat('\"score\":0.', rid + 1) end"
    body = r.select("doc_id", "page", "rid", F.expr(f"concat('{{', {label}, ',\"coordinate\":', {where}, ',', {score}, '}}')").alias("body"))
    pages = body.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rid", "body"))), lambda x: x["body"]), ",").alias("list"))
    kind = (F.col("doc_id") + F.col("page")) % 11
    whole = F.concat(F.lit('{"success":true,"regions":['), "list", F.lit("]}"))
    payload = F.when(kind == 3, '{"success":false,"regions":[]}').when(kind == 5, F.concat(F.lit('{"success":true,"regions":['), "list")).when(kind == 7, "[1,2]").when(kind == 8, '{"success":true}').when(kind == 9, '{"success":true,"regions":7}').otherwise(whole)
    return pages.select("doc_id", "page", payload.alias("payload"))


@query(
    "q_payload_regions",
    """select doc_id, page, rid::int as pos, case when rid <> 5 then case when rid % 4 = 2 then 'text' else block_type end end as label, case rid when 5 then null when 4 then 0.25::double when 6 then 0.0::double else (rid + 1) / 10.0::double end as score,
      case when rid <> 5 then trunc(x) end as x0, case when rid <> 5 then trunc(y) end as y0, case when rid <> 5 then trunc(x + w) + 0.5::double end as x1, case when rid <> 5 then trunc(y + h) end as y1, case when rid = 5 then 'no coordinates' end as error
    from regions where rid <> 99 and (doc_id + page) % 11 not in (3, 5, 7, 8, 9)
    union all select distinct doc_id, page, null::int, null, null::double, null::double, null::double, null::double, null::double, case when (doc_id + page) % 11 = 3 then 'failed' else 'malformed' end from regions where (doc_id + page) % 11 in (3, 5, 7, 9)""",
    "regions",
)
def payload_regions(spark: SparkSession, d: str) -> DataFrame:
    return payloads.regions(layout_payloads(spark, d), ["doc_id", "page"])


def recogniser_payloads(spark: SparkSession, d: str, service: str) -> DataFrame:
    """A recogniser's answer for each page, from the lines' places; every ninth page's failed."""
    lines = v.all_lines(spark, d).selectExpr("doc_id", "page", "line_no", "cast(x as int) as a", "cast(y as int) as b", "cast(x + w as int) as c", "cast(y + h as int) as e", "case when line_no % 13 = 0 then '' else text end as text")
    quoted = F.expr("regexp_extract(to_json(named_struct('t', text)), '^[{]\"t\":(.*)[}]$', 1)")
    if service == "paddle":
        place = F.expr("concat('\"confidence\":0.', line_no % 9 + 1, ',\"bbox\":[[', a, ',', b, '],[', c, ',', b, '],[', c, ',', e, ']', case when line_no % 11 = 0 then '' else concat(',[', a, ',', e, ']') end, ']')")
    else:
        place = F.expr("concat('\"x\":', a, ',\"y\":', b, ',\"w\":', c - a, ',\"h\":', e - b)")
    body = lines.select("doc_id", "page", "line_no", F.concat(F.lit('{"text":'), quoted, F.lit(","), place, F.lit("}")).alias("body"))
    pages = body.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "body"))), lambda x: x["body"]), ",").alias("list"))
    name, must = payloads.SERVICES[service]
    whole = F.concat(F.lit(('{"success":true,' if must else "{") + f'"{name}":['), "list", F.lit("]}"))
    return pages.select("doc_id", "page", F.when((F.col("doc_id") + F.col("page")) % 9 == 4, '{"success":false}' if must else '{"boxes":').otherwise(whole).alias("payload"))


TABLES["read_lines"] = (("all_lines",), "select doc_id, page, (row_number() over (partition by doc_id, page order by line_no) - 1)::int as pos, line_no, text, trunc(x) as x0, trunc(y) as y0, trunc(x + w) as x1, trunc(y + h) as y1 from all_lines")


def d_lines(more: str, confidence: str, error: str) -> str:
    return f"""select doc_id, page, pos, text, {confidence} as confidence, x0, y0, x1, y1, null as error from read_lines where line_no % 13 <> 0 and text <> '' and {more} and (doc_id + page) % 9 <> 4
    union all select distinct doc_id, page, null::int, null, null::double, null::double, null::double, null::double, null::double, '{error}' from read_lines where (doc_id + page) % 9 = 4"""


@query("q_paddle_payloads", d_lines("line_no % 11 <> 0", "(line_no % 9 + 1) / 10.0::double", "failed"), "read_lines")
def paddle_payloads(spark: SparkSession, d: str) -> DataFrame:
    return payloads.lines(recogniser_payloads(spark, d, "paddle"), "paddle", ["doc_id", "page"])


@query("q_tesseract_payloads", d_lines("x1 > x0", "0.0::double", "malformed"), "read_lines")
def tesseract_payloads(spark: SparkSession, d: str) -> DataFrame:
    return payloads.lines(recogniser_payloads(spark, d, "tesseract"), "tesseract", ["doc_id", "page"])


TABLES["turns"] = ((), "select conv_id, row_number() over (partition by conv_id order by turn, text) - 1 as n, text, case when turn % 3 = 0 then 'table' else 'text' end as block_type from conversations where text is not null")


@query(
    "q_fallback_answers",
    f"""select conv_id, n::int as n, text, block_type, case when conv_id % 10 <> 9 then text when (conv_id + n) % 7 <> 3 then '<' || case when block_type = 'table' then '{translate.TABLE_HINT}' else '' end || text || '>' end as translated,
    case when conv_id % 10 <> 9 then 'batch' else 'single' end as via, case when conv_id % 10 = 9 and (conv_id + n) % 7 = 3 then 'timeout' end as error from turns""",
    "turns",
)
def fallback_answers(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as batches whose answers have the wrong length in every tenth; single answers stand in brackets, some time out."""
    turns = read(spark, d, "conversations").filter("text is not null").selectExpr("conv_id", "cast(row_number() over (partition by conv_id order by turn, text) - 1 as int) as n", "text", "case when turn % 3 = 0 then 'table' else 'text' end as block_type")

    def ask(requests: DataFrame) -> DataFrame:
        late = (F.col("conv_id") + F.col("n")) % 7 == 3
        return requests.select("conv_id", "n", F.when(~late, F.concat(F.lit("  <"), "request", F.lit("> \n"))).alias("content"), F.when(late, "timeout").alias("error"))

    return translate.with_fallback(v.responses(spark, d), turns, ask, "conv_id")


@query("q_job_store", "select id, input_path, total_pages, case when id % 13 = 2 then 'failed' when id % 5 = 1 then 'completed' else status end as status from jobs union all select id + 100000000, input_path, total_pages, 'pending' from jobs where id % 31 = 3", "jobs")
def job_store(spark: SparkSession, d: str) -> DataFrame:
    """The jobs in files, after one update of some and another of others, which adds new ones."""
    jobs = v.document_jobs(spark, d).select("id", "input_path", "total_pages", "status")
    store = JobStore(spark, shared_path(spark, "job-store"))
    store.create(jobs)
    store.update(jobs.filter("id % 5 = 1").withColumn("status", F.lit("completed")))
    store.update(jobs.filter("id % 13 = 2").withColumn("status", F.lit("failed")).unionByName(jobs.filter("id % 31 = 3").withColumns({"id": F.col("id") + 100_000_000, "status": F.lit("pending")})))
    return store.read()


@query("q_stream_pages", "select page_id, length(t) as chars, case when length(t) >= 20 then 'native' else 'scanned' end as page_type from (select page_id, trim(regexp_replace(coalesce(html, ''), '<[^>]*>', '', 'g'), ' ') as t from pages)")
def stream_pages(spark: SparkSession, d: str) -> DataFrame:
    """Results of all pages, gathered by a stream over their files."""
    out = shared_path(spark, "page-results")
    results.gather(spark, f"{d}/pages.parquet*", "page_id long, url string, html string", results.classified, out, shared_path(spark, "page-checkpoint")).awaitTermination()
    return results.gathered(spark, out)


@query("q_source_pages", "select page_id, url, length(html) as chars from pages")
def source_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = registered(shipped(spark)).read.format("quire_pages").option("path", f"{d}/pages.parquet").load()
    return pages.select("page_id", "url", F.length("html").cast("long").alias("chars"))
