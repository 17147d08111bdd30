"""Registration of queries with their oracles, and the fixtures' DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

BLANK = r"[\s\x0B\x{85}\p{Z}]"


def query(name: str, sql: str, *tables: str) -> Callable[[Query], Query]:
    """Registers a query; its oracle may use the named common table expressions and those that they need."""

    def keep(f: Query) -> Query:
        QUERIES[name] = f
        ORACLES[name] = with_tables(sql, *tables)
        return f

    return keep


def with_tables(sql: str, *tables: str) -> str:
    order: list[str] = []

    def visit(t: str) -> None:
        needs, _ = TABLES[t]
        for n in needs:
            visit(n)
        if t not in order:
            order.append(t)

    for t in tables:
        visit(t)
    return ("with recursive " + ",\n".join(f"{t} as ({TABLES[t][1]})" for t in order) + "\n" if order else "") + sql


def d_trim(s: str) -> str:
    return f"regexp_replace({s}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def d_fields(s: str) -> str:
    return rf"regexp_extract_all({s}, '[^\s\x0B\x{{85}}\p{{Z}}]+')"


def d_collapse(s: str) -> str:
    return f"array_to_string({d_fields(s)}, ' ')"


#: Name -> (names it needs, SQL).
TABLES: dict[str, tuple[tuple[str, ...], str]] = {
    "v0": ((), "select doc_id, '/docs/' || doc_id || '.pdf' as path, text as page_text from documents"),
    "raw_lines": ((), "select doc_id, unnest(string_split(text, chr(10))) as text, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::int as line_no from documents"),
    "all_lines": (
        ("raw_lines",),
        """select doc_id, line_no // 40 as page, line_no, (72 + (doc_id * 7 + line_no * 13) % 5)::double as x, (740 - (line_no % 40) * 17)::double as y,
        length(text) * (case when line_no % 10 = 0 then 18.0::double else 12.0::double end) * 0.5::double as w,
        (case when line_no % 10 = 0 then 18.0::double else 12.0::double end) * 1.2::double as h, text,
        case when line_no % 10 = 0 then 18.0::double else 12.0::double end as font_size, 'F' || (line_no % 3) as font_name,
        case when line_no % 10 = 0 then 'title' else 'text' end as block_type from raw_lines""",
    ),
    "lines": (("all_lines",), f"select * from all_lines where {d_trim('text')} <> ''"),
    "regions": (
        ("raw_lines",),
        """select doc_id, page, rid, case when rid = 99 then 50.0::double else 60.0::double end as x,
        case when rid = 99 then 40.0::double else (740 - 17 * (5 * rid + 4) - 2)::double end as y,
        case when rid = 99 then 540.0::double else 500.0::double end as w, case when rid = 99 then 730.0::double else 85.0::double end as h,
        case when rid = 99 then 'text' else case (doc_id + page + rid) % 6 when 0 then 'title' when 1 then 'image' when 2 then 'table' else 'text' end end as block_type
        from (select distinct doc_id, line_no // 40 as page from raw_lines), (select unnest([0, 1, 2, 3, 4, 5, 6, 7, 99]) as rid) where rid < 99 or doc_id % 3 = 0""",
    ),
    "leaves": (
        ("regions",),
        """select * from regions o where block_type <> 'image' and not exists (select 1 from regions t where t.doc_id = o.doc_id and t.page = o.page
        and not (t.x + t.w / 2 = o.x + o.w / 2 and t.y + t.h / 2 = o.y + o.h / 2)
        and t.x + t.w / 2 > o.x and t.x + t.w / 2 < o.x + o.w and t.y + t.h / 2 > o.y and t.y + t.h / 2 < o.y + o.h)""",
    ),
    "matched": (
        ("lines", "leaves"),
        """select l.*, r.rid, r.block_type as region_type from lines l join leaves r on l.doc_id = r.doc_id and l.page = r.page
        and l.x + l.w / 2 between r.x and r.x + r.w and l.y + l.h / 2 between r.y and r.y + r.h""",
    ),
    "unmatched": (
        ("lines", "matched", "regions"),
        """select * from lines l where not exists (select 1 from matched m where m.doc_id = l.doc_id and m.line_no = l.line_no)
        and not exists (select 1 from regions r where r.doc_id = l.doc_id and r.page = l.page and r.block_type = 'image'
        and l.x + l.w / 2 between r.x and r.x + r.w and l.y + l.h / 2 between r.y and r.y + r.h)""",
    ),
    "merged": (
        ("matched",),
        """select doc_id, page, rid, min(x) as x, min(y) as y, max(x + w) - min(x) as w, max(y + h) - min(y) as h, string_agg(text, ' ' order by y desc, line_no) as text,
        sum(font_size) / count(*) as font_size, arg_max(font_name, y) as font_name, any_value(region_type) as block_type, count(*) as n_lines from matched group by all""",
    ),
    "blocks": (
        ("merged", "unmatched", "regions"),
        """select doc_id, page, x, y, w, h, text, font_size, font_name, block_type, origin, row_number() over (partition by doc_id, page order by o, k)::int as block_no from (
        select doc_id, page, x, y, w, h, text, font_size, font_name, block_type, 'region' as origin, 0 as o, rid as k from merged
        union all select doc_id, page, x, y, w, h, text, font_size, font_name, block_type, 'unmatched', 1, line_no from unmatched
        union all select doc_id, page, x, y, w, h, '', greatest(h * 0.75::double, 1.0::double), '', block_type, 'image', 2, rid from regions where block_type = 'image')""",
    ),
    "spans": (
        ("all_lines",),
        """select doc_id, page, line_no, (i - 1)::int as span_no, y, ws[i] as text, 72.0::double + off_ * cw as x, 72.0::double + off_ * cw + length(ws[i]) * cw as end_x,
        1.0::double + line_no % 14 as raw_font_size, 'F' || ((i - 1) % 3) as font from (
        select *, generate_subscripts(ws, 1) as i, unnest(list_transform(ws, lambda w, j: coalesce(list_sum(list_transform(ws[:j - 1], lambda v: length(v) + 1)), 0)::bigint)) as off_
        from (select *, list_filter(string_split(text, ' '), lambda w: w <> '') as ws, 5 + doc_id % 5 as cw from all_lines))""",
    ),
}
