"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.arrays import bound

#: Unicode white space; Java's \s leaves out NEL and the separators.
BLANK = r"[\s\x{85}\p{Z}]"


def trim(s: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(s, rf"^{BLANK}+|{BLANK}+$", "")


def is_blank(s: Column) -> Column:
    return ~F.coalesce(s, F.lit("")).rlike(r"[^\s\x{85}\p{Z}]")


def fields(s: Column) -> Column:
    """The words between white space."""
    return F.array_remove(F.split(F.coalesce(s, F.lit("")), f"{BLANK}+"), "")


def collapse(s: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.array_join(fields(s), " ")


def truncate(s: Column, n: int) -> Column:
    """At most n characters, then an ellipsis; empty for n below 1."""
    if n < 1:
        return F.lit("")
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n), F.lit("..."))).otherwise(s)


def extract_json_array(s: Column) -> Column:
    """The JSON array in a model's answer: code fences are stripped, then the first [ to the last ] is kept."""
    t = trim(s)
    opened = F.regexp_replace(t, r"^```(?:json)?", "")
    fenced = F.when(opened.contains("```"), F.regexp_extract(opened, r"(?s)^(.*)```", 1)).otherwise(opened)
    inner = trim(F.when(t.startswith("```"), fenced).otherwise(t))
    found = F.regexp_extract(inner, r"(?s)(\[.*\])", 1)
    return F.when(found != "", found).otherwise(inner)


#: Boxes that stand for characters without a glyph.
FORMULA = r"[\x{25A1}\x{25A0}\x{25FB}\x{25FC}\x{FFFD}]"


def is_formula(s: Column) -> Column:
    return s.rlike(FORMULA)


#: WinAnsi's places 0x80 to 0x9F by code point.
WIN_ANSI = {
    0x20AC: 0x80, 0x201A: 0x82, 0x0192: 0x83, 0x201E: 0x84, 0x2026: 0x85, 0x2020: 0x86, 0x2021: 0x87, 0x02C6: 0x88, 0x2030: 0x89,
    0x0160: 0x8A, 0x2039: 0x8B, 0x0152: 0x8C, 0x017D: 0x8E, 0x2018: 0x91, 0x2019: 0x92, 0x201C: 0x93, 0x201D: 0x94, 0x2022: 0x95,
    0x2013: 0x96, 0x2014: 0x97, 0x02DC: 0x98, 0x2122: 0x99, 0x0161: 0x9A, 0x203A: 0x9B, 0x0153: 0x9C, 0x017E: 0x9E, 0x0178: 0x9F,
}
#: Code points shown as a bullet, a dash or a space.
BULLETS = (0x25CF, 0x25CB, 0x25A0, 0x25AA, 0x2023, 0x25E6, 0x2043, 0x29BE)
DASHES = (0x2012, 0x2015)
SPACES = (0x202F, 0x2007, 0x2060)


def win_ansi(code: Column) -> Column:
    """The WinAnsi byte of a code point; a question mark where there is none."""
    direct = code.between(0x20, 0x7E) | code.between(0xA0, 0xFF)
    table = F.create_map(*[F.lit(x) for pair in WIN_ANSI.items() for x in pair])
    return (
        F.when(direct, code)
        .when(F.map_contains_key(table, code), F.element_at(table, code))
        .when(code.isin(*BULLETS), F.lit(0x95))
        .when(code.isin(*DASHES), F.lit(0x96))
        .when(code.between(0x2190, 0x21FF), F.lit(0x2D))
        .when(code.isin(*SPACES), F.lit(0x20))
        .otherwise(F.lit(0x3F))
    )


#: Characters that stand for another's byte in WinAnsi; all lie outside of NONE, and NONE has no byte.
MAPPED = WIN_ANSI | dict.fromkeys(BULLETS, 0x95) | dict.fromkeys(DASHES, 0x96) | dict.fromkeys(range(0x2190, 0x2200), 0x2D) | dict.fromkeys(SPACES, 0x20)
NONE = r"[\x00-\x1F\x7F-\x9F\x{300}-\x{1FFF}\x{2A00}-\x{10FFFF}]"


def pdf_escape(s: Column) -> Column:
    """A PDF literal string's bytes in hexadecimal, in WinAnsi, with parentheses and backslashes escaped.

    Whole strings at a time: what has no byte becomes a question mark, what stands for another
    byte the character of that number, so that the bytes are those of Latin-1. The classes are
    plain ranges, as a union costs a step a member for each character.
    """
    mapped = lambda t: F.regexp_replace(F.translate(t, "".join(map(chr, MAPPED)), "".join(map(chr, MAPPED.values()))), r"[^\x20-\xFF]", "?")
    latin = bound(F.regexp_replace(s, NONE, "?"), lambda t: F.when(t.rlike(r"[^\x20-\xFF]"), mapped(t)).otherwise(t))
    return F.hex(F.encode(F.regexp_replace(latin, r"([()\\])", r"\\$1"), "ISO-8859-1"))


def net_q_depth(content: Column) -> Column:
    """Lines that only save the graphics state less those that only restore it."""
    lines = F.transform(F.split(content, "\n"), lambda x: trim(x))
    return F.size(F.filter(lines, lambda x: x == "q")) - F.size(F.filter(lines, lambda x: x == "Q"))


def balance(content: Column) -> Column:
    """struct(depth, lowest, opened, closed) of a content stream's lines that only save or only restore the graphics state.

    depth: saves less restores; lowest: the least running sum, 0 at most; opened: saves that must
    go in front so that none is restored before; closed: restores that must follow. One fold
    over the lines.
    """
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("lowest"))

    def step(s: Column, line: Column) -> Column:
        sign = trim(line)
        depth = s["depth"] + F.when(sign == "q", 1).when(sign == "Q", -1).otherwise(0)
        return F.struct(depth.alias("depth"), F.least(s["lowest"], depth).alias("lowest"))

    end = lambda s: F.struct(s["depth"].alias("depth"), s["lowest"].alias("lowest"), (-s["lowest"]).alias("opened"), (s["depth"] - s["lowest"]).alias("closed"))
    return F.aggregate(F.coalesce(F.split(content, "\n"), F.expr("cast(array() as array<string>)")), start, step, end)


def balanced(content: Column) -> Column:
    """A content stream with the saves and restores that it lacks, a line each."""
    b = F.transform(F.array(balance(content)), lambda x: F.concat(F.repeat(F.lit("q\n"), x["opened"]), content, F.repeat(F.lit("\nQ"), x["closed"])))
    return F.get(b, F.lit(0))


def translated_name(path: Column, suffix: str = "_translated") -> Column:
    """base.ext -> base_translated.ext."""
    return F.regexp_replace(path, r"^(.*?)(\.[^./]*)?$", f"$1{suffix}$2")


def page_file(n: Column) -> Column:
    return F.format_string("page_%04d.pdf", n)


def error_class(message: Column) -> Column:
    """Whether a reader's error says that a file is encrypted."""
    low = F.lower(message)
    return F.when(low.contains("encrypted") | low.contains("password"), "encrypted").otherwise("other")


def overridden(base: Column, own: Column) -> Column:
    """A map's entries with those of another in their stead where both have a key."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(own, k)), own)


ENGINES = ("paddleocr", "tesseract")


def config_violations() -> Column:
    """Names of the settings of a row (api_key, ocr_engine, workers, dpi) that aren't valid, comma-joined."""
    bad = [
        F.when(F.coalesce(F.col("api_key"), F.lit("")) == "", "api_key"),
        F.when(~F.col("ocr_engine").isin(*ENGINES), "ocr_engine"),
        F.when(F.col("workers") < 1, "workers"),
        F.when(~F.col("dpi").between(72, 600), "dpi"),
    ]
    return F.array_join(F.array(*bad), ",")


#: Stream filters whose data are images as they stand.
IMAGE_FILTERS = ("DCTDecode", "JPXDecode", "CCITTFaxDecode", "JBIG2Decode")


def is_image_stream(filters: Column) -> Column:
    """Whether any of a stream's filters leaves image data, which are passed on undecoded; no filters (null or empty) mean no."""
    return F.coalesce(F.arrays_overlap(filters, F.array(*map(F.lit, IMAGE_FILTERS))), F.lit(False))
