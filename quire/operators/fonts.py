"""Relational parts of font handling: resolution, encoding, glyph closure, width runs and offsets."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.session import staged

#: Font file of each script.
FONTS = {
    "latin": "NotoSans-Regular.ttf", "cyrillic": "NotoSans-Regular.ttf", "arabic": "NotoSansArabic-Regular.ttf", "hebrew": "NotoSansHebrew-Regular.ttf",
    "devanagari": "NotoSansDevanagari-Regular.ttf", "thai": "NotoSansThai-Regular.ttf", "korean": "NotoSansKR-Regular.ttf", "cjk": "NotoSansSC-Regular.ttf",
}


def resolved(scripts: DataFrame, overrides: Mapping[str, str], cached: Column) -> DataFrame:
    """Adds the font file and path: the settings' own file for a script, else the cached one, else one to fetch; unknown scripts take latin's."""
    table = F.create_map(*[F.lit(x) for pair in FONTS.items() for x in pair])
    own = F.create_map(*[F.lit(x) for pair in overrides.items() for x in pair]) if overrides else F.expr("cast(map() as map<string,string>)")
    file = F.coalesce(table[F.col("script")], F.lit(FONTS["latin"]))
    return scripts.withColumns({"file": file, "path": F.coalesce(F.nullif(own[F.col("script")], F.lit("")), F.when(cached, F.concat(F.lit("/cache/"), file)), F.concat(F.lit("fetch:"), file))})


def missing(catalogue: DataFrame, cached: DataFrame) -> DataFrame:
    return catalogue.select("file").distinct().join(cached, "file", "left_anti")


def encoded(texts: DataFrame, glyphs: DataFrame) -> DataFrame:
    """(font, id, text) -> font, id, hex: each text's glyph numbers in its font in hexadecimal; 0 for characters without a glyph.

    Row by row: a font's glyphs travel to its texts in one row, as an array of blocks of 256 code
    points each, so a character costs two array lookups, whatever the font's size. A row holds
    at most 65,536 glyphs; the table of fonts is written, so Spark sees its size before it
    broadcasts it.
    """
    hexed = F.lpad(F.hex("gid"), 4, "0").alias("hex")
    cells = glyphs.select("font", F.floor(F.col("code_point") / 256).cast("int").alias("block"), F.struct((F.col("code_point") % 256).alias("at"), hexed).alias("e"))
    blocks = cells.groupBy("font", "block").agg(F.map_from_entries(F.sort_array(F.collect_set("e"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.element_at("m", i))
    fonts = blocks.select("font", F.struct("block", dense.alias("d")).alias("b")).groupBy("font").agg(F.map_from_entries(F.sort_array(F.collect_list("b"))).alias("m"))
    fonts = fonts.select("font", F.transform(F.sequence(F.lit(0), F.array_max(F.map_keys("m"))), lambda i: F.element_at("m", i)).alias("_table"))
    table = staged(fonts, "font-glyphs")
    chars = F.filter(F.split("text", ""), lambda c: c != "")
    code = lambda c: F.ascii(c)
    each = F.transform(chars, lambda c: F.coalesce(F.get(F.get("_table", F.floor(code(c) / 256).cast("int")), code(c) % 256), F.lit("0000")))
    return texts.join(table, "font", "left").select("font", "id", F.coalesce(F.array_join(each, ""), F.lit("")).alias("hex"))


def closure(used: DataFrame, parts: DataFrame) -> DataFrame:
    """(font, gid) of the glyphs used, with all that composite glyphs (font, gid, part) are made of, to any depth.

    Each level is written and only the newest is joined, so the plan is one scan a level.
    """
    newest = found = staged(used.select("font", "gid").distinct(), "glyphs")
    while True:
        newest = staged(newest.join(parts, ["font", "gid"]).select("font", F.col("part").alias("gid")).distinct().join(found, ["font", "gid"], "left_anti"), "glyph-parts")
        if newest.isEmpty():
            return found
        found = found.unionByName(newest)


def width_runs(glyphs: DataFrame) -> DataFrame:
    """Runs of consecutive glyph numbers of each font: first, last, and their widths. A font's window has at most 65,536 rows."""
    each = glyphs.select("font", "gid", "advance").distinct()
    runs = each.withColumn("_r", F.col("gid") - F.row_number().over(W.partitionBy("font").orderBy("gid"))).groupBy("font", "_r")
    return runs.agg(F.min("gid").alias("first"), F.max("gid").alias("last"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("gid", "advance"))), lambda g: g["advance"].cast("string")), " ").alias("widths")).drop("_r")


def offsets(glyphs: DataFrame) -> DataFrame:
    """Where each glyph's outline starts when a font's are stored in order, each padded to four bytes."""
    each = glyphs.select("font", "gid", "glyph_len").distinct().withColumn("padded", F.expr("(glyph_len + 3) div 4 * 4"))
    return each.select("font", "gid", "padded", F.coalesce(F.sum("padded").over(W.partitionBy("font").orderBy("gid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset"))


def to_unicode(glyphs: DataFrame, chunk: int = 100) -> DataFrame:
    """The smallest code point of each glyph of a font, numbered in chunks."""
    g = glyphs.groupBy("font", "gid").agg(F.min("code_point").alias("code_point"))
    return g.withColumn("chunk", F.expr(f"(row_number() over (partition by font order by gid) - 1) div {chunk}"))


def cmap_text(name: str) -> tuple[str, str]:
    """What stands before and behind the entries of a ToUnicode map: a CMap resource of two-byte codes, as PostScript."""
    system = {"Registry": "(Quire)", "Ordering": "(Unicode)", "Supplement": "0"}
    info = " ".join(f"/{k} {v} def" for k, v in system.items())
    keys = {"CMapName": f"/Quire-{name}", "CMapType": "2", "WMode": "0"}
    head = ["/CIDInit /ProcSet findresource begin", "16 dict begin", "begincmap", f"/CIDSystemInfo {len(system)} dict dup begin {info} end def", *[f"/{k} {v} def" for k, v in keys.items()], "1 begincodespacerange <0000> <FFFF> endcodespacerange"]
    tail = ["endcmap", "CMapName currentdict /CMap defineresource pop", "end end"]
    return "\n".join([*head, ""]), "\n".join([*tail, ""])


def unicode_map(glyphs: DataFrame, chunk: int = 100) -> DataFrame:
    """(font, cmap): the ToUnicode map of each font as one text, its entries in order of glyph numbers, at most `chunk` a section.

    Code points above U+FFFF are surrogate pairs. A font has 65,536 glyphs at most, so the text is bounded.
    """
    four = lambda n: F.lpad(F.hex(n.cast("long")), 4, "0")
    point = F.col("code_point")
    over = point - 0x10000
    utf16 = F.when(point < 0x10000, four(point)).otherwise(F.concat(four(0xD800 + F.shiftright(over, 10)), four(0xDC00 + over.bitwiseAND(0x3FF))))
    entry = F.concat(F.lit("<"), four(F.col("gid")), F.lit("> <"), utf16, F.lit(">\n"))
    parts = to_unicode(glyphs, chunk).groupBy("font", "chunk").agg(F.sort_array(F.collect_list(F.struct("gid", entry.alias("entry")))).alias("e"))
    section = F.concat(F.size("e").cast("string"), F.lit(" beginbfchar\n"), F.array_join(F.transform("e", lambda e: e["entry"]), ""), F.lit("endbfchar\n"))
    whole = parts.groupBy("font").agg(F.sort_array(F.collect_list(F.struct("chunk", section.alias("section")))).alias("s"))
    head, tail = cmap_text("\0")
    named = F.replace(F.lit(head), F.lit("\0"), F.col("font"))
    return whole.select("font", F.concat(named, F.array_join(F.transform("s", lambda s: s["section"]), ""), F.lit(tail)).alias("cmap"))
