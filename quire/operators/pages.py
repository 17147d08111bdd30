"""Pages: counting, classifying, choosing a source of text, and lines from a PDF library's spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import trim

NATIVE_CHARS = 20


def classify(pages: DataFrame) -> DataFrame:
    """Adds page_type: native with 20 characters of text or more, else (unreadable text too) scanned."""
    enough = F.length(trim(F.col("page_text"))) >= NATIVE_CHARS
    return pages.withColumn("page_type", F.when(F.coalesce(enough, F.lit(False)), "native").otherwise("scanned"))


def page_texts(lines: DataFrame) -> DataFrame:
    return lines.groupBy("doc_id", "page").agg(F.count("*").alias("n_lines"))


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.count("*").alias("total_pages"))


def ranges(text: str) -> list[tuple[int, int]]:
    """'1,3-5' -> [(1, 1), (3, 5)]; raises ValueError for anything else."""
    out = []
    for part in text.split(","):
        a, dash, b = part.strip().partition("-")
        low, high = int(a), int(b) if dash else int(a)
        if not 1 <= low <= high:
            raise ValueError(f"invalid page range: {part!r}")
        out.append((low, high))
    return out


def in_ranges(page_num: Column, text: str) -> Column:
    found = F.lit(False)
    for low, high in ranges(text):
        found = found | page_num.between(low, high)
    return found


def route(native: DataFrame, ocr: DataFrame, kinds: DataFrame) -> DataFrame:
    """Lines of native pages from their text, of all others from recognition. Adds `route`."""
    keys = [c for c in ("doc_id", "page") if c in kinds.columns]
    pick = lambda lines, kind, name: lines.join(kinds.filter(F.col("page_type") == kind).select(*keys), keys, "left_semi").withColumn("route", F.lit(name))
    return pick(native, "native", "native").unionByName(pick(ocr, "scanned", "ocr"))


def used_runes(pages: DataFrame) -> DataFrame:
    """Distinct code points of each document."""
    chars = pages.select("doc_id", F.explode(F.array_distinct(F.split("page_text", ""))).alias("c")).filter("c <> ''")
    return chars.select("doc_id", F.ascii("c").alias("code_point")).distinct()


def font_sums() -> tuple[Column, ...]:
    counted = (F.col("end_x") > F.col("x")) & (F.length("text") > 0)
    return F.sum(F.when(counted, F.col("end_x") - F.col("x"))).alias("_wide"), F.sum(F.when(counted, F.length("text"))).alias("_chars"), F.min_by("raw_font_size", "span_no").alias("_raw")


def effective_size() -> Column:
    """The larger of the first span's size and the mean character width over 0.5; 12 where neither is positive."""
    wide = F.when(F.col("_chars") > 0, F.col("_wide") / F.col("_chars") / 0.5)
    return F.when(wide > F.col("_raw"), wide).when(F.col("_raw") > 0, F.col("_raw")).otherwise(12.0)


def gathered(spans: DataFrame) -> DataFrame:
    """A row per line of spans, with `spans` in their order."""
    return spans.groupBy("doc_id", "page", "line_no").agg(F.sort_array(F.collect_list(F.struct("span_no", "text", "x", "end_x", "y", "raw_font_size", "font"))).alias("spans"))


def native_lines(spans: DataFrame) -> DataFrame:
    """One line per group of spans: box, text, size and first font. Lines without spans don't occur.

    Spans are rows, which are gathered by line first, or lines that hold their `spans` already,
    one at least, as most libraries give them: these are worked on where they are, without a shuffle.
    """
    lines = spans if "spans" in spans.columns else gathered(spans)
    counted = F.filter("spans", lambda s: (s["end_x"] > s["x"]) & (F.length(s["text"]) > 0))
    sums = F.aggregate(counted, F.struct(F.lit(0.0).alias("wide"), F.lit(0).cast("long").alias("chars")), lambda a, s: F.struct((a["wide"] + (s["end_x"] - s["x"])).alias("wide"), (a["chars"] + F.length(s["text"])).alias("chars")))
    g = lines.withColumn("_f", sums).withColumns({"_wide": F.col("_f.wide"), "_chars": F.col("_f.chars"), "_raw": F.col("spans")[0]["raw_font_size"]})
    g = g.withColumns({"x": F.array_min("spans.x"), "y": F.array_min("spans.y"), "_e": F.array_max("spans.end_x"), "font_size": effective_size()})
    return g.select("doc_id", "page", "line_no", "x", "y", (F.col("_e") - F.col("x")).alias("w"), (F.col("font_size") * 1.2).alias("h"), F.array_join("spans.text", " ").alias("text"), "font_size", F.col("spans")[0]["font"].alias("font_name"))
