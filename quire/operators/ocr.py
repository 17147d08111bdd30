"""Shaping what recognisers and layout models return."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.geometry import classified, px_to_pt
from quire.functions.text import trim

#: Block type of each layout label; all others are text.
LABELS = {
    "doc_title": "title", "paragraph_title": "title", "title": "title", "header": "header", "page_header": "header",
    "footer": "footer", "page_footer": "footer", "page_number": "footer", "footnote": "footer", "vision_footnote": "footer",
    "figure_title": "caption", "table_title": "caption", "chart_title": "caption", "caption": "caption", "table": "table",
    "image": "image", "figure": "image", "chart": "image", "seal": "image", "formula": "image", "equation": "image",
}


def block_type(label: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return F.coalesce(table[F.lower(trim(label))], F.lit("text"))


def polygon_box(polygon: Column) -> dict[str, Column]:
    """left, right, upper and lower edge of a polygon of pixels."""
    xs, ys = F.transform(polygon, lambda p: p[0]), F.transform(polygon, lambda p: p[1])
    return {"_l": F.array_min(xs), "_r": F.array_max(xs), "_u": F.array_min(ys), "_b": F.array_max(ys)}


def placed(df: DataFrame, page_height: float, dpi: int, flip: bool) -> DataFrame:
    """x, y, w, h in points from _l, _r, _u, _b in pixels; y grows upward where `flip`."""
    pt = lambda c: px_to_pt(F.col(c), F.lit(dpi))
    h = px_to_pt(F.col("_b") - F.col("_u"), F.lit(dpi))
    y = F.lit(page_height) - pt("_u") - h if flip else pt("_u")
    return df.withColumns({"x": pt("_l"), "y": y, "w": px_to_pt(F.col("_r") - F.col("_l"), F.lit(dpi)), "h": h}).drop("_l", "_r", "_u", "_b")


def polygon_lines(details: DataFrame, page_height: float = 792.0, dpi: int = 300, flip: bool = True) -> DataFrame:
    """Recognised polygons to text lines; fewer than four points or empty text are left out."""
    rows = details.filter((F.size("bbox") >= 4) & (F.col("text") != "") & (F.size(F.col("bbox")[0]) >= 2))
    rows = placed(rows.drop("x", "y", "w", "h").withColumns(polygon_box(F.col("bbox"))), page_height, dpi, flip)
    return rows.withColumn("_c", classified(F.col("h"))).withColumns({"font_size": F.col("_c.font_size"), "block_type": F.col("_c.block_type")}).drop("_c", "bbox")


def box_lines(boxes: DataFrame, page_height: float = 792.0, dpi: int = 300, flip: bool = False) -> DataFrame:
    """Recognised boxes (x, y, w, h in pixels) to text lines; empty text is left out."""
    rows = boxes.filter("text <> ''").withColumns({"_l": F.col("x"), "_r": F.col("x") + F.col("w"), "_u": F.col("y"), "_b": F.col("y") + F.col("h")})
    rows = placed(rows, page_height, dpi, flip)
    return rows.withColumn("_c", classified(F.col("h"))).withColumns({"font_size": F.col("_c.font_size"), "block_type": F.col("_c.block_type")}).drop("_c")


def normalised(raw: DataFrame) -> DataFrame:
    """A page's texts, scores and polygons by position to details and their mean confidence.

    A missing score is 0; empty texts and texts without a polygon of four points are left out.
    """
    zipped = F.transform("rec_texts", lambda t, i: F.struct(i.alias("i"), t.alias("text"), F.coalesce(F.get("rec_scores", i), F.lit(0.0)).alias("confidence"), F.get("rec_polys", i).alias("bbox")))
    details = F.filter(zipped, lambda d: (d["text"] != "") & d["bbox"].isNotNull() & (F.size(d["bbox"]) >= 4))
    out = raw.withColumn("details", details)
    total = F.aggregate("details", F.lit(0.0), lambda s, d: s + d["confidence"])
    return out.select(*[c for c in raw.columns if not c.startswith("rec_")], F.array_join("rec_texts", " ").alias("text"), F.when(F.size("details") > 0, total / F.size("details")).otherwise(0.0).alias("confidence"), "details")


def shaped_regions(boxes: DataFrame) -> DataFrame:
    """Raw layout boxes: four coordinates, a label (text where missing) and a score (prob where missing or 0)."""
    label = F.coalesce(F.nullif("label", F.lit("")), F.lit("text"))
    return boxes.filter(F.size("coordinate") == 4).withColumns({"label": label, "score": F.coalesce(F.nullif("score", F.lit(0.0)), "prob", F.lit(0.0))}).drop("prob")


def layout_regions(shaped: DataFrame, page_height: float = 792.0, dpi: int = 300) -> DataFrame:
    """Layout boxes to regions; those without a positive extent are left out."""
    c = lambda i: F.col("coordinate")[i]
    rows = shaped.filter((c(2) > c(0)) & (c(3) > c(1))).withColumns({"_l": c(0), "_u": c(1), "_r": c(2), "_b": c(3)})
    rows = placed(rows, page_height, dpi, True)
    return rows.withColumns({"block_type": block_type(F.col("label")), "font_size": F.greatest(F.col("h") * 0.75, F.lit(1.0))}).drop("coordinate")
