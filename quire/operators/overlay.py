"""Placing fitted text over the boxes of its source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.fit import fit_text
from quire.functions.script import is_rtl
from quire.functions.text import is_blank, is_formula
from quire.operators.layout import PAGE


def shown(blocks: DataFrame) -> DataFrame:
    """Blocks that get an overlay, with `fit`, computed once for rectangles and lines alike."""
    rows = blocks.filter(~is_blank(F.col("translated")) & ~is_formula(F.coalesce("text", F.lit(""))))
    return rows.withColumn("fit", fit_text(F.col("translated"), F.col("w"), F.col("h"), F.col("font_size")))


def box_height() -> Column:
    return F.greatest(F.col("h"), F.col("fit.box_height"))


def cover_rects(fitted: DataFrame) -> DataFrame:
    """White rectangles behind the text: 0.3 of a font size wider and 0.5 higher on each side. Needs `delta`."""
    f = F.col("font_size")
    return fitted.select(*PAGE, "block_no", (F.col("x") - f * 0.3).alias("rect_x"), (F.col("y") + F.col("delta") - f * 0.5).alias("rect_y"), (F.col("w") + f * 0.3 * 2).alias("rect_w"), (box_height() + f * 0.5 * 2).alias("rect_h"))


def exploded(fitted: DataFrame) -> DataFrame:
    """A row per line, with `rtl` of the whole text.

    The outer form, as there is always a line: for the inner one Spark filters on the lines
    first, which fits each text twice.
    """
    rows = fitted.withColumn("rtl", is_rtl(F.col("translated")))
    return rows.select("*", F.posexplode_outer("fit.lines").alias("line_no", "line"))


def holds(condition: Column) -> Column:
    """A condition on fitted text from which Spark doesn't infer that the text's height isn't null, which it would fit the text again for."""
    return F.coalesce(condition, F.lit(False))


def overlay_lines(fitted: DataFrame) -> DataFrame:
    """A row per line: x, y, size, slot. Lines below the box by more than half a font size are left out.

    y falls with the line number, so leaving out a line leaves out all that follow.
    """
    rows = exploded(fitted)
    y = F.col("y") + F.col("delta") + box_height() - (F.col("line_no") + 1) * F.col("fit.line_height")
    rows = rows.withColumn("line_y", y).filter(holds(F.col("line_y") >= F.col("y") + F.col("delta") - F.col("font_size") * 0.5))
    x = F.when(F.col("rtl"), F.col("x") + F.col("w")).otherwise(F.col("x"))
    return rows.select(*PAGE, "block_no", "line_no", F.col("line").alias("text"), x.alias("line_x"), "line_y", F.col("fit.font_size").alias("size"), F.when(F.col("block_type") == "title", "bold").otherwise("regular").alias("slot"), "rtl")


def image_mode_lines(blocks: DataFrame) -> DataFrame:
    """Lines over a scanned page: from the box's own top, never below its foot."""
    rows = blocks.filter(F.coalesce("translated", F.lit("")) != "").withColumn("fit", fit_text(F.col("translated"), F.col("w"), F.col("h"), F.col("font_size")))
    rows = exploded(rows).withColumn("line_y", F.col("y") + F.col("h") - (F.col("line_no") + 1) * F.col("fit.line_height")).filter(holds(F.col("line_y") >= F.col("y")))
    x = F.when(F.col("rtl"), F.col("x") + F.col("w")).otherwise(F.col("x"))
    return rows.select(*PAGE, "block_no", "line_no", F.col("line").alias("text"), x.alias("line_x"), "line_y", F.col("fit.font_size").alias("size"))
