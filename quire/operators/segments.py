"""Splitting a page into text and diagram strips, and laying the strips out on a longer page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.text import is_blank
from quire.operators.layout import PAGE, is_textual

HEIGHT = 792.0
GAP = 10.0
LEAST_PAD, MOST_PAD = 12.0, 28.0


def diagram_regions(blocks: DataFrame) -> DataFrame:
    """Image blocks whose y intervals overlap, merged: y_low, y_high, n_images. Touching intervals stay apart."""
    top = F.col("y") + F.col("h")
    w = W.partitionBy(*PAGE).orderBy(F.desc("_top"), "block_no")
    rows = blocks.filter(~is_textual(F.col("block_type"))).select(*PAGE, "block_no", "y", top.alias("_top"))
    fresh = F.coalesce(F.col("_top") <= F.min("y").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(True))
    rows = rows.withColumn("_new", fresh.cast("int")).withColumn("_i", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(*PAGE, "_i").agg(F.min("y").alias("y_low"), F.max("_top").alias("y_high"), F.count("*").alias("n_images")).drop("_i")


def segments(blocks: DataFrame, height: float = HEIGHT) -> DataFrame:
    """Strips of each page from the top: seg_no, is_diagram, y_low, y_high.

    A page without images is one text strip around its non-blank blocks, or none; else text
    strips fill what lies between and beside the merged image regions.
    """
    strip = lambda diagram, low, high: F.struct(F.lit(diagram).alias("is_diagram"), low.alias("y_low"), high.alias("y_high"))
    w = W.partitionBy(*PAGE).orderBy(F.desc("y_high"), F.desc("y_low"))
    low, high = F.col("y_low"), F.col("y_high")
    above, last = F.coalesce(F.lag("y_low").over(w), F.lit(height)), F.lead("y_low").over(w).isNull()
    cut = diagram_regions(blocks).withColumns({"_above": above, "_last": last})
    parts = F.filter(F.array(F.when(F.col("_above") > high, strip(False, high, F.col("_above"))), strip(True, low, high), F.when(F.col("_last") & (low > 0), strip(False, F.lit(0.0), low))), lambda s: s.isNotNull())
    framed = cut.select(*PAGE, F.explode(parts).alias("s")).select(*PAGE, "s.*")
    words = ~is_blank(F.col("text"))
    pure = blocks.groupBy(*PAGE).agg(F.max((~is_textual(F.col("block_type"))).cast("int")).alias("_img"), F.min(F.when(words, F.col("y"))).alias("_l"), F.max(F.when(words, F.col("y") + F.col("h"))).alias("_h")).filter("_img = 0 and _l is not null")
    plain = pure.select(*PAGE, F.lit(False).alias("is_diagram"), F.least(F.lit(height), "_l").alias("y_low"), F.greatest(F.lit(0.0), "_h").alias("y_high"))
    return framed.unionByName(plain).withColumn("seg_no", F.row_number().over(w))


def assigned(blocks: DataFrame, strips: DataFrame) -> DataFrame:
    """Adds seg_no to blocks: the strip with the nearest middle, the upper one on ties; images only go to diagrams.

    A page's strips come as one array, so each block meets them in one row. Blank blocks of
    pages without diagrams belong to none and go.
    """
    pages = strips.groupBy(*PAGE).agg(F.collect_list(F.struct("seg_no", "is_diagram", "y_low", "y_high")).alias("_s"))
    middle = F.col("y") + F.col("h") / 2
    own = F.filter("_s", lambda s: s["is_diagram"] | is_textual(F.col("block_type")))
    best = F.array_min(F.transform(own, lambda s: F.struct(F.abs(middle - (s["y_low"] + s["y_high"]) / 2), s["seg_no"].alias("seg_no"))))
    joined = blocks.join(pages, list(PAGE)).filter(F.exists("_s", lambda s: s["is_diagram"]) | ~is_blank(F.col("text")))
    return joined.withColumn("seg_no", best["seg_no"]).drop("_s").filter("seg_no is not null")


def paddings(placed: DataFrame) -> DataFrame:
    """Padding of each strip from its blocks' heights."""
    h = placed.groupBy(*PAGE, "seg_no").agg(F.max("h").alias("_max"), F.min("h").alias("_min"))
    wide = F.greatest(F.col("_max") * 1.75, F.when(F.col("_min") > 0, F.col("_min") * 2).otherwise(F.lit(0.0)))
    return h.select(*PAGE, "seg_no", F.when(F.col("_max") == 0, F.lit(LEAST_PAD)).otherwise(F.least(F.greatest(wide, F.lit(LEAST_PAD)), F.lit(MOST_PAD))).alias("pad"))


def refined(strips: DataFrame, placed: DataFrame, height: float = HEIGHT) -> DataFrame:
    """Adds render_low and render_high: diagrams grow by their padding, little into text strips, and stay on the page."""
    w = W.partitionBy(*PAGE).orderBy("seg_no")
    s = strips.join(paddings(placed), [*PAGE, "seg_no"], "left")
    pad = F.col("pad")
    high, low = F.col("y_high") + pad, F.col("y_low") - pad
    room = F.least(pad * 0.5, F.lit(8.0))
    high = F.when(~F.lag("is_diagram").over(w), F.least(high, F.lag("y_low").over(w) + room)).otherwise(high)
    low = F.when(~F.lead("is_diagram").over(w), F.greatest(low, F.lead("y_high").over(w) - room)).otherwise(low)
    s = s.withColumns({"_high": F.least(high, F.lit(height)), "_low": F.greatest(low, F.lit(0.0))})
    grown = F.col("is_diagram") & pad.isNotNull() & (F.col("_high") > F.col("_low"))
    return s.select(*PAGE, "seg_no", "is_diagram", "y_low", "y_high", F.when(grown, F.col("_low")).otherwise(F.col("y_low")).alias("render_low"), F.when(grown, F.col("_high")).otherwise(F.col("y_high")).alias("render_high"))


def laid_out(strips: DataFrame, height: float = HEIGHT) -> DataFrame:
    """Adds total_height, out_low (of the last copy shown) and delta, the shift of overlays, to refined strips.

    Text strips keep their height; diagrams are shown twice with a gap. The page's margins stay.
    """
    every, w = W.partitionBy(*PAGE), W.partitionBy(*PAGE).orderBy("seg_no")
    h = F.col("render_high") - F.col("render_low")
    s = strips.withColumns({"_h": h, "_out": F.when(F.col("is_diagram"), h * 2 + GAP).otherwise(h)})
    top = F.greatest(F.lit(0.0), height - F.max_by("render_high", -F.col("seg_no")).over(every))
    bottom = F.greatest(F.lit(0.0), F.max_by("render_low", "seg_no").over(every))
    s = s.withColumns({"_top": top, "_sum": top + bottom + F.sum("_out").over(every)})
    s = s.withColumn("total_height", F.when(F.col("_sum") == 0, F.lit(height)).otherwise(F.col("_sum")))
    used = F.sum("_out").over(w.rowsBetween(W.unboundedPreceding, 0))
    s = s.withColumn("out_low", F.col("total_height") - F.col("_top") - used)
    delta = F.col("out_low") - F.when(F.col("is_diagram"), F.col("render_low")).otherwise(F.col("y_low"))
    return s.withColumn("delta", delta).drop("_h", "_out", "_top", "_sum")
