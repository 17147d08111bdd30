"""Colours of page images by running sums over their pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHANNELS = ("r", "g", "b")


def integral(pixels: DataFrame) -> DataFrame:
    """(image, x, y, r, g, b) -> the same with sums of all pixels up to x and y, in two running windows an image.

    The first runs along rows, the second down columns, so neither sees more than a line. Pixels
    that are missing count as 0 but must not leave gaps that boxes ask for.
    """
    along = W.partitionBy("image", "y").orderBy("x").rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy("image", "x").orderBy("y").rowsBetween(W.unboundedPreceding, 0)
    rows = pixels.select("image", "x", "y", *[F.sum(F.col(c).cast("long")).over(along).alias(c) for c in CHANNELS])
    return rows.select("image", "x", "y", *[F.sum(c).over(down).alias(c) for c in CHANNELS])


def background(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """(image, id, x, y, w, h) in pixels -> image, id, r, g, b: the mean colour of each box's border, from 16-bit channels to 0 .. 1.

    A box's place is moved into its image and its far sides are cut to it; each side is counted,
    so corners count twice. Boxes without extent and those of images without pixels are white.
    Images are dense grids from (0, 0). A side is a sum over a rectangle, four lookups of the
    running sums, whatever its length: a box costs 16.
    """
    sizes = pixels.groupBy("image").agg((F.max("x") + 1).alias("_w"), (F.max("y") + 1).alias("_h"))
    clamp = lambda v, most: F.greatest(F.lit(0), F.least(v, most - 1))
    rows = boxes.join(sizes, "image", "left").withColumns({"_x0": clamp(F.col("x"), F.col("_w")), "_y0": clamp(F.col("y"), F.col("_h"))})
    rows = rows.withColumns({"_x1": F.least(F.col("_x0") + F.col("w"), F.col("_w")) - 1, "_y1": F.least(F.col("_y0") + F.col("h"), F.col("_h")) - 1})
    some = F.col("_w").isNotNull() & (F.col("w") > 0) & (F.col("h") > 0)
    c = F.col

    def side(x0: F.Column, y0: F.Column, x1: F.Column, y1: F.Column) -> list[F.Column]:
        corner = lambda sign, x, y: F.struct(F.lit(sign).alias("sign"), x.cast("int").alias("x"), y.cast("int").alias("y"))
        return [corner(1, x1, y1), corner(-1, x0 - 1, y1), corner(-1, x1, y0 - 1), corner(1, x0 - 1, y0 - 1)]

    x0, y0, x1, y1 = c("_x0"), c("_y0"), c("_x1"), c("_y1")
    corners = F.array(*side(x0, y0, x1, y0), *side(x0, y1, x1, y1), *side(x0, y0, x0, y1), *side(x1, y0, x1, y1))
    count = 2 * (x1 - x0 + 1) + 2 * (y1 - y0 + 1)
    asked = rows.filter(some).select("image", "id", count.alias("_count"), F.inline(F.filter(corners, lambda p: (p["x"] >= 0) & (p["y"] >= 0))))
    found = asked.join(integral(pixels), ["image", "x", "y"]).groupBy("image", "id", "_count").agg(*[F.sum(F.col("sign") * F.col(k)).alias(k) for k in CHANNELS])
    means = found.select("image", "id", *[(F.expr(f"{k} div _count") / 65535.0).alias(k) for k in CHANNELS])
    return boxes.select("image", "id").join(means, ["image", "id"], "left").fillna(1.0, list(CHANNELS))
