"""Coordinates, colours and small arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TITLE_SIZE = 16.0
HEIGHT_TO_FONT = 0.75


def px_to_pt(px: Column, dpi: Column) -> Column:
    """Pixels to points; a dpi of 0 or less counts as 72."""
    return px * 72.0 / F.when(dpi <= 0, F.lit(72.0)).otherwise(dpi.cast("double"))


def classified(height: Column) -> Column:
    """(font_size, block_type) of a recognised line: titles are larger than 16 points."""
    size = height * HEIGHT_TO_FONT
    return F.struct(size.alias("font_size"), F.when(size > TITLE_SIZE, "title").otherwise("text").alias("block_type"))


def centre_in(x: Column, y: Column, r: str) -> Column:
    """Whether a point lies in a rectangle of alias r, edges included."""
    c = lambda n: F.col(f"{r}.{n}")
    return (x >= c("x")) & (x <= c("x") + c("w")) & (y >= c("y")) & (y <= c("y") + c("h"))


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def is_white(r: Column, g: Column, b: Column) -> Column:
    return (r > 0.95) & (g > 0.95) & (b > 0.95)


def to_byte(x: Column) -> Column:
    return (x * 255).cast("int")


def media_box(box: Column) -> Column:
    """(w, h) of a page's box of four numbers, else US letter."""
    return F.when(F.size(box) >= 4, F.struct((box[2] - box[0]).alias("w"), (box[3] - box[1]).alias("h"))).otherwise(F.struct(F.lit(612.0).alias("w"), F.lit(792.0).alias("h")))
