"""Assigning text lines to layout regions, and merging them into blocks in reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.geometry import centre_in
from quire.functions.text import is_blank
from quire.session import merged, parted, staged, staged_numbers, tasks_for

PAGE = ("doc_id", "page")
#: Lines no further apart than this in y are on one level.
BAND = 2.0


def on_page(a: str, b: str) -> Column:
    """The equality that makes every range join here a hash join with the range as its residue."""
    return (F.col(f"{a}.doc_id") == F.col(f"{b}.doc_id")) & (F.col(f"{a}.page") == F.col(f"{b}.page"))


def centre(t: str) -> tuple[Column, Column]:
    return F.col(f"{t}.x") + F.col(f"{t}.w") / 2, F.col(f"{t}.y") + F.col(f"{t}.h") / 2


def is_textual(kind: Column) -> Column:
    return kind != "image"


def keyed_like(regions: DataFrame, lines: DataFrame) -> DataFrame:
    """Regions whose page keys have the lines' types.

    Else a join with the lines casts them, and leaf regions, which lie by page already, are shuffled
    and sorted again, in a stage whose tasks are as many as the few bytes of its files call for.
    """
    return regions.withColumns({c: F.col(c).cast(lines.schema[c].dataType) for c in PAGE})


def leaf_regions(regions: DataFrame) -> DataFrame:
    """Textual regions that hold no other region's centre strictly inside; equal centres don't count."""
    (ox, oy), (tx, ty) = centre("o"), centre("t")
    o = lambda c: F.col(f"o.{c}")
    inside = (tx > o("x")) & (tx < o("x") + o("w")) & (ty > o("y")) & (ty < o("y") + o("h"))
    return regions.alias("o").filter(is_textual(F.col("block_type"))).join(merged(regions.alias("t")), on_page("o", "t") & ~((ox == tx) & (oy == ty)) & inside, "left_anti")


def matched_lines(lines: DataFrame, leaves: DataFrame, how: str = "inner") -> DataFrame:
    """Non-blank lines with each leaf region that holds their centre; a line can lie in several."""
    x, y = centre("l")
    r = leaves.select(*PAGE, "rid", *(F.col(c).alias(c) for c in ("x", "y", "w", "h")), F.col("block_type").alias("region_type"))
    joined = lines.filter(~is_blank(F.col("text"))).alias("l").join(merged(r.alias("r")), on_page("l", "r") & centre_in(x, y, "r"), how)
    return joined.select("l.*", "r.rid", "r.region_type")


def in_leaves(lines: DataFrame, regions: DataFrame, how: str = "inner") -> DataFrame:
    """matched_lines with the regions' leaves, all dealt by page to as many tasks as the lines' bytes call for."""
    tasks = tasks_for(lines)
    leaves = leaf_regions(parted(keyed_like(regions, lines), tasks, *PAGE))
    return matched_lines(parted(lines, tasks, *PAGE), leaves, how)


def outside_images(unmatched: DataFrame, regions: DataFrame) -> DataFrame:
    """Lines whose centre lies in no image region."""
    x, y = centre("l")
    images = regions.filter(~is_textual(F.col("block_type")))
    return unmatched.alias("l").join(merged(images.alias("i")), on_page("l", "i") & centre_in(x, y, "i"), "left_anti")


def unmatched_lines(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """Non-blank lines in no leaf region and no image. The regions are written once, as they are read three times."""
    regions = staged_numbers(keyed_like(regions, lines), "regions")
    missed = in_leaves(lines, regions, "left").filter("rid is null").drop("rid", "region_type")
    return outside_images(missed, regions)


def banded(lines: DataFrame, group: tuple[str, ...]) -> DataFrame:
    """Adds `band`: a new one begins where y falls by more than BAND from one line to the next."""
    w = W.partitionBy(*group).orderBy(F.desc("y"), "line_no")
    gap = F.coalesce(F.lag("y").over(w) - F.col("y") > BAND, F.lit(False))
    return lines.withColumn("_gap", gap.cast("int")).withColumn("band", F.sum("_gap").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_gap")


def reading_order(lines: DataFrame, group: tuple[str, ...] = PAGE) -> DataFrame:
    """Adds `position` from 1: from top to bottom by bands, from left to right within one."""
    return banded(lines, group).withColumn("position", F.row_number().over(W.partitionBy(*group).orderBy("band", "x", "line_no")))


def merged_blocks(matched: DataFrame) -> DataFrame:
    """One block per region that holds lines: texts joined in reading order, box around them, mean font size."""
    group = (*PAGE, "rid")
    rows = banded(matched, group).groupBy(*group).agg(
        F.sort_array(F.collect_list(F.struct("band", "x", "line_no", "text", "font_name"))).alias("s"),
        F.min("x").alias("x"),
        F.min("y").alias("y"),
        F.max(F.col("x") + F.col("w")).alias("_r"),
        F.max(F.col("y") + F.col("h")).alias("_t"),
        (F.sum("font_size") / F.count("*")).alias("font_size"),
        F.first("region_type").alias("block_type"),
        F.count("*").alias("n_lines"),
    )
    return rows.select(*group, "x", "y", (F.col("_r") - F.col("x")).alias("w"), (F.col("_t") - F.col("y")).alias("h"), F.array_join(F.transform("s", lambda v: v["text"]), " ").alias("text"), "font_size", F.col("s")[0]["font_name"].alias("font_name"), "block_type", "n_lines")


def layout_blocks(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """Merged, unmatched and image blocks of each page, numbered from 1: by region, then by line, then by image region.

    Lines of pages without regions pass through. One outer join against the leaf regions feeds
    both the merged and the unmatched blocks; it and the regions are written once, as each is
    read several times. Where the lines call for more tasks than the session has, all three parts
    are dealt by page alike, so blocks are numbered where they lie.
    """
    regions = staged_numbers(keyed_like(regions, lines), "regions")
    joined = staged(in_leaves(lines, regions, "left"), "matched")
    tasks = tasks_for(joined)
    joined, regions = (parted(df, tasks, *PAGE) for df in (joined, regions))
    columns = [*PAGE, "x", "y", "w", "h", "text", "font_size", "font_name", "block_type"]
    part = lambda df, origin, rank, order: df.select(*columns, F.lit(origin).alias("origin"), F.lit(rank).alias("_o"), F.col(order).cast("int").alias("_k"))
    merged = part(merged_blocks(joined.filter("rid is not null")), "region", 0, "rid")
    loose = part(outside_images(joined.filter("rid is null"), regions), "unmatched", 1, "line_no")
    images = regions.filter(~is_textual(F.col("block_type"))).withColumns({"text": F.lit(""), "font_size": F.greatest(F.col("h") * 0.75, F.lit(1.0)), "font_name": F.lit("")})
    every = merged.unionByName(loose).unionByName(part(images, "image", 2, "rid"))
    return every.withColumn("block_no", F.row_number().over(W.partitionBy(*PAGE).orderBy("_o", "_k"))).drop("_o", "_k")
