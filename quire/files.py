"""The whole page plan over files: read, lay out, translate, overlay, write."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import is_formula, translated_name
from quire.operators import layout, overlay, pages, segments
from quire.operators.layout import PAGE
from quire.session import dropped, shipped, staged
from quire.sinks import pdf as sink
from quire.sources.pdf import parsed
from quire.sources.providers import Model, translated_pages

STRIPS = "doc_id long, page int, seg_no int, is_diagram boolean, render_low double, render_high double, out_low double, delta double, total_height double, formulas array<struct<y:double,h:double>>"
REGIONS = "doc_id long, page int, rid int, x double, y double, w double, h double, block_type string"


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, path, content) of the files under a path; doc_id is a hash of the path."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.select(F.xxhash64("path").alias("doc_id"), "path", "content")


def laid(blocks: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks with seg_no and delta, strips) of translated blocks on pages of the sizes given (doc_id, page, height).

    Strips are cut to their page, so pages are laid out height by height; a collection has few heights.
    """
    parts = []
    for r in sizes.select("height").distinct().collect():
        here = blocks.join(sizes.filter(F.col("height") == r["height"]).select(*PAGE), list(PAGE), "left_semi")
        cut = segments.segments(here, r["height"])
        put = segments.assigned(here, cut)
        strips = segments.laid_out(segments.refined(cut, put, r["height"]), r["height"])
        parts.append((put, strips))
    both = [reduce(DataFrame.unionByName, x) for x in zip(*parts)]
    strips = staged(both[1], "strips")
    return both[0].join(strips.select(*PAGE, "seg_no", "delta"), [*PAGE, "seg_no"]), strips


def translated_files(spark: SparkSession, path: str, model: Model, source: str = "auto", target: str = "de", regions: DataFrame | None = None, recognised: DataFrame | None = None) -> DataFrame:
    """path, total_pages, pdf, error: each PDF under a path with its text translated in place; one that fails has an error and no pdf.

    Native pages give their own lines; scanned ones take theirs from `recognised` (doc_id, page,
    line_no, x, y, w, h, text, font_size, font_name), and without any they stay as they are.
    `regions` (REGIONS) are a layout analyser's; lines outside all regions are blocks of their own.
    doc_id is xxhash64 of the file's path, and pages count from 1. A page whose translation or
    output fails makes its file fail, with the first such page's error; others go on. Pages are
    read, translated and written as rows; a file's pages meet only where they are put together.
    """
    shipped(spark)
    files = documents(spark, path)
    read = staged(parsed(files.select("path", "content")).withColumn("doc_id", F.xxhash64("path")), "read-pages")
    good = read.filter("page_num is not null").withColumn("page", F.col("page_num"))
    kinds = pages.classify(good).select(*PAGE, "page_type")
    spans = good.select(*PAGE, F.inline("spans")).withColumnRenamed("font_size", "raw_font_size")
    lines = pages.native_lines(spans).join(kinds.filter("page_type = 'native'").select(*PAGE), list(PAGE), "left_semi")
    if recognised is not None:
        lines = lines.unionByName(recognised.join(kinds.filter("page_type = 'scanned'").select(*PAGE), list(PAGE), "left_semi").select(*lines.columns))
    lines = lines.withColumn("block_type", F.when(F.col("font_size") > 16, "title").otherwise("text"))
    # layout reads the lines twice, and a recogniser's are dear
    lines = staged(lines, "page-lines")
    regions = regions if regions is not None else spark.createDataFrame([], REGIONS)
    blocks = staged(translated_pages(layout.layout_blocks(lines, regions), model, source, target), "translated-blocks")
    sizes = good.select(*PAGE, "height")
    failed = blocks.filter("error is not null").groupBy("doc_id").agg(F.min(F.struct("page", "error")).alias("f")).select("doc_id", F.format_string("page %d: %s", "f.page", "f.error").alias("failed"))
    every = good.select(*PAGE).join(failed, "doc_id", "left_anti")
    if blocks.isEmpty():
        strips = spark.createDataFrame([], STRIPS)
        overlays = spark.createDataFrame([], "doc_id long, page int, content binary")
    else:
        placed, strips = laid(blocks.withColumn("translated", F.coalesce("translated", F.lit(""))), sizes)
        shown = overlay.shown(placed)
        overlays = sink.content_streams(overlay.cover_rects(shown), overlay.overlay_lines(shown))
        formulas = placed.filter(is_formula(F.coalesce("text", F.lit("")))).groupBy(*PAGE, "seg_no").agg(F.collect_list(F.struct("y", "h")).alias("formulas"))
        strips = strips.join(formulas, [*PAGE, "seg_no"], "left").join(every, list(PAGE), "left_semi")
    originals = files.select("doc_id", F.col("content").alias("pdf")).join(good.select("doc_id").distinct(), "doc_id", "left_semi").join(failed, "doc_id", "left_anti")
    out = staged(sink.output_pages(originals, strips, every.join(overlays, list(PAGE), "left")), "output-pages")
    bad = out.filter("error is not null").groupBy("doc_id").agg(F.min(F.struct("page", "error")).alias("f")).select("doc_id", F.format_string("page %d: %s", "f.page", "f.error").alias("broken"))
    whole = sink.merged_files(out.join(bad, "doc_id", "left_anti"))
    names = read.groupBy("doc_id", "path").agg(F.max("total_pages").alias("total_pages"), F.min("error").alias("unread"))
    rows = names.join(failed, "doc_id", "left").join(bad, "doc_id", "left").join(whole.select("doc_id", F.col("total_pages").alias("_n"), "pdf"), "doc_id", "left")
    short = F.when(~F.col("total_pages").eqNullSafe(F.col("_n")), F.format_string("%d of %d pages are complete", F.coalesce("_n", F.lit(0)), F.coalesce("total_pages", F.lit(0))))
    error = F.coalesce("failed", "broken", F.when(F.col("total_pages").isNull(), F.col("unread")), short)
    result = staged(rows.select("path", "total_pages", F.when(error.isNull(), F.col("pdf")).alias("pdf"), error.alias("error")), "translated-files")
    dropped(read, lines, blocks, out)
    return result


def written_files(results: DataFrame, folder: str) -> DataFrame:
    """Writes translated files to a folder that all executors reach, as base_translated.ext; returns path, output and error.

    Each file is written under another name first and renamed, so a repeated task leaves a whole file.
    """
    shipped(results.sparkSession)
    name = translated_name(F.regexp_extract("path", "([^/]*)$", 1))
    rows = results.select("path", name.alias("name"), "pdf", "error")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, top = fs.FileSystem.from_uri(folder)
        place.create_dir(top, recursive=True)
        for b in batches:
            for i in range(b.num_rows):
                path, name_, data, error = (c[i].as_py() for c in b.columns)
                out = None
                if data is not None:
                    out = f"{top}/{name_}"
                    with place.open_output_stream(f"{out}.part") as f:
                        f.write(data)
                    place.move(f"{out}.part", out)
                yield pa.RecordBatch.from_pylist([{"path": path, "output": out, "error": error}], pa.schema([("path", pa.string()), ("output", pa.string()), ("error", pa.string())]))

    return staged(rows.mapInArrow(write, "path string, output string, error string"), "written-files")
