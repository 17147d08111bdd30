"""Page results that arrive as files, gathered by a stream that may stop and go on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def gather(spark: SparkSession, folder: str, schema: str, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files: int = 100, pattern: str | None = None) -> StreamingQuery:
    """Starts a stream over Parquet files: `work` on each batch's rows, its result a partition `batch` of `out`.

    The checkpoint knows which files a batch took, so a stream that ends anywhere and is started
    again takes up that batch with the same files and the same number; its partition is
    overwritten, so no row is there twice and none is lost. It takes all files that are there,
    at most `files` a batch, and ends.
    """

    def keep(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    if pattern:
        source = source.option("pathGlobFilter", pattern)
    return source.parquet(folder).writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def gathered(spark: SparkSession, out: str) -> DataFrame:
    """All results so far, without the batch numbers."""
    return spark.read.parquet(out).drop("batch")


def classified(pages: DataFrame) -> DataFrame:
    """A page's result: the length of its text without markup, and whether that makes it a native page."""
    text = F.trim(F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]*>", ""))
    return pages.select("page_id", F.length(text).cast("long").alias("chars"), F.when(F.length(text) >= 20, "native").otherwise("scanned").alias("page_type"))
