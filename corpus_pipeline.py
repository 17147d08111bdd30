"""From raw documents to packed training windows, in five stages.

All stages but the last return the columns that they got, whatever their names: what operators
add is kept apart from them. Rows may repeat, and any column may be null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import dropped, read, staged
from quire.llm.mixing import mix, repeated
from quire.llm.neardup import kept_documents
from quire.llm.packing import WEIGHTS, pack
from quire.llm.quality import quality
from quire.llm.secrets import redacted, scan


def _apart(docs: DataFrame) -> DataFrame:
    """The columns that operators read, and all but the text once more in `_doc`, so that no operator's column replaces one."""
    needed = [F.col(f"`{c}`") for c in ("doc_id", "source", "text") if c in docs.columns]
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(*needed, F.struct(*rest, F.lit(True).alias("_row")).alias("_doc"))


def _together(rows: DataFrame, names: list[str], text: Column) -> DataFrame:
    """The columns of the stage's input, with a new text and, where there is one, its n_chars."""
    rows = rows.select(text.alias("_new"), "_doc")  # first, lest `text` below mean the new one
    n_chars = F.length("_new").cast("long")
    return rows.select(*[(F.col("_new") if c == "text" else n_chars if c == "n_chars" else F.col(f"_doc.`{c}`")).alias(c) for c in names])


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: rejected documents go, and the others lose their failed lines.

    Null and empty texts are rejected as too short; repeated rows are judged alike.
    """
    # a row number can't be computed twice, so the verdict isn't either: the filter stays above it
    judged = quality(_apart(docs)).withColumn("_at", F.monotonically_increasing_id())
    return _together(judged.filter("kept and _at >= 0"), docs.columns, F.col("cleaned"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near duplicates at a similarity of 0.8: each group keeps the row of its smallest doc_id.

    Rows are compared by their texts, so those that share a doc_id or have none lose nothing but
    copies. Null and empty texts stay.
    """
    return kept_documents(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets: every place found becomes a marker, but for widely copied values that read like placeholders. All rows stay; null texts stay null."""
    return _together(scan(_apart(docs)), docs.columns, redacted(F.col("text"), F.col("secrets")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents as often as the mixture uses them.

    Texts without words (null and empty ones too) add nothing to it and go; a null source is one of its own.
    """
    return _together(repeated(mix(_apart(docs)), ["text", "_doc"]), docs.columns, F.col("text"))


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Full windows of the sources in target proportions: a row per piece. Null and empty texts have only the end token."""
    return pack(docs, targets=WEIGHTS).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [("quality", clean), ("near_duplicates", deduplicate), ("secrets", redact), ("mixing", mixture), ("packing", windows)]

#: Neither groups of near duplicates nor token windows can be expressed in SQL; tests compare each stage with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over whole `documents`, each written and read again; a table is removed once the next is written."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        after = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        dropped(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
