"""What the operators of this subpackage share: word pattern, null handling, shared tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import dropped, shared_dir, shared_path, shipped, staged  # noqa: F401

#: Words are runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Longest slice; slices clip to the array.
ALL = 2_000_000_000


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def n_words(text: Column) -> Column:
    """Number of words as long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def word_chars(text: Column) -> Column:
    """Code points outside ASCII white space; 0 for null."""
    return F.coalesce(F.length(F.regexp_replace(text, SPACE, "")), F.lit(0)).cast("long")


def column(df: DataFrame, name: str, kind: str) -> Column:
    """df's column, or nulls of that type where a table lacks it."""
    return F.col(f"`{name}`").cast(kind) if name in df.columns else F.lit(None).cast(kind)


def replaced(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that an operator is about to add under the same names."""
    return df.drop(*[n for n in names if n in df.columns])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
