"""What Python workers need, and tables in the folder that driver and executors share."""

from __future__ import annotations

import math
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of a batch that goes to a Python worker; Spark's own default is eight times that, which JVM and worker both hold.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"


def shipped(spark: SparkSession) -> SparkSession:
    """Makes the package importable in Python workers, once for each application.

    Batches for workers are made smaller unless the application has set their size itself.
    """
    context = spark.sparkContext
    if not context.getConf().contains(BATCH_SETTING):
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    if not getattr(context, "_quire_shipped", False):
        top = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="quire-")) / "quire.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(top.rglob("*.py")):
                z.write(f, f"{top.name}/{f.relative_to(top)}")
        context.addPyFile(str(path))
        context._quire_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's checkpoint folder.

    Only a session on one machine (a local master) may have neither; it gets a temporary folder,
    remembered in the session. Elsewhere that would lose tables, so it is an error.
    """
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("quire.shared.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        place = tempfile.mkdtemp(prefix="quire-")
        spark.conf.set("quire.shared.dir", place)
    return place.rstrip("/")


def _hadoop_path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/quire/{uuid.uuid4().hex}-{name}"
    target, files = _hadoop_path(spark, path)
    files.deleteOnExit(target)
    return path


def merged(df: DataFrame) -> DataFrame:
    """df as a side of a join that is to be merged, never broadcast.

    Tables of numbers take so few bytes in files that Spark holds millions of rows for small;
    broadcast, they pass through the driver and lie in each executor at many times that size.
    """
    return df.hint("merge")


#: Bytes of rows that one task of a shuffle is to get, and what a row takes beside its text.
TASK_BYTES, ROW_BYTES = 48 << 20, 160


def tasks_for(rows: DataFrame, text: str = "text") -> int:
    """How many partitions the rows' bytes call for, or 0 where the session's own number is enough.

    Adaptive execution joins small partitions but adds none, so a task's share of a shuffle into
    a fixed number grows with the input. This reads the texts once.
    """
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    tasks = math.ceil((size + n * ROW_BYTES) / TASK_BYTES)
    return tasks if tasks > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else 0


def parted(df: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """df dealt by its keys to as many partitions as tasks_for gave; for 0 it is left to the session."""
    return df.repartition(tasks, *keys) if tasks else df


def staged(df: DataFrame, name: str, file_rows: int = 0) -> DataFrame:
    """df as a Parquet table in the shared folder, with at most `file_rows` rows in a file (0: any number).

    This cuts the lineage: lost executors cost at most the reading of the table, and
    generated row ids stay what they were.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.mode("overwrite").option("maxRecordsPerFile", file_rows).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    spark.sparkContext.__dict__.setdefault("_quire_staged", set()).add(path)
    return out


#: Rows in a file of a table of numbers.
FILE_ROWS = 50_000


def staged_numbers(df: DataFrame, name: str) -> DataFrame:
    """staged for a table of numbers, which is to be shuffled.

    Tasks are as many as the files' bytes call for, and numbers take so few of them that a task's
    rows, which a shuffle into over 200 partitions holds, grow with the input. A file counts as
    spark.sql.files.openCostInBytes at least, so with few rows in each the tasks follow the rows.
    """
    return staged(df, name, FILE_ROWS)


def dropped(*tables: DataFrame) -> None:
    """Removes staged tables that nothing reads any more; frames that aren't staged themselves are left alone."""
    for t in tables:
        if path := getattr(t, "_staged_at", None):
            target, files = _hadoop_path(t.sparkSession, path)
            files.delete(target, True)
            t.sparkSession.sparkContext.__dict__.get("_quire_staged", set()).discard(path)


def released(spark: SparkSession) -> int:
    """Removes all tables staged so far that are still there; how many.

    Frames built before can't be read any more: for long sessions, between one query's result
    and the next query. Without it they stay until the application ends.
    """
    held = spark.sparkContext.__dict__.get("_quire_staged", set())
    for path in held:
        target, files = _hadoop_path(spark, path)
        files.delete(target, True)
    n = len(held)
    held.clear()
    return n
