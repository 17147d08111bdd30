"""A table of jobs in files that outlives the session: updates rewrite only the partitions that they touch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import dropped, staged

#: Jobs of neighbouring numbers in one partition; new jobs touch the last ones only.
SPAN = 10_000


class JobStore:
    """Jobs by `key`, a number, in a folder partitioned by spans of it.

    A read sees Parquet files alone, and a filter on the span prunes partitions. An update joins
    the changes with their own partitions and overwrites those dynamically; all other files stay
    as they are. Each partition is replaced by renames at the end of the job, so a failed or
    repeated task leaves the old rows; writers must not overlap.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "id", span: int = SPAN):
        self.spark, self.path, self.key, self.span = spark, path, key, span

    def _spanned(self, jobs: DataFrame) -> DataFrame:
        return jobs.withColumn("span", F.floor(F.col(self.key) / self.span).cast("long"))

    def _write(self, rows: DataFrame) -> None:
        rows.repartition("span").write.partitionBy("span").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.path)

    def create(self, jobs: DataFrame) -> None:
        """Writes the first jobs; partitions that exist already are replaced."""
        self._write(self._spanned(jobs))

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("span")

    def _before(self, spans: list[int]) -> DataFrame:
        """The rows of some partitions, with their span."""
        wanted = [F.col("span").isin(spans[i : i + 500]) for i in range(0, len(spans), 500)]
        return self.spark.read.parquet(self.path).filter(reduce(lambda a, b: a | b, wanted)).withColumn("span", F.col("span").cast("long"))

    def remove(self, keys: DataFrame) -> None:
        """Drops the jobs of these keys; partitions without any of them stay as they are, and one left empty is emptied."""
        rows = staged(self._spanned(keys.select(self.key).dropna().distinct()), "job-removals")
        spans = [r["span"] for r in rows.select("span").distinct().collect()]
        if spans:
            left = staged(self._before(spans).join(rows.select(self.key), self.key, "left_anti"), "jobs")
            self._write(left)
            held = {r["span"] for r in left.select("span").distinct().collect()}
            for span in spans:
                if span not in held:  # a dynamic overwrite leaves partitions without rows alone
                    self.spark.createDataFrame([], left.drop("span").schema).write.mode("overwrite").parquet(f"{self.path}/span={span}")
            dropped(left)
        dropped(rows)

    def update(self, changes: DataFrame) -> None:
        """Replaces jobs by the changes' rows of the same key, and adds the others.

        Changes have the table's columns; of changes to one key one wins, the greatest row. A
        null key is refused. No changes write nothing.
        """
        rows = staged(self._spanned(changes), "job-changes")
        if rows.filter(F.col(self.key).isNull()).limit(1).count():
            raise ValueError(f"a change without {self.key}")
        spans = [r["span"] for r in rows.select("span").distinct().collect()]  # a row a partition touched
        if spans:
            names = [c for c in self.read().columns]
            rest = [c for c in names if c != self.key]
            last = rows.groupBy("span", self.key).agg(F.max(F.struct(*rest)).alias("_r")).select("span", self.key, "_r.*")
            kept = self._before(spans).join(last.select(self.key), self.key, "left_anti")
            merged = staged(kept.select("span", *names).unionByName(last.select("span", *names)), "jobs")
            self._write(merged)
            dropped(merged)
        dropped(rows)
