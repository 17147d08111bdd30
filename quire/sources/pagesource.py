"""Pages as a Python data source, with planned partitions and filters that cut them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

COMPARED = {EqualTo: "==", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


@dataclass
class Groups(InputPartition):
    """Row groups of one file."""

    path: str
    numbers: list[int]


class PageReader(DataSourceReader):
    """Plans a partition for some row groups of a file; filters on page_id drop row groups by their statistics."""

    def __init__(self, path: str, schema: pa.Schema, per_partition: int):
        self.path, self.schema, self.per_partition = path, schema, per_partition
        self.wanted: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes comparisons of page_id with a value; Spark applies all others itself."""
        for f in filters:
            mine = getattr(f, "attribute", None) == ("page_id",)
            if mine and type(f) in COMPARED and f.value is not None:
                self.wanted.append(("page_id", COMPARED[type(f)], f.value))
            elif mine and isinstance(f, In) and all(v is not None for v in f.value):
                self.wanted.append(("page_id", "in", list(f.value)))
            else:
                yield f

    def expression(self) -> pc.Expression | None:
        out = None
        for name, op, value in self.wanted:
            field = ds.field(name)
            e = {"==": field == value, ">": field > value, ">=": field >= value, "<": field < value, "<=": field <= value}[op] if op != "in" else field.isin(value)
            out = e if out is None else out & e
        return out

    def partitions(self) -> list[Groups]:
        keep = self.expression()
        found = []
        files, top = fs.FileSystem.from_uri(self.path)
        for fragment in ds.dataset(top, format="parquet", filesystem=files).get_fragments(keep):
            numbers = [g.id for part in fragment.split_by_row_group(keep) for g in part.row_groups]
            found += [Groups(fragment.path, numbers[i : i + self.per_partition]) for i in range(0, len(numbers), self.per_partition)]
        return found or [Groups("", [])]

    def read(self, partition: Groups) -> Iterator[pa.RecordBatch]:
        if not partition.numbers:
            return
        files, _ = fs.FileSystem.from_uri(self.path)
        fragment = ds.ParquetFileFormat().make_fragment(partition.path, files, row_groups=partition.numbers)
        yield from fragment.to_batches(schema=self.schema, columns=self.schema.names, filter=self.expression(), batch_size=1000)


class PageSource(DataSource):
    """`quire_pages`: options path (a folder or file that all executors reach) and groups (row groups a partition, 1)."""

    @classmethod
    def name(cls) -> str:
        return "quire_pages"

    def schema(self) -> str:
        return "page_id long, url string, html string"

    def reader(self, schema) -> PageReader:
        fields = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())])
        return PageReader(self.options["path"], fields, int(self.options.get("groups", 1)))


def registered(spark: SparkSession) -> SparkSession:
    """Makes spark.read.format("quire_pages") known, with its filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageSource)
    return spark
