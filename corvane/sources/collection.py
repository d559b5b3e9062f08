"""Stored collections as a data source of their own: ``spark.read.format("corvane_collection")``."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

NAME = "corvane_collection"


@dataclass
class File(InputPartition):
    """One file of a collection, which one task reads."""

    path: str


class Reader(DataSourceReader):
    def __init__(self, path: str, columns: list[str]) -> None:
        self.path, self.columns = path, columns

    def partitions(self) -> Sequence[InputPartition]:
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(self.path)
        found = system.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
        return [File(f.path) for f in found if f.is_file and f.base_name.endswith(".parquet")]

    def read(self, partition: File | None) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyarrow import parquet as pq

        if partition is None:
            # A collection without files still has one task.
            return
        system, _ = fs.FileSystem.from_uri(self.path)
        with system.open_input_file(partition.path) as data:
            yield from pq.ParquetFile(data).iter_batches(columns=self.columns)


class Collection(DataSource):
    """The option ``path`` is the folder of the collection, the schema is given by the reader; a missing folder has no rows."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(self.options["path"], schema.fieldNames())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Collection)
