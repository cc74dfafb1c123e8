"""Tables that are read in parts by whoever wants them: a protocol, sources, and Spark's own Python data source over them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import workers

BATCH_ROWS = 64_000


def open_uri(uri: str):
    """(file system, path) of pyarrow for a Hadoop path; fsspec serves schemes that pyarrow doesn't know."""
    from pyarrow import fs

    scheme, _, rest = uri.partition("://")
    if scheme in ("s3a", "s3n"):
        uri = f"s3://{rest}"
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = uri.removeprefix("file:")
    try:
        return fs.FileSystem.from_uri(uri)
    except ValueError:  # an unknown scheme
        import fsspec

        return fs.PyFileSystem(fs.FSSpecHandler(fsspec.filesystem(scheme))), rest


class PartitionedSource(Protocol):
    """What a source has to offer: its columns, how many parts there are, and the record batches of a part."""

    def ddl(self) -> str: ...

    def partition_count(self) -> int: ...

    def read(self, partition: int, batch_rows: int = BATCH_ROWS) -> Iterator: ...


class ParquetSource:
    """The row groups of Parquet files, each a part. Only the footers are read to list them."""

    def __init__(self, files: list[str], columns: list[str] | None = None):
        import pyarrow.parquet as pq

        self.columns, self.groups, self.fields = columns, [], None
        for uri in sorted(files):
            system, path = open_uri(uri)
            with system.open_input_file(path) as f:
                pf = pq.ParquetFile(f)
                self.fields = self.fields or pf.schema_arrow
                self.groups += [(uri, i) for i in range(pf.num_row_groups)]

    def ddl(self) -> str:
        from pyspark.sql.pandas.types import from_arrow_schema

        if self.fields is None:
            raise FileNotFoundError("no Parquet files")
        fields = {f.name: f for f in from_arrow_schema(self.fields).fields}
        return ", ".join(f"`{c}` {fields[c].dataType.simpleString()}" for c in self.columns or fields)

    def partition_count(self) -> int:
        return len(self.groups)

    def read(self, partition: int, batch_rows: int = BATCH_ROWS) -> Iterator:
        import pyarrow.parquet as pq

        uri, i = self.groups[partition]
        system, path = open_uri(uri)
        with system.open_input_file(path) as f:
            yield from pq.ParquetFile(f).iter_batches(batch_rows, row_groups=[i], columns=self.columns)


class _Part(InputPartition):
    def __init__(self, index: int):
        super().__init__(index)


@dataclass
class _Reader(DataSourceReader):
    source: Any
    batch_rows: int

    def partitions(self):
        return [_Part(i) for i in range(self.source.partition_count())]

    def read(self, partition):
        if partition is not None:
            yield from self.source.read(partition.value, self.batch_rows)


def read_source(spark: SparkSession, source: PartitionedSource, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """A DataFrame over any partitioned source; a task per part, Arrow batches all the way. No part gives an empty table."""
    workers(spark)
    ddl = source.ddl()
    if not source.partition_count():
        return spark.createDataFrame([], ddl)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return "sparsequery"

        def schema(self):
            return ddl

        def reader(self, schema):
            return _Reader(source, batch_rows)

    spark.dataSource.register(Source)
    return spark.read.format("sparsequery").load()


def read_parts(spark: SparkSession, table: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A stored table read row group by row group through :class:`ParquetSource`."""
    return read_source(spark, ParquetSource(table.inputFiles(), columns))
