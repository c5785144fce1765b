"""`spark.read.format("strata")`: a container's members, and its arrays of all kinds, by path. Tables of the index: ProjectReader.tables().

Options: path; table ("members"); or array (a member's name) and kind. Arrays are split by row group.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from .container import Reader
from .kinds import KINDS, Array, variant_of

_WIDE = {pa.uint32(): pa.int64(), pa.uint8(): pa.int32(), pa.float32(): pa.float64()}


def _wide(t: pa.DataType) -> pa.DataType:
    return pa.struct([pa.field(f.name, _wide(f.type)) for f in t]) if pa.types.is_struct(t) else _WIDE.get(t, t)


_MEMBERS = "name string, offset long, size long"


class ContainerSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "strata"

    def schema(self) -> str | StructType:
        if "array" in self.options:
            kind = self.options["kind"]
            columns = KINDS[kind][variant_of(kind, _Array(self.options)._open())]
            return from_arrow_schema(pa.schema([pa.field("pos", pa.int64()), *(pa.field(f.name, _wide(f.type)) for f in columns)]))
        if self.options.get("table", "members") == "members":
            return _MEMBERS
        raise ValueError("other tables of the index: ProjectReader.tables()")

    def reader(self, schema) -> DataSourceReader:
        return _Members(self.options) if "array" not in self.options else _Array(self.options)


class _Members(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]

    def read(self, partition) -> Iterator[tuple]:
        for m in Reader(self.path).members.values():
            yield m.name, m.offset, m.size


class _Array(DataSourceReader):
    def __init__(self, options):
        self.path, self.kind, self.member = options["path"], options["kind"], options["array"]

    def _open(self):
        return Reader(self.path).parquet(Array(self.kind, self.member, 0))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(self._open().metadata.num_row_groups)] or [InputPartition(-1)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value < 0:
            return
        file = self._open()
        at = sum(file.metadata.row_group(i).num_rows for i in range(partition.value))
        for batch in file.iter_batches(row_groups=[partition.value]):
            columns = [c.cast(_wide(c.type)) for c in batch.columns]
            names = [f.name for f in next(iter(KINDS[self.kind].values()))]
            yield pa.RecordBatch.from_arrays([pa.array(range(at, at + batch.num_rows), pa.int64()), *columns], names=["pos", *names])
            at += batch.num_rows


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ContainerSource)
