"""Whole projects: writing with checks, reading with checks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .arrays import array_problems, read_array, write_array
from .catalog import Problem, Use, ValidationFailed, check_tree, limited, tables
from .container import Limits, Reader, Writer
from .kinds import KINDS, Array


class ProjectWriter:
    """Builds a container. Arrays are given as DataFrames with pos or as short sequences of rows; finish() checks everything and either
    writes the index or fails and deletes the file."""

    def __init__(self, spark: SparkSession, path: str, compression: int = 6, **options):
        self.spark = spark
        self.file = Writer(path, compression, **options)
        self._frames: dict[str, DataFrame] = {}  # arrays given as DataFrames, and
        self._rows: dict[str, pa.Table] = {}  # as rows, by member

    def array(self, kind: str, variant: str, data: DataFrame | Sequence) -> dict:
        """Writes an array and gives the pointer to put in the tree."""
        if isinstance(data, DataFrame):
            got = write_array(self.file, kind, variant, data)
            self._frames[got.filename] = data
        else:
            schema = KINDS[kind][variant]
            rows = [r if isinstance(r, (tuple, list)) and len(schema) > 1 else (r,) for r in data]
            fields = {f.name: [self._value(r[i], f.type) for r in rows] for i, f in enumerate(schema)}
            table = pa.table({f.name: pa.array(fields[f.name], f.type) for f in schema}, schema=schema)
            got = self.file.batches(kind, variant, table.to_batches())
            self._rows[got.filename] = table
        return got.to_json()

    @staticmethod
    def _value(v, type_: pa.DataType):
        if pa.types.is_struct(type_) and v is not None:
            return dict(zip((type_.field(i).name for i in range(type_.num_fields)), v, strict=True))
        return v

    def image(self, data: bytes) -> dict:
        return self.file.image(data).to_json()

    def _frame(self, filename: str) -> DataFrame:
        return self._frames[filename] if filename in self._frames else _frame_of(self.spark, self._rows[filename])

    def problems(self, project: dict, compat: bool = False) -> list[Problem]:
        problems, uses = check_tree(project, self.file.names, compat)
        for use in uses:
            if use.array.filename in {**self._frames, **self._rows} and _checked(use):
                problems += array_problems(self._frame(use.array.filename), use, Limits().validation)
        return problems

    def finish(self, project: dict) -> list[Problem]:
        """Warnings. Errors raise ValidationFailed, and nothing is left of the file."""
        problems = self.problems(project)
        if any(not p.warning for p in problems):
            self.cancel()
            raise ValidationFailed(problems)
        self.file.close(project)
        return problems

    def cancel(self) -> None:
        self.file.cancel()


def _frame_of(spark: SparkSession, table: pa.Table) -> DataFrame:
    wide = []
    for f in table.schema:
        t = pa.int64() if f.type == pa.uint32() else pa.int16() if f.type == pa.uint8() else f.type
        wide.append(table.column(f.name).cast(t) if t != f.type else table.column(f.name))
    pos = pa.array(range(table.num_rows), pa.int64())
    keep = [(n, c) for n, c in zip(table.schema.names, wide, strict=True) if not pa.types.is_struct(c.type)]
    return spark.createDataFrame(pa.table({"pos": pos} | dict(keep)))


def _checked(use) -> bool:
    return use.array.kind in ("Segment", "Triangle", "Index", "Boundary", "RegularSubblock", "FreeformSubblock") or bool(use.bounds.get("above_zero"))


class ProjectReader:
    """Opens a container: the index is read and its structure checked; arrays are read on demand."""

    def __init__(self, spark: SparkSession, path: str, limits: Limits | None = None):
        self.spark, self.file = spark, Reader(path, limits)
        self.project = self.file.index()
        problems, self._uses = check_tree(self.project, set(self.file.members))
        if any(not p.warning for p in problems):
            raise ValidationFailed(limited(problems, self.file.limits.validation))
        self.warnings = limited(problems, self.file.limits.validation)
        self._by_member: dict[str, list[Use]] = {}
        for u in self._uses:
            self._by_member.setdefault(u.array.filename, []).append(u)

    def tables(self) -> dict[str, DataFrame]:
        return tables(self.spark, self.project)

    def pointer(self, a: dict) -> Array:
        return self._by_member[a["filename"]][0].array

    def array(self, a: dict, check: bool = True) -> DataFrame:
        """pos and the values of an array, by its pointer in the tree. Reading a row that breaks a rule of one of the array's uses fails, unless
        check is False; problems() tells them all."""
        return read_array(self.spark, self.file, self.pointer(a), uses=self._by_member[a["filename"]] if check else ())

    def variant(self, a: dict) -> str:
        return self.file.variant(self.pointer(a))

    def image(self, a: dict) -> bytes:
        from .images import check_limits

        data = self.file.bytes(a["filename"])
        check_limits(data, self.file.limits)
        return data

    def pixels(self, a: dict) -> np.ndarray:
        """A PNG image, decoded: height x width x channels."""
        from .images import decode_png

        return decode_png(self.image(a))

    def problems(self) -> list[Problem]:
        """All that is wrong in the arrays."""
        out: list[Problem] = []
        for use in self._uses:
            if _checked(use):
                out += array_problems(read_array(self.spark, self.file, use.array), use, self.file.limits.validation)
        return limited(out, self.file.limits.validation)
