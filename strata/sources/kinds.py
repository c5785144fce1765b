"""The closed set of array kinds: their exact Parquet schemas, and which variant a file is."""

from __future__ import annotations

import io
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import pyarrow.parquet as pq


def _required(*names: str, of: pa.DataType) -> list[pa.Field]:
    return [pa.field(n, of, nullable=False) for n in names]


def _optional(name: str, of: pa.DataType) -> list[pa.Field]:
    return [pa.field(name, of, nullable=True)]


F32, F64, I64, U32, U8 = pa.float32(), pa.float64(), pa.int64(), pa.uint32(), pa.uint8()
_DATE, _TIME = pa.date32(), pa.timestamp("us", tz="UTC")
_NUMBERS = {"F32": F32, "F64": F64, "I64": I64, "Date": _DATE, "DateTime": _TIME}
_PARENTS = [f"parent_{a}" for a in "uvw"]
CORNERS = [f"corner_{m}_{a}" for m in ("min", "max") for a in "uvw"]

# Names and types of the columns of each kind's variants.
KINDS: dict[str, dict[str, pa.Schema]] = {
    "Scalar": {k: pa.schema(_required("scalar", of=t)) for k, t in (("F32", F32), ("F64", F64))},
    "Vertex": {k: pa.schema(_required("x", "y", "z", of=t)) for k, t in (("F32", F32), ("F64", F64))},
    "Segment": {"U32": pa.schema(_required("a", "b", of=U32))},
    "Triangle": {"U32": pa.schema(_required("a", "b", "c", of=U32))},
    "Name": {"String": pa.schema(_required("name", of=pa.string()))},
    "Gradient": {"Rgba8": pa.schema(_required("r", "g", "b", "a", of=U8))},
    "Texcoord": {k: pa.schema(_required("u", "v", of=t)) for k, t in (("F32", F32), ("F64", F64))},
    "Boundary": {k: pa.schema(_required("value", of=t) + _required("inclusive", of=pa.bool_())) for k, t in _NUMBERS.items()},
    "RegularSubblock": {"U32U32": pa.schema(_required(*_PARENTS, *CORNERS, of=U32))},
    "FreeformSubblock": {f"U32{k}": pa.schema(_required(*_PARENTS, of=U32) + _required(*CORNERS, of=t)) for k, t in (("F32", F32), ("F64", F64))},
    "Number": {k: pa.schema(_optional("number", t)) for k, t in _NUMBERS.items()},
    "Index": {"U32": pa.schema(_optional("index", U32))},
    "Vector": {f"{k}x{n}": pa.schema(_optional("vector", pa.struct(_required(*"xyz"[:n], of=t)))) for n in (2, 3) for k, t in (("F32", F32), ("F64", F64))},
    "Text": {"Text": pa.schema(_optional("text", pa.string()))},
    "Boolean": {"Boolean": pa.schema(_optional("bool", pa.bool_()))},
    "Color": {"Rgba8": pa.schema(_optional("color", pa.struct(_required("r", "g", "b", "a", of=U8))))},
}


class SchemaMismatch(ValueError):
    def __init__(self, kind: str, found: str):
        expected = "\n".join(f"- {', '.join(f'{f.name}: {f.type}' + ('' if f.nullable else ' not null') for f in s)}" for s in KINDS[kind].values())
        super().__init__(f"Parquet schema mismatch, found\n{found}\nexpected one of\n{expected}")


def _columns(schema: pq.ParquetSchema) -> list[tuple]:
    """What must be equal: path, physical and logical type, and by the levels whether each part is required."""
    cols = [schema.column(i) for i in range(len(schema.names))]
    return [(c.path, c.physical_type, str(c.logical_type), c.max_definition_level, c.max_repetition_level) for c in cols]


@lru_cache(None)
def _expected(kind: str) -> tuple[tuple[str, tuple], ...]:
    out = []
    for variant, schema in KINDS[kind].items():
        sink = io.BytesIO()
        pq.write_table(schema.empty_table(), sink, version="2.6")
        out.append((variant, tuple(_columns(pq.ParquetFile(io.BytesIO(sink.getvalue())).schema))))
    return tuple(out)


def variant_of(kind: str, file: pq.ParquetFile) -> str:
    """The variant whose schema equals the file's: no column more, less or in another order, and no type converted."""
    found = tuple(_columns(file.schema))
    for variant, expected in _expected(kind):
        if found == expected:
            return variant
    raise SchemaMismatch(kind, str(file.schema_arrow))


@dataclass(frozen=True)
class Array:
    """A pointer to a member of a container."""

    kind: str
    filename: str
    item_count: int

    def to_json(self) -> dict:
        return {"filename": self.filename, "item_count": self.item_count}


def spark_columns(kind: str, variant: str) -> list[str]:
    return KINDS[kind][variant].names
