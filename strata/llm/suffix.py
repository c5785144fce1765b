"""Removal of repeated byte strings by longest-previous-factor arrays.

The longest previous factor of a place is the longest string that begins there and also begins at an earlier
place; in suffix order it lies at the previous or the next suffix of smaller place (Crochemore, Ilie). A byte is
repeated if a factor of at least `length` bytes covers it. The suffix order is made to the depth that matters,
`length` bytes, and only where strings can repeat: see repeats. There, equal ranks mean a common string of that length, and
previous and next smaller places within a rank are neighbours in the order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import frugal
from .repeats import MOST, in_parts, merged_spans, repeated_spans, rows_with_spans

LENGTH = 400
GRAM = 24


def remove_repeated_bytes(docs: DataFrame, length: int = LENGTH, keep_first: bool = True, most: int = MOST) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (begin, end), kept (binary) and kept_sha256 of every row.

    With keep_first, later copies go and the first stays, in order of doc_id and place; else all copies go.
    Matches never cross documents; they may overlap themselves. What is kept can begin or end within a
    character, so it is binary. A null text counts as empty. Rows of equal id and text are copies of each other and get
    equal results: all are treated as the first of them is. An empty table gives no rows. Other columns are ignored.
    """
    rows, spans = repeated_spans(docs, "byte", length, GRAM, keep_first, most)

    def row(doc_id: pa.Scalar, text: pa.Scalar, spans: pa.ListScalar) -> tuple:
        data, at, kept = text.as_buffer().to_pybytes(), 0, []
        cut = merged_spans(spans)
        for a, b in cut:
            kept.append(data[at:a])
            at = b
        kept = b"".join([*kept, data[at:]])
        return doc_id.as_py(), len(data), len(data) - len(kept), len(cut), [{"begin": a, "end": b} for a, b in cut], kept, hashlib.sha256(kept).hexdigest()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from in_parts(map(row, batch.column("doc_id"), batch.column("text"), batch.column("spans")), lambda r: len(r[5]), _OUT)

    return rows_with_spans(rows, spans).select("doc_id", "text", "spans").mapInArrow(
        frugal(apply), "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<begin:long,end:long>>, kept binary, kept_sha256 string"
    )


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary()), ("kept_sha256", pa.string())])
