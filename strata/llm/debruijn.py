"""Removal of long repeated word spans by a compacted de Bruijn graph.

Words are tokens; a window of `length` words is an edge between its first and its last length - 1 words. An edge is
repeated if it has more than one source coordinate (document, place). Paths of edges that follow each other
without a branch are compacted before anything is moved: a run of edges with a common minimiser is one path, known
by hashes of its minimiser and of its words (as in BCALM 2 and KMC). Joins on these find paths that repeat as a whole. Where paths with
a common minimiser branch, the words are fetched by their source coordinates and each edge is compared word hash by word hash.
Repeated edges of neighbouring paths then join up again to spans by their coordinates. See repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, give_back
from .repeats import MOST, in_parts, merged_spans, repeated_spans, rows_with_spans

LENGTH = 35
GRAM = 6

_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), ("kept", pa.string()), ("kept_sha256", pa.string())])


def _kept(data: bytes, spans: pa.ListScalar) -> tuple[int, int, list[tuple[int, int]], bytes]:
    words = data.split()  # at the six ASCII space characters
    cut, kept, at = merged_spans(spans), [], 0
    for a, b in cut:
        kept += words[at:a]
        at = b
    kept += words[at:]
    return len(words), len(words) - len(kept), cut, b" ".join(kept)


def remove_repeated_words(docs: DataFrame, length: int = LENGTH, keep_first: bool = False, most: int = MOST) -> DataFrame:
    """doc_id, n_words, n_removed, spans (begin, end, in words), kept and kept_sha256 of every row.

    Every word in a window that also begins elsewhere goes, or with keep_first in one that begins earlier, in order of
    doc_id and place. Kept words are joined by one space. A null text has no words. Rows of equal id and text are
    copies of each other and get equal results. An empty table gives no rows. Other columns are ignored.
    """
    rows, spans = repeated_spans(docs, "word", length, GRAM, keep_first, most)

    def row(doc_id: pa.Scalar, text: pa.Scalar, spans: pa.ListScalar) -> tuple:
        n, removed, cut, kept = _kept(text.as_buffer().to_pybytes(), spans)
        return doc_id.as_py(), n, removed, [{"begin": a, "end": b} for a, b in cut], kept.decode(), hashlib.sha256(kept).hexdigest()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from in_parts(map(row, batch.column("doc_id"), batch.column("text"), batch.column("spans")), lambda r: len(r[4]), _OUT)

    return rows_with_spans(rows, spans).select("doc_id", "text", "spans").mapInArrow(
        frugal(apply), "doc_id long, n_words long, n_removed long, spans array<struct<begin:long,end:long>>, kept string, kept_sha256 string"
    )


def without_repeated_words(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """All rows and columns of docs; a text with repeated spans becomes its other words, joined by one space, and
    n_chars its length. Texts without any stay as they are."""
    rows, spans = repeated_spans(docs, "word", length, GRAM, whole_rows=True)

    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = pa.array((_kept(t.as_buffer().to_pybytes(), s)[3].decode() if s.is_valid else None for t, s in zip(texts, spans, strict=True)), pa.string())
        give_back()
        return out

    marked = rows_with_spans(rows, spans)
    changed = F.col("spans").isNotNull()
    text = F.when(changed, cut("text", "spans")).when(~F.col("no_text"), F.col("text"))
    marked = marked.select(changed.alias("changed"), text.alias("text"), "rest")
    n_chars = F.when(F.col("changed"), F.length("text").cast("long")).otherwise(F.col("rest.n_chars"))
    return marked.select(*(F.col("text") if c == "text" else n_chars.alias(c) if c == "n_chars" else F.col(f"rest.`{c}`") for c in docs.columns))
