"""Arrays as DataFrames with a position, and the checks of what is in them."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import casts as C
from ..operators import validate as V
from ..operators.ordered import previous
from ..storage import shared_folder
from .catalog import Problem, Use
from .container import Reader, Writer, _filesystem
from .kinds import CORNERS, KINDS, Array

_MIN, _MAX, _PARENT = CORNERS[:3], CORNERS[3:], [f"parent_{a}" for a in "uvw"]


def read_array(spark: SparkSession, reader: Reader, array: Array, folder: str | None = None, uses: Sequence[Use] = ()) -> DataFrame:
    """pos and the columns of an array, in the types of its variant. The schema and the length are checked by the footer; the member
    is copied to the shared folder and scanned there, with pruning and pushed filters as for any Parquet file. With uses, a row that breaks a
    rule of one of them fails the job that reads it."""
    variant = reader.variant(array)
    path = reader.stage(array, folder or shared_folder(spark))
    df = spark.read.parquet(path).select(F.col("_metadata.row_index").alias("pos"), *KINDS[array.kind][variant].names)
    return checked(df, uses)


def row_fault(use: Use) -> Column | None:
    """What is wrong in a row of the array, null where nothing is; or None, if the kind has no rule for rows. Needs the column "before" of a Boundary."""
    kind, bounds = use.array.kind, use.bounds

    def corners() -> Column:
        return F.concat(*(x for side, last in ((_MIN, " to "), (_MAX, "")) for x in (F.lit("["), F.concat_ws(", ", *side), F.lit(f"]{last}"))))

    if kind == "Scalar" and bounds.get("above_zero"):
        whole = F.col("scalar").cast("long")
        shown = F.when(F.col("scalar") == whole, whole.cast("string")).otherwise(F.col("scalar").cast("string"))
        return F.when(F.col("scalar") <= 0, F.concat(F.lit("size value "), shown, F.lit(" is zero or less")))
    if kind in ("Segment", "Triangle", "Index"):
        names = KINDS[kind]["U32"].names
        most = F.greatest(*names) if len(names) > 1 else F.col(names[0])
        return F.when(most >= bounds["count"], F.concat(F.lit("index value "), most, F.lit(f" exceeds the maximum index {max(0, bounds['count'] - 1)}")))
    if kind == "Boundary":
        return F.when(F.col("value") < F.col("before"), F.lit("discrete colormap boundary decreases"))
    if kind not in ("RegularSubblock", "FreeformSubblock"):
        return None
    outside = F.lit(False)
    for p, n in zip(_PARENT, bounds["blocks"], strict=True):
        outside = outside | (F.col(p) >= n)
    fault = F.when(outside, F.concat(F.lit("block index ["), F.concat_ws(", ", *_PARENT), F.lit(f"] exceeds the maximum index {[b - 1 for b in bounds['blocks']]}")))
    low, high = [F.col(c) for c in _MIN], [F.col(c) for c in _MAX]
    block = F.concat(F.lit("sub-block "), corners())
    if kind == "FreeformSubblock":
        status = V.freeform_corners(low, high)
        return fault.when(status == "zero_size", F.concat(block, F.lit(" has zero or negative size"))).when(status != "ok", F.concat(block, F.lit(" is outside the valid range of 0.0 to 1.0")))
    cells, mode = bounds["cells"], bounds.get("mode")
    status = V.regular_corners(low, high, cells)
    fault = fault.when(status == "zero_size", F.concat(block, F.lit(" has zero or negative size"))).when(status != "ok", F.concat(block, F.lit(f" exceeds the maximum {list(cells)}")))
    return fault.when(V.mode_broken(low, high, cells, mode.lower()), F.concat(block, F.lit(f" is invalid for {mode} mode"))) if mode else fault


def checked(df: DataFrame, uses: Sequence[Use]) -> DataFrame:
    """df, whose rows fail the job that reads them if they break a rule of a use."""
    columns = df.columns
    faults = []
    for use in uses:
        fault = row_fault(use)
        if fault is not None:
            head, tail = str(Problem(use.type, use.field, "array contains invalid data: \0", use.name)).split("\0")
            faults.append(F.concat(F.lit(head), fault, F.lit(tail)))
    if not faults:
        return df
    if "inclusive" in columns:
        df = previous(df, F.col("value"), "before")
    fault = F.coalesce(*faults)
    return df.where(F.when(fault.isNotNull(), F.raise_error(fault).cast("boolean")).otherwise(True)).select(*columns)


def as_kind(df: DataFrame, source: str, target: str, column: str = "number") -> DataFrame:
    """df with a column of numbers widened, or an error by the variants."""
    return df.withColumn(column, C.to_kind(F.col(column), source, target))


def with_vectors3(df: DataFrame, column: str = "vector") -> DataFrame:
    """2D vectors as 3D ones with z 0; null stays null."""
    three = "z" in df.schema[column].dataType.names
    v = C.vector3(F.col(f"{column}.x"), F.col(f"{column}.y"), F.col(f"{column}.z") if three else None)
    return df.withColumn(column, v)


def boundary_values(df: DataFrame) -> list:
    """A colormap's boundaries, in order; there are as many as colors in a legend."""
    from ..functions.color import Boundary

    return [Boundary(r["value"], r["inclusive"]) for r in df.orderBy("pos").collect()]


def write_array(writer: Writer, kind: str, variant: str, df: DataFrame) -> Array:
    """Writes df (pos and the kind's columns) as one member, in order of pos. Spark sorts by ranges into the shared folder; the
    driver then copies file after file, a batch at a time, so what it holds doesn't grow with the array."""
    folder = shared_folder(df.sparkSession) + "/table"
    df.sort("pos").drop("pos").write.parquet(folder)
    fs, at = _filesystem(folder)
    from pyarrow.fs import FileSelector

    files = sorted(f.path for f in fs.get_file_info(FileSelector(at)) if f.base_name.startswith("part-"))

    def batches():
        for f in files:
            with fs.open_input_file(f) as source:
                yield from pq.ParquetFile(source).iter_batches()

    return writer.batches(kind, variant, batches())


def array_problems(df: DataFrame, use: Use, limit: int | None = None) -> list[Problem]:
    """What is wrong in an array, as one message for each rule: summaries made by aggregates, of constant size. Sub-blocks invalid
    for their mode have a message each, up to the limit (None: all), and then one that stands for all others."""
    kind, bounds, out = use.array.kind, use.bounds, []

    def add(reason: str, count: int = 1) -> None:
        out.append(Problem(use.type, use.field, f"array contains invalid data: {reason}", use.name, count=count))

    if kind == "Scalar" and bounds.get("above_zero"):
        least = df.agg(V.minimum(F.col("scalar")).alias("v")).first()["v"]
        if least <= 0:
            add(f"size value {_number(least)} is zero or less")
    elif kind in ("Segment", "Triangle", "Index") and use.array.item_count:
        names = [c for c in df.columns if c != "pos"]
        most = df.agg(V.maximum_index(*map(F.col, names)).alias("v"), F.count(names[0]).alias("n")).first()
        if most["n"] and most["v"] >= bounds["count"]:
            add(f"index value {most['v']} exceeds the maximum index {max(0, bounds['count'] - 1)}")
    elif kind == "Boundary":
        rows = previous(df, F.col("value"), "before")
        if not rows.where("value < before").isEmpty():
            add("discrete colormap boundary decreases")
    elif kind in ("RegularSubblock", "FreeformSubblock") and use.array.item_count:
        _subblocks(df, kind, bounds, add, limit)
    return out


def _subblocks(df: DataFrame, kind: str, bounds: dict, add, limit: int | None) -> None:
    blocks = bounds["blocks"]
    tops = df.agg(*(V.first_largest(F.struct(*_PARENT), F.col(p), F.col("pos")).alias(p) for p in _PARENT)).first()
    seen = []
    for axis, p in enumerate(_PARENT):
        row = list(tops[p])
        if row[axis] >= blocks[axis] and row not in seen:
            seen.append(row)
            add(f"block index {row} exceeds the maximum index {[b - 1 for b in blocks]}")
    low, high = [F.col(c) for c in _MIN], [F.col(c) for c in _MAX]
    if kind == "FreeformSubblock":
        status = V.freeform_corners(low, high)
        bad = df.where(status != "ok").agg(V.first_where(F.struct(*CORNERS, status.alias("status")), F.lit(True), F.col("pos")).alias("r")).first()["r"]
        if bad:
            what = "has zero or negative size" if bad["status"] == "zero_size" else "is outside the valid range of 0.0 to 1.0"
            add(f"sub-block {_corners(bad)} {what}")
        return
    cells, mode = bounds["cells"], bounds.get("mode")
    status = V.regular_corners(low, high, cells)
    rows = df.select("pos", *CORNERS, status.alias("status"))
    first = F.struct(*CORNERS)
    wrong = rows.agg(
        V.first_where(first, F.col("status") == "zero_size", F.col("pos")).alias("zero"), *(V.first_largest(first, F.col(c), F.col("pos")).alias(c) for c in _MAX)
    ).first()
    if wrong["zero"]:
        add(f"sub-block {_corners(wrong['zero'])} has zero or negative size")
    shown = []
    for axis, c in enumerate(_MAX):
        if wrong[c][c] > cells[axis] and wrong[c] not in shown:
            shown.append(wrong[c])
            add(f"sub-block {_corners(wrong[c])} exceeds the maximum {list(cells)}")
    if mode:
        # different corners only; those beyond the limit of problems are counted
        broken = rows.where(F.col("status") != "zero_size").select(*CORNERS).distinct().where(V.mode_broken(low, high, cells, mode.lower()))
        ordered = broken.orderBy(*CORNERS)
        found = (ordered if limit is None else ordered.limit(limit)).collect()
        for r in found:
            add(f"sub-block {_corners(r)} is invalid for {mode} mode")
        others = broken.count() - len(found) if len(found) == limit else 0
        if others:
            add(f"{others} more sub-blocks are invalid for {mode} mode", others)


def _number(v) -> str:
    return str(int(v)) if float(v).is_integer() else str(v)


def _corners(r) -> str:
    return f"{[r[c] for c in _MIN]} to {[r[c] for c in _MAX]}"
