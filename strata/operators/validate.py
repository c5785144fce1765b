"""Checks of arrays: conditions on rows, aggregates that summarise them, and tables of problems.

Row checks are columns that are true where a row is wrong, so they serve as filters, as counts and on streams alike. A NaN
never counts as too large or too small: comparisons with NaN are guarded, since Spark puts it above every number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G

UNIT_TOLERANCE = 1e-6


def not_finite(value: Column) -> Column:
    v = value.cast("double")
    return F.isnan(v) | (F.abs(v) == F.lit(float("inf")))


def any_not_finite(values: Column) -> Column:
    return F.exists(values, not_finite)


def not_above_zero(value: Column) -> Column:
    return ~F.isnan(value.cast("double")) & (value <= 0)


def wrong_range(least: Column, most: Column) -> Column:
    """Finite bounds in the wrong order."""
    return ~not_finite(least) & ~not_finite(most) & (least > most)


def not_unit(vector: Sequence[Column]) -> Column:
    off = F.abs(F.lit(1.0) - G.dot(vector, vector))
    return F.isnan(off) | (off >= UNIT_TOLERANCE)


def not_orthogonal(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return F.abs(G.dot(G.normalized(a), G.normalized(b))) >= UNIT_TOLERANCE


def not_power_of_two(n: Column) -> Column:
    return F.bit_count(n) != 1


def index_outside(count: Column | int, *index: Column) -> Column:
    """Any index of a row at or above count. Nulls are never outside."""
    most = count if isinstance(count, Column) else F.lit(count)
    return F.coalesce(F.greatest(*index, F.lit(-1)) >= most, F.lit(False))


def regular_corners(low: Sequence[Column], high: Sequence[Column], count: Sequence[int]) -> Column:
    """zero_size, outside or ok."""
    zero = _any(a >= b for a, b in zip(low, high, strict=True))
    outside = _any(b > n for b, n in zip(high, count, strict=True))
    return F.when(zero, "zero_size").when(outside, "outside").otherwise("ok")


def freeform_corners(low: Sequence[Column], high: Sequence[Column]) -> Column:
    """outside, zero_size or ok, of corners as shares of the parent."""
    nan = [(F.isnan(a.cast("double")), F.isnan(b.cast("double"))) for a, b in zip(low, high, strict=True)]
    outside = _any((~na & (a < 0)) | (~nb & (b > 1)) for (a, b), (na, nb) in zip(zip(low, high, strict=True), nan, strict=True))
    zero = _any(~na & ~nb & (a >= b) for (a, b), (na, nb) in zip(zip(low, high, strict=True), nan, strict=True))
    return F.when(outside, "outside").when(zero, "zero_size").otherwise("ok")


def mode_broken(low: Sequence[Column], high: Sequence[Column], count: Sequence[int], mode: str) -> Column:
    """Sub-blocks whose size the mode doesn't allow, or, in an octree, that don't lie at a multiple of their size."""
    size = [b - a for a, b in zip(low, high, strict=True)]
    allowed = G.octree_sizes(count) if mode == "octree" else G.full_sizes(count)
    fits = _any(_all(s == n for s, n in zip(size, sizes, strict=True)) for sizes in allowed)
    if mode == "octree":
        fits = fits & _all(a % F.nullif(s.cast("long"), F.lit(0)) == 0 for a, s in zip(low, size, strict=True))
    return ~F.coalesce(fits, F.lit(False))


def _any(conditions) -> Column:
    out = None
    for c in conditions:
        out = c if out is None else out | c
    return out


def _all(conditions) -> Column:
    out = None
    for c in conditions:
        out = c if out is None else out & c
    return out


# summaries: of constant size, so they are made with partial aggregates while an array is written


def minimum(value: Column) -> Column:
    """Least value but NaN; infinite if there is none."""
    return F.coalesce(F.min(F.when(~F.isnan(value.cast("double")), value)), F.lit(float("inf")))


def maximum_index(*index: Column) -> Column:
    """Largest index of any component, 0 if there is none."""
    return F.coalesce(F.max(F.greatest(*index) if len(index) > 1 else index[0]), F.lit(0)).cast("long")


def first_largest(row: Column, axis: Column, *pos: Column) -> Column:
    """The first row, by pos, with the largest value along an axis."""
    return F.max_by(row, F.struct(axis, *(-p for p in pos)))


def first_where(row: Column, wrong: Column, pos: Column) -> Column:
    """The first row that is wrong, null if none is."""
    return F.min_by(F.when(wrong, row), F.when(wrong, pos))


def duplicates(df: DataFrame, name: str) -> DataFrame:
    """Values that occur more than once, each once, and how often."""
    return df.groupBy(name).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def lengths(df: DataFrame, by: Column, expected: Column, name: str = "element") -> DataFrame:
    """Number of values of each element against the number it should have."""
    counted = df.groupBy(by.alias(name)).agg(F.count(F.lit(1)).alias("attr_len"))
    return counted.withColumn("geom_len", expected).withColumn("mismatch", F.col("attr_len") != F.col("geom_len"))


def report(problems: DataFrame, limit: int = 100) -> DataFrame:
    """By severity: how many problems are shown within the limit, and how many more there are."""
    n = problems.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    return n.select("severity", F.least("n", F.lit(limit)).cast("long").alias("shown"), F.greatest(F.col("n") - limit, F.lit(0)).cast("long").alias("more"))


def legend_scores(names: DataFrame, legend: str, name: str) -> DataFrame:
    """For each legend: number of different names that aren't empty, and length of all names in bytes."""
    return names.groupBy(legend).agg(
        F.count_distinct(F.nullif(F.col(name), F.lit(""))).alias("uniq"), F.coalesce(F.sum(F.octet_length(name)), F.lit(0)).cast("long").alias("total")
    )


def gradient_scores(colors: DataFrame, legend: str, *channels: str) -> DataFrame:
    """For each legend: number of different colors."""
    return colors.groupBy(legend).agg(F.count_distinct(F.struct(*channels)).alias("colors"))


def shared_cells(subblocks: DataFrame, parent: Sequence[str], low: Sequence[str], high: Sequence[str]) -> DataFrame:
    """Cells of regular sub-blocks' parents that more than one sub-block covers: the parent, the cell and how many there are. Sub-blocks should
    not overlap. A sub-block gives a row for each cell in it, and rows are counted before they are shuffled; no two sub-blocks are paired."""
    rows, cell = subblocks.select(*parent, *low, *high), []
    for i, (a, b) in enumerate(zip(low, high, strict=True)):
        cell.append(f"cell_{i}")
        last = F.col(b).cast("long") - 1
        inside = F.when(last >= F.col(a).cast("long"), F.sequence(F.col(a).cast("long"), last)).otherwise(F.array().cast("array<long>"))
        rows = rows.withColumn(cell[-1], F.explode(inside))
    return rows.groupBy(*parent, *cell).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
