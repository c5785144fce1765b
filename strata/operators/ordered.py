"""Running sums, previous values and the like over rows that have a position.

Positions can be many, and a window without partitions would sort all of them in one task. So rows are cut into blocks of
neighbouring positions; windows run within blocks, and a small table with one row for each block carries over what came before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import written

#: Positions of a block.
BLOCK = 1 << 17


def _blocks(df: DataFrame, pos: str, block: int) -> DataFrame:
    return df.withColumn("__block", F.floor(F.col(pos) / block).cast("long"))


def running_sum(df: DataFrame, value: Column, name: str, pos: str = "pos", by: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """df with the sum of value over all smaller positions (of the same `by`), 0 at the first: edges of cells from their sizes.

    Positions must be unique within `by`. Nulls count as 0.
    """
    by = by or []
    rows = _blocks(df.withColumn("__value", F.coalesce(value, F.lit(0))), pos, block)
    sums = rows.groupBy(*by, "__block").agg(F.sum("__value").alias("__sum"))
    # one row for each block and group
    before = sums.select(*by, "__block", (F.sum("__sum").over(W.partitionBy(*by).orderBy("__block").rowsBetween(W.unboundedPreceding, 0)) - F.col("__sum")).alias("__before"))
    inner = F.coalesce(F.sum("__value").over(W.partitionBy(*by, "__block").orderBy(pos).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("__inner", inner).join(before, [*by, "__block"]).withColumn(name, F.col("__before") + F.col("__inner")).drop("__block", "__value", "__inner", "__before")


def previous(df: DataFrame, value: Column, name: str, pos: str = "pos", block: int = BLOCK) -> DataFrame:
    """df with the value at the next smaller position, null at the first."""
    rows = _blocks(df.withColumn("__value", value), pos, block)
    lasts = rows.groupBy("__block").agg(F.max_by("__value", pos).alias("__last"))
    before = lasts.select("__block", F.lag("__last").over(W.orderBy("__block")).alias("__before"))
    inner = W.partitionBy("__block").orderBy(pos)
    first = F.row_number().over(inner) == 1
    return (
        rows.withColumns({"__first": first, "__lag": F.lag("__value").over(inner)})
        .join(before, "__block")
        .withColumn(name, F.when(F.col("__first"), F.col("__before")).otherwise(F.col("__lag")))
        .drop("__block", "__value", "__first", "__lag", "__before")
    )


def with_position(df: DataFrame, *order: str, name: str = "pos", parts: int | None = None) -> DataFrame:
    """df with positions from 0 in the given order. Rows are dealt by ranges of the order, numbered within a range, and moved up by the
    counts of ranges before, of which there are few."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id())
    # the range of a row and its number in it must not be decided twice, so they're written before they're counted
    rows = written(rows.withColumn("__at", F.row_number().over(W.partitionBy("__part").orderBy(*order)) - 1))
    counts = rows.groupBy("__part").count()
    before = counts.select("__part", (F.sum("count").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, 0)) - F.col("count")).alias("__before"))
    return rows.join(F.broadcast(before), "__part").withColumn(name, (F.col("__before") + F.col("__at")).cast("long")).drop("__part", "__at", "__before")


def padded(df: DataFrame, length: int, default: dict[str, object], pos: str = "pos") -> DataFrame:
    """Positions 0 up to length: rows beyond it are cut, missing ones take the defaults."""
    base = df.sparkSession.range(length).select(F.col("id").alias(pos))
    joined = base.join(df, pos, "left")
    return joined.select(pos, *(F.coalesce(c, F.lit(default[c])).alias(c) if c in default else F.col(c) for c in df.columns if c != pos))


def head(df: DataFrame, k: int, pos: str = "pos") -> DataFrame:
    return df.orderBy(pos).limit(k)


def best(df: DataFrame, value: Column, *score: Column) -> DataFrame:
    """One row, `best`: the value with the largest score; of equal scores the largest value."""
    return df.agg(F.max_by(value, F.struct(*score, value)).alias("best"))
