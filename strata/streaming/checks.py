"""Row checks on streams: the same conditions as on tables, since they need one row at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def problems(rows: DataFrame, checks: dict[str, Column], pos: str = "pos") -> DataFrame:
    """pos and reason of each failed check; works on tables and on streams, without state."""
    found = F.array_compact(F.array(*(F.when(wrong, F.lit(reason)) for reason, wrong in checks.items())))
    return rows.select(pos, F.explode(found).alias("reason"))
