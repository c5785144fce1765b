"""Lossless casts between number, date and vector kinds, as column expressions.

A cast that could lose information is refused when the expression is made, by the kind of the column, and not row by row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Number kinds, with their Spark types.
KINDS = {"F32": "float", "F64": "double", "I64": "bigint", "Date": "date", "DateTime": "timestamp"}
_WIDER = {("F32", "F32"), ("F32", "F64"), ("F64", "F64"), ("I64", "I64"), ("Date", "F64"), ("Date", "I64"), ("DateTime", "F64"), ("DateTime", "I64")}


class UnsafeCast(ValueError):
    def __init__(self, source: str, target: str):
        super().__init__(f"can't safely cast from {source} to {target}")


def kind_of(type_name: str) -> str:
    for kind, name in KINDS.items():
        if type_name in (name, "timestamp_ntz" if kind == "DateTime" else name):
            return kind
    raise ValueError(f"{type_name} isn't a number kind")


def to_kind(value: Column, source: str, target: str) -> Column:
    """Widens a number: floats to floats; dates to days and date-times to microseconds (I64) or seconds (F64) since 1970."""
    if (source, target) not in _WIDER:
        raise UnsafeCast(source, target)
    if source == "Date":
        return F.unix_date(value).cast(KINDS[target])
    if source == "DateTime":
        us = micros(value)
        return us if target == "I64" else seconds(us)
    return value.cast(KINDS[target])


def micros(value: Column) -> Column:
    """Microseconds since 1970; the session's time zone must be UTC for values without one."""
    return F.unix_micros(value.cast("timestamp"))


def seconds(us: Column) -> Column:
    """Whole seconds and their fraction added apart, as the format lays down."""
    million = F.lit(10**6)
    return F.call_function("div", us, million).cast("double") + (us % million).cast("double") / F.lit(1e6)


def days_to_date(days: Column) -> Column:
    return F.date_from_unix_date(days.cast("int"))


def micros_to_timestamp(us: Column) -> Column:
    return F.timestamp_micros(us)


def value_and_mask(value: Column, default: object) -> tuple[Column, Column]:
    """Values with nulls filled, and the mask that is true where they were."""
    return F.coalesce(value, F.lit(default)), value.isNull()


def group(**parts: Column) -> Column:
    """A struct that is null if any part is."""
    struct = F.struct(*(c.alias(n) for n, c in parts.items()))
    whole = None
    for c in parts.values():
        whole = c.isNotNull() if whole is None else whole & c.isNotNull()
    return F.when(whole, struct)


def vector3(x: Column, y: Column, z: Column | None = None) -> Column:
    """Two or three components as a 3D vector of doubles; a missing z is 0."""
    return group(x=x.cast("double"), y=y.cast("double"), z=F.lit(0.0) if z is None else z.cast("double"))


def not_nan(value: Column) -> Column:
    """NaN as null."""
    return F.when(~F.isnan(value), value)


def not_empty(text: Column) -> Column:
    """The empty string as null."""
    return F.nullif(text, F.lit(""))


def channel(value: Column) -> Column:
    """An integer clamped to a color channel."""
    return F.least(F.greatest(value, F.lit(0)), F.lit(255)).cast("int")


def category_index(value: Column) -> tuple[Column, Column]:
    """-1 as null; and whether the index is out of range for 32 bits without sign."""
    return F.when(value != -1, value), (value < -1) | (value > F.lit(2**32 - 1))


def two_valued(value: Column) -> Column:
    """A boolean whose null counts as false."""
    return F.coalesce(value, F.lit(False))


def metadata(text: Column, path: str, kind: str = "string") -> Column:
    """The value at a path ("$.by.crew", "$.depth[1]") of JSON metadata, null where there is none, it isn't of that kind or the text isn't JSON."""
    return F.try_variant_get(F.try_parse_json(text), path, kind)
