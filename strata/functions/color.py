"""Colormaps, categories' colors and texture coordinates as column expressions.

Colors are structs (r, g, b, a) of 0 to 255. Nulls stay null, except where a default is named.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Rgba = tuple[int, int, int, int]
GRAY: Rgba = (128, 128, 128, 255)


@dataclass(frozen=True)
class Boundary:
    """The upper end of a bin: values below it, or up to and with it if inclusive."""

    value: object
    inclusive: bool = False

    def holds(self, value: Column) -> Column:
        return value <= F.lit(self.value) if self.inclusive else value < F.lit(self.value)


def color(c: Rgba | Column) -> Column:
    if isinstance(c, Column):
        return c
    return F.struct(*(F.lit(int(v)).alias(n) for n, v in zip("rgba", c, strict=True)))


def discrete_bin(value: Column, boundaries: Sequence[Boundary]) -> Column:
    """Number of the first boundary that holds the value, or the number of boundaries. Boundaries mustn't decrease; a repeated one
    leaves an empty bin. NaN is above all. A chain of CASE branches over the few boundaries takes the place of a range join."""
    _not_decreasing(boundaries)
    chain = F.when(value.isNull(), F.lit(None).cast("int"))
    for i, b in enumerate(boundaries):
        chain = chain.when(b.holds(value), F.lit(i))
    return chain.otherwise(F.lit(len(boundaries)))


def discrete_color(value: Column, boundaries: Sequence[Boundary], gradient: Sequence[Rgba]) -> Column:
    if len(gradient) != len(boundaries) + 1:
        raise ValueError(f"length {len(gradient)} does not match geometry ({len(boundaries) + 1})")
    return F.get(F.array(*map(color, gradient)), discrete_bin(value, boundaries))


def _not_decreasing(boundaries: Sequence[Boundary]) -> None:
    for a, b in zip(boundaries, boundaries[1:]):
        if b.value < a.value:
            raise ValueError("discrete colormap boundary decreases")


def continuous_color(value: Column, least: object, most: object, gradient: Sequence[Rgba]) -> Column:
    """Linear between the two nearest of evenly spaced colors; the end colors beyond the range. least and most are numbers in the unit
    of value (cast dates before). A range of one point takes the first color up to it and the last one above."""
    if not gradient:
        raise ValueError("a gradient has a color at least")
    low, high, last = F.lit(float(least)), F.lit(float(most)), len(gradient) - 1
    v = value.cast("double")
    share = F.when(F.lit(float(least) == float(most)), F.when(v <= low, 0.0).otherwise(1.0)).otherwise((v - low) / F.nullif(high - low, F.lit(0.0)))
    at = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * float(last)
    below = F.least(F.floor(at), F.lit(max(0, last - 1))).cast("int")

    def channel(i: int) -> Column:
        steps = F.array(*(F.lit(float(c[i])) for c in gradient))
        a, b = F.get(steps, below), F.get(steps, F.least(below + 1, F.lit(last)))
        return F.round(a * (1.0 - (at - below)) + b * (at - below)).cast("int")

    return F.when(value.isNotNull(), F.struct(*(channel(i).alias(n) for i, n in enumerate("rgba"))))


def color_or(c: Column, element: Column | None = None, default: Rgba = GRAY) -> Column:
    """A null color takes the element's, or the default."""
    return F.coalesce(c, *([element] if element is not None else []), color(default))


def rgba_hex(r: Column, g: Column, b: Column, a: Column) -> Column:
    """#rrggbbaa, lower case."""
    return F.concat(F.lit("#"), *(F.lower(F.lpad(F.hex(c.cast("long")), 2, "0")) for c in (r, g, b, a)))


def boundary_label(value: Column, inclusive: Column) -> Column:
    return F.concat(F.when(inclusive, F.lit("≤ ")).otherwise(F.lit("< ")), value.cast("string"))


def wrap(u: Column) -> Column:
    """A texture coordinate wrapped to 0 up to 1."""
    return u - F.floor(u)


def projected(point: Sequence[Column], origin: Sequence[float], axis: Sequence[float], size: float) -> Column:
    """Coordinate of a point along a projected texture's axis, whose length is size."""
    return sum((p - F.lit(float(o))) * F.lit(float(a)) for p, o, a in zip(point, origin, axis, strict=True)) / F.lit(float(size))
