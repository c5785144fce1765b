"""Grids, orientations, blocks and sub-blocks as column expressions. Block numbers run along U first, then V, then W."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = Sequence[float]

#: Where values can lie on each geometry, and what their number is called in the table of an element's counts.
LOCATIONS = {
    "PointSet": {"Vertices": "vertices"},
    "LineSet": {"Vertices": "vertices", "Primitives": "segments"},
    "Surface": {"Vertices": "vertices", "Primitives": "triangles"},
    "GridSurface": {"Vertices": "corners", "Primitives": "cells"},
    "BlockModel": {"Vertices": "corners", "Primitives": "blocks", "Subblocks": "subblocks"},
    "Composite": {"Elements": "elements"},
}


def flatten(index: Sequence[Column], count: Sequence[int]) -> Column:
    flat, step = None, 1
    for i, n in zip(index, count, strict=True):
        part = i.cast("long") * step
        flat, step = part if flat is None else flat + part, step * n
    return flat


def unflatten(flat: Column, count: Sequence[int | None]) -> list[Column]:
    """Indices of a flat number; the last count isn't needed."""
    out, rest = [], flat.cast("long")
    for n in count[:-1]:
        out.append((rest % F.lit(n)).cast("long"))
        rest = F.call_function("div", rest, F.lit(n))
    return [*out, rest]


def cells(count: Sequence[Column | int]) -> Column:
    out = F.lit(1).cast("long")
    for n in count:
        out = out * (n if isinstance(n, Column) else F.lit(n)).cast("long")
    return out


def corners(count: Sequence[Column | int]) -> Column:
    return cells([(n if isinstance(n, Column) else F.lit(n)) + 1 for n in count])


def dot(a: Sequence[Column | float], b: Sequence[Column | float]) -> Column:
    def column(x):
        return x if isinstance(x, Column) else F.lit(float(x))

    out = None
    for x, y in zip(a, b, strict=True):
        out = column(x) * column(y) if out is None else out + column(x) * column(y)
    return out


def norm(a: Sequence[Column]) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Sequence[Column]) -> list[Column]:
    """Unit length; the zero vector stays."""
    n = norm(a)
    return [F.when(n > 0, x / F.nullif(n, F.lit(0.0))).otherwise(x) for x in a]


def cross(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def minus(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [x - y for x, y in zip(a, b, strict=True)]


def to_world(local: Sequence[Column], origin: Vector, axes: Sequence[Vector]) -> list[Column]:
    """origin + local[0] axes[0] + local[1] axes[1] ..., component by component."""
    return [F.lit(float(origin[k])) + dot(local, [axis[k] for axis in axes]) for k in range(len(origin))]


def to_local(world: Sequence[Column], origin: Vector, axes: Sequence[Vector]) -> list[Column]:
    """The inverse of to_world for unit axes at right angles."""
    moved = [w - F.lit(float(o)) for w, o in zip(world, origin, strict=True)]
    return [dot(moved, axis) for axis in axes]


def block_of(local: Column, size: float) -> Column:
    """Number, along an axis, of the block that holds a local coordinate."""
    return F.floor(local / F.lit(float(size))).cast("long")


def shifted(values: Sequence[Column], *origins: Vector) -> list[Column]:
    """Positions with the origins of geometry and project added."""
    out = list(values)
    for o in origins:
        out = [v + F.lit(float(x)) for v, x in zip(out, o, strict=True)]
    return out


def cell_center(index: Column, size: Column | float) -> Column:
    return (index + F.lit(0.5)) * (size if isinstance(size, Column) else F.lit(float(size)))


def subblock_regular(parent: Column, low: Column, high: Column, count: int, cell: float) -> tuple[Column, Column]:
    """Centroid and size along an axis of a sub-block with corners low and high in a parent cut into count cells of that size."""
    a, b = (parent * count + low) * F.lit(float(cell)), (parent * count + high) * F.lit(float(cell))
    return (a + b) / 2, (high - low) * F.lit(float(cell))


def subblock_corner(centroid: Column, size: Column, parent: Column, count: int, cell: float, upper: bool) -> Column:
    """The corner, in cells of the parent, of a sub-block given by centroid and size: the inverse of subblock_regular."""
    edge = centroid + size / 2 if upper else centroid - size / 2
    return (F.round(edge / F.lit(float(cell))) - parent * count).cast("long")


def subblock_freeform(parent: Column, share: Column, size: float) -> Column:
    """Coordinate of a corner given as a share of its parent."""
    return (parent + share) * F.lit(float(size))


def octree_sizes(count: Sequence[int]) -> list[tuple[int, ...]]:
    """Sub-block sizes allowed in an octree: the whole parent, then each axis halved down to 1."""
    out = [tuple(count)]
    while any(n > 1 for n in out[-1]):
        out.append(tuple(max(1, n // 2) for n in out[-1]))
    return out


def full_sizes(count: Sequence[int]) -> list[tuple[int, ...]]:
    """Sub-block sizes allowed in full mode: single cells and the whole parent."""
    return list(dict.fromkeys([(1,) * len(count), tuple(count)]))
