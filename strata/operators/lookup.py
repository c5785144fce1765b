"""Joins by position: attributes to places, segments and triangles to vertices, categories to legends.

They are equi joins on a position; Spark broadcasts a side that its statistics show to be small and shuffles otherwise, so
nothing here forces a broadcast of a table that can grow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G


def attribute(geometry: DataFrame, values: DataFrame, pos: str = "pos") -> DataFrame:
    """geometry with the values of the same position, null where there are none."""
    return geometry.join(values, pos, "left")


def _ends(df: DataFrame, vertices: DataFrame, names: list[str], axes: list[str], pos: str) -> DataFrame:
    for n in names:
        end = vertices.select(F.col(pos).alias(n), *(F.col(a).alias(f"{a}_{n}") for a in axes))
        df = df.join(end, n)
    return df


def segments(df: DataFrame, vertices: DataFrame, axes: list[str], pos: str = "pos") -> DataFrame:
    """df (a, b) with the coordinates of both ends, <axis>_a and <axis>_b, and the squared length len2."""
    out = _ends(df, vertices, ["a", "b"], axes, pos)
    delta = [F.col(f"{a}_b") - F.col(f"{a}_a") for a in axes]
    return out.withColumn("len2", G.dot(delta, delta))


def triangles(df: DataFrame, vertices: DataFrame, axes: list[str], pos: str = "pos") -> DataFrame:
    """df (a, b, c) with the corners' coordinates and the normal of the counter-clockwise corner order, whose length is twice the area:
    nx, ny, nz in three dimensions, nz alone in two."""
    out = _ends(df, vertices, ["a", "b", "c"], axes, pos)
    b, c = ([F.col(f"{a}_{n}") - F.col(f"{a}_a") for a in axes] for n in "bc")
    if len(axes) == 2:
        return out.withColumn("nz", b[0] * c[1] - b[1] * c[0])
    return out.withColumns(dict(zip(("nx", "ny", "nz"), G.cross(b, c), strict=True)))


def category(df: DataFrame, legend: DataFrame, index: str, pos: str = "pos") -> DataFrame:
    """df with the legend's columns (names, colors, values of sub-attributes) of the row its index points to; a null or unmatched index gives nulls."""
    return df.join(legend.withColumnRenamed(pos, index), index, "left")


def members_missing(used: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """Names that are used and not known, each once."""
    return used.select(name).distinct().join(known.select(name), name, "left_anti")


def grid_corners(u: DataFrame, v: DataFrame, nu: int) -> DataFrame:
    """Corners (pos, x, y) of a grid from the edges (pos, edge) of its axes, U fastest. nu: corners along U.

    Each edge of U is repeated for every position along V, then joined to V's edge by that position.
    """
    last = v.agg(F.max("pos")).scalar()
    cells = u.select(F.col("pos").alias("i"), F.col("edge").alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("j"))
    pairs = cells.join(v.select(F.col("pos").cast("long").alias("j"), F.col("edge").alias("y")), "j")
    return pairs.select((F.col("j") * nu + F.col("i")).alias("pos"), "x", "y")


def surface_vertices(corners: DataFrame, heights: DataFrame | None, origin: G.Vector, u: G.Vector, v: G.Vector, height: str = "scalar", pos: str = "pos") -> DataFrame:
    """Vertices (pos, x, y, z) of a grid surface from its corners (pos, x along u, y along v) and their heights above its plane, along the
    normal u x v. No heights, and none for a corner: 0."""
    normal = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    up = F.lit(0.0)
    if heights is not None:
        corners, up = attribute(corners, heights, pos), F.coalesce(F.col(height).cast("double"), F.lit(0.0))
    placed = G.to_world([F.col("x"), F.col("y"), up], origin, [u, v, normal])
    return corners.select(pos, *(c.alias(n) for c, n in zip(placed, "xyz", strict=True)))


def totals(df: DataFrame, by: str, **sums: Column) -> DataFrame:
    """Rows and sums by a category's column."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(n) for n, c in sums.items()))
