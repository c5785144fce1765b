"""Points, triangles and block models from text files, by Spark's text and CSV readers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators.ordered import with_position


def read_obj(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (pos, x, y, z) and triangles (pos, a, b, c, from 0) of a Wavefront OBJ file; other lines are skipped. Lines keep their
    order by their place in the file."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.split(F.trim("value"), r"\s+").alias("w"))
    v = lines.where("w[0] = 'v'").select("line", *(F.col("w")[i + 1].cast("double").alias(n) for i, n in enumerate("xyz")))
    f = lines.where("w[0] = 'f'").select("line", *((F.split(F.col("w")[i + 1], "/")[0].cast("long") - 1).alias(n) for i, n in enumerate("abc")))
    return with_position(v, "line").drop("line"), with_position(f, "line").drop("line")


def read_blocks(spark: SparkSession, path: str, skip: int = 0, **options) -> DataFrame:
    """pos, x, y, z, dx, dy, dz, category of CSV rows whose columns from number skip on are centroid, size and category. The first row is a header."""
    names = [f"skipped{i}" for i in range(skip)] + ["x", "y", "z", "dx", "dy", "dz", "category"]
    schema = ", ".join(f"{n} {'string' if n == 'category' or n.startswith('skipped') else 'double'}" for n in names)
    rows = spark.read.csv(path, schema=schema, header=True, **options).drop(*names[:skip])
    return with_position(rows.withColumn("line", F.monotonically_increasing_id()), "line").drop("line")


def subblocks(blocks: DataFrame, origin: Sequence[float], axes: Sequence[Sequence[float]], parent: Sequence[float], count: Sequence[int]) -> DataFrame:
    """Regular sub-blocks (parent_u .. corner_max_w) of blocks given by centroid and size in the world, on a grid of parents of the given size, each cut into count cells."""
    local = G.to_local([F.col(c) for c in "xyz"], origin, axes)
    out = {}
    for axis, at, size, whole, n in zip("uvw", local, ("dx", "dy", "dz"), parent, count, strict=True):
        block, cell = G.block_of(at, whole), whole / n
        out[f"parent_{axis}"] = block
        out[f"corner_min_{axis}"] = G.subblock_corner(at, F.col(size), block, n, cell, upper=False)
        out[f"corner_max_{axis}"] = G.subblock_corner(at, F.col(size), block, n, cell, upper=True)
    return blocks.select("pos", "category", *(c.alias(n) for n, c in out.items()))


def subblock_boxes(rows: DataFrame, origin: Sequence[float], axes: Sequence[Sequence[float]], parent: Sequence[float], count: Sequence[int]) -> DataFrame:
    """The inverse of subblocks: pos, centroid x, y, z in the world and size dx, dy, dz."""
    local, size = [], []
    for axis, whole, n in zip("uvw", parent, count, strict=True):
        c, d = G.subblock_regular(F.col(f"parent_{axis}"), F.col(f"corner_min_{axis}"), F.col(f"corner_max_{axis}"), n, whole / n)
        local.append(c)
        size.append(d)
    world = G.to_world(local, origin, axes)
    return rows.select("pos", *(c.alias(n) for c, n in zip(world, "xyz", strict=True)), *(s.alias(n) for s, n in zip(size, ("dx", "dy", "dz"), strict=True)))
