"""Trees from parts, text files, block models built and taken apart, arrays as NumPy."""

import datetime as dt
import math
import random

import numpy as np
from pyspark.sql import functions as F

from strata.sources import build as B
from strata.sources import catalog, text
from strata.sources.project import ProjectReader, ProjectWriter


def test_parts_make_a_project(spark, tmp_path):
    w = ProjectWriter(spark, str(tmp_path / "p.zip"))
    a = w.array
    vertices = a("Vertex", "F64", [(0, 0, 0), (1, 0, 0), (0, 1, 0)])
    gradient = lambda n: a("Gradient", "Rgba8", [(i, i, i, 255) for i in range(n)])
    sizes = a("Scalar", "F64", [1.0, 2.0])
    number = a("Number", "F64", [1.0, None, 3.0])
    points = B.element("points", B.point_set(vertices, [1.0, 2.0, 3.0]), [
        B.attribute("continuous", "Vertices", B.numbers(number, B.continuous_colormap(0.0, 1.0, gradient(2))), units="g/t"),
        B.attribute("discrete", "Vertices", B.numbers(number, B.discrete_colormap(a("Boundary", "F64", [(1.0, True)]), gradient(2)))),
        B.attribute("vector", "Vertices", B.vectors(a("Vector", "F64x2", [(1, 2), None, (3, 4)]))),
        B.attribute("text", "Vertices", B.strings(a("Text", "Text", ["a", None, "c"]))),
        B.attribute("flag", "Vertices", B.booleans(a("Boolean", "Boolean", [True, None, False]))),
        B.attribute("color", "Vertices", B.colors(a("Color", "Rgba8", [(1, 2, 3, 4), None, (5, 6, 7, 8)]))),
        B.attribute("category", "Vertices", B.categories(a("Index", "U32", [0, 1, None]), a("Name", "String", ["x", "y"]), gradient(2))),
    ], color=[1, 2, 3, 255])
    grid = B.tensor_grid(sizes, sizes, sizes)
    tree = B.project("p", [
        points,
        B.element("parts", B.composite([B.element("lines", B.line_set(vertices, a("Segment", "U32", [(0, 1)]))), B.element("surface", B.surface(vertices, a("Triangle", "U32", [(0, 1, 2)])))])),
        B.element("grid", B.grid_surface(B.orient(), B.regular_grid([1, 1], [2, 2]))),
        B.element("blocks", B.block_model(B.orient([1.0, 0.0, 0.0]), grid)),
        B.element("sub", B.block_model(B.orient(), B.regular_grid([1, 1, 1], [1, 1, 1]), B.regular_subblocks([2, 2, 2], a("RegularSubblock", "U32U32", [(0, 0, 0, 0, 0, 0, 2, 2, 2)]), "Full"))),
    ], dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc), units="m")
    assert w.finish(tree) == []
    r = ProjectReader(spark, str(tmp_path / "p.zip"))
    assert r.project == tree and r.problems() == [] and tree["date"] == "2024-01-01T00:00:00Z"
    got = {x["name"]: B.to_numpy(r.array(x["data"]["values"])) for x in r.project["elements"][0]["attributes"]}
    assert got["continuous"][0].tolist() == [1, 0, 3] and got["continuous"][1].tolist() == [False, True, False]
    assert got["vector"][0].tolist() == [[1, 2], [0, 0], [3, 4]] and got["color"][0][2].tolist() == [5, 6, 7, 8]
    assert got["text"][0].tolist() == ["a", "", "c"] and got["flag"][0].tolist() == [True, False, False]
    assert B.to_numpy(r.array(vertices))[0].shape == (3, 3)


def test_json_schema_covers_the_tree():
    schema = catalog.json_schema()
    assert set(schema["$defs"]) == {"Array", "Orient", "Grid", "Subblocks", "Colormap", "Data", "Attribute", "Geometry", "Element"}
    kinds = [v["properties"]["type"]["const"] for v in schema["$defs"]["Geometry"]["oneOf"]]
    assert kinds == ["PointSet", "LineSet", "Surface", "GridSurface", "BlockModel", "Composite"] and schema["required"] == ["date"]


def test_obj(spark, tmp_path):
    (tmp_path / "a.obj").write_text("# x\nv 0 0 0\nv 1 0 0.5\nvn 0 0 1\nv 0 1 0\nf 1/1 2/2 3/3\nf 3 2 1\n")
    v, f = text.read_obj(spark, str(tmp_path / "a.obj"))
    assert [tuple(r)[-3:] for r in v.select("pos", "x", "y", "z").orderBy("pos").collect()] == [(0, 0, 0), (1, 0, 0.5), (0, 1, 0)]
    assert [tuple(r) for r in f.select("pos", "a", "b", "c").orderBy("pos").collect()] == [(0, 0, 1, 2), (1, 2, 1, 0)]


def test_block_model_round_trip(spark, tmp_path):
    rng = random.Random(3)
    c, s = math.cos(math.radians(10)), math.sin(math.radians(10))
    axes, origin, parent, count = [(c, s, 0), (-s, c, 0), (0, 0, 1)], (-1662.0, -1340.0, -423.0), (400.0, 400.0, 400.0), (4, 4, 4)
    rows, want = ["id,x,y,z,dx,dy,dz,category"], []
    for i in range(60):
        p = [rng.randrange(8), rng.randrange(6), rng.randrange(8)]
        low = [rng.randrange(4) for _ in range(3)]
        high = [rng.randrange(a + 1, 5) for a in low]
        local = [q * 400 + (a + b) * 50 for q, a, b in zip(p, low, high)]
        world = [o + sum(x * axis[k] for x, axis in zip(local, axes)) for k, o in enumerate(origin)]
        rows.append(",".join(map(str, [i, *world, *((b - a) * 100 for a, b in zip(low, high)), f"c{i % 3}"])))
        want.append((*p, *low, *high))
    (tmp_path / "b.csv").write_text("\n".join(rows))
    blocks = text.read_blocks(spark, str(tmp_path / "b.csv"), skip=1)
    sub = text.subblocks(blocks, origin, axes, parent, count)
    names = [f"parent_{a}" for a in "uvw"] + [f"corner_{m}_{a}" for m in ("min", "max") for a in "uvw"]
    assert [tuple(r) for r in sub.orderBy("pos").select(*names).collect()] == want
    boxes = text.subblock_boxes(sub, origin, axes, parent, count)
    off = boxes.alias("a").join(blocks.alias("b"), "pos").agg(F.max(F.greatest(*(F.abs(F.col(f"a.{n}") - F.col(f"b.{n}")) for n in ("x", "y", "z", "dx", "dy", "dz")))))
    assert off.first()[0] < 1e-6
    assert np.isfinite(off.first()[0])
