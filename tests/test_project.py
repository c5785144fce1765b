"""Whole projects: one with a bit of everything, its wrong twin, and damaged containers."""

import datetime as dt
import gzip
import json
import re
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strata.functions import color as K
from strata.operators import lookup as J
from strata.sources import build as B
from strata.sources import catalog, container, images, kinds
from strata.sources.arrays import array_problems, as_kind, boundary_values, with_vectors3
from strata.sources.project import ProjectReader, ProjectWriter

NAN, INF = float("nan"), float("inf")
PNG = images.encode_png(np.arange(6 * 3 * 3, dtype=np.uint8).reshape(6, 3, 3))


def day(n):
    return dt.date(2015, 3, 1) + dt.timedelta(days=n)


def quarry(a, image):
    """The tree of a small quarry; a writes an array, image a picture. Every kind of geometry and of attribute is in it."""
    rng = np.random.default_rng(12)
    collars = [(100.0 * i, 40.0 * (i % 2), 310.0 + i) for i in range(4)]
    traces = [p for x, y, z in collars[:3] for p in ((x, y, z), (x + 5.0, y, z - 80.0), (x + 12.0, y, z - 150.0))]
    spacing = a("Scalar", "F64", [10.0, 20.0, 15.0])
    terrain = B.grid_surface(
        B.orient(origin=[5.0, 6.0, 300.0], u=[0.6, 0.8, 0.0], v=[-0.8, 0.6, 0.0]), B.regular_grid([25, 50], [3, 2]), heights=a("Scalar", "F32", rng.integers(0, 9, 12).astype(float).tolist())
    )
    rock = B.categories(
        a("Index", "U32", [2, None, 0, 2]), a("Name", "String", ["clay", "sand", "chalk"]), gradient=a("Gradient", "Rgba8", [(90, 60, 30, 255), (240, 220, 130, 255), (250, 250, 240, 255)]),
        attributes=[B.attribute("density", "Categories", B.numbers(a("Number", "F64", [1.9, 1.6, None])))],
    )
    drilled = B.numbers(a("Number", "Date", [day(0), day(30), None, day(61)]), B.discrete_colormap(a("Boundary", "Date", [(day(1), True), (day(60), False)]), a("Gradient", "Rgba8", [(i, i, i, 255) for i in (0, 120, 240)])))
    assay = B.numbers(a("Number", "F32", [0.25, None, 4.5, 2.0, 1.0, 0.5]), B.continuous_colormap(0.0, 5.0, a("Gradient", "Rgba8", [(0, 0, i, 255) for i in range(16)])))
    tetrahedron = a("Vertex", "F32", [(0, 0, 0), (9, 0, 0), (0, 9, 0), (0, 0, 9)])
    faces = a("Triangle", "U32", [(0, 2, 1), (0, 1, 3), (1, 2, 3), (2, 0, 3)])
    parts = [(0, 0, 0, 0, 0, 0, 4, 2, 1), (2, 2, 0, 0, 0, 0, 2, 1, 1), (2, 2, 0, 2, 0, 0, 4, 1, 1), (2, 2, 0, 0, 1, 0, 2, 2, 1)]
    slabs = [(0, 0, k, 0.0, 0.0, lo, 1.0, 1.0, hi) for k in range(3) for lo, hi in ((0.0, 0.25), (0.25, 1.0))]
    return B.project("Quarry", [
        B.element("Terrain", terrain, [B.attribute("photo", "Projected", B.projected_texture(image(PNG), B.orient(u=[0.0, 1.0, 0.0], v=[0.0, 0.0, 1.0]), 75.0, 100.0)), B.attribute("soil", "Primitives", B.strings(a("Text", "Text", ["a", None, "", "d", "e", "f"])))]),
        B.element("Collars", B.point_set(a("Vertex", "F64", collars), origin=[1000.0, 2000.0, 0.0]), [
            B.attribute("rock", "Vertices", rock), B.attribute("drilled", "Vertices", drilled), B.attribute("flooded", "Vertices", B.booleans(a("Boolean", "Boolean", [True, None, False, False]))),
            B.attribute("dip", "Vertices", B.vectors(a("Vector", "F64x3", [(0, 0, -1), None, (0, 0.6, -0.8), (0, 0, -1)]))), B.attribute("drift", "Vertices", B.vectors(a("Vector", "F32x2", [None, (1, 2), (3, 4), None])))]),
        B.element("Traces", B.line_set(a("Vertex", "F64", traces), a("Segment", "U32", [(3 * i + j, 3 * i + j + 1) for i in range(3) for j in (0, 1)])), [
            B.attribute("assay", "Primitives", assay), B.attribute("paint", "Primitives", B.colors(a("Color", "Rgba8", [(255, 0, i, 255) for i in range(5)] + [None])))]),
        B.element("Boulder", B.surface(tetrahedron, faces), [B.attribute("skin", "Vertices", B.mapped_texture(image(PNG), a("Texcoord", "F32", [(0, 0), (1, 0), (0.5, 1), (2, -1)])))]),
        B.element("Chalk", B.block_model(B.orient(), B.tensor_grid(spacing, spacing, a("Scalar", "F32", [7.5])), B.regular_subblocks([4, 2, 1], a("RegularSubblock", "U32U32", parts), "Octree")), [
            B.attribute("order", "Subblocks", B.numbers(a("Number", "I64", [4, 3, 2, None])))]),
        B.element("Overburden", B.block_model(B.orient(u=[0.0, 1.0, 0.0], v=[-1.0, 0.0, 0.0]), B.regular_grid([8, 8, 2], [1, 1, 3]), B.freeform_subblocks(a("FreeformSubblock", "U32F64", slabs))), [
            B.attribute("seen", "Primitives", B.numbers(a("Number", "DateTime", [dt.datetime(2016, 1, i, 6, 30, tzinfo=dt.timezone.utc) for i in (1, 2, 3)])))]),
        B.element("Buildings", B.composite([B.element("Mast", B.point_set(a("Vertex", "F32", [(3, 3, 40)]))), B.element("Shed", B.surface(tetrahedron, faces))]), [B.attribute("built", "Elements", B.numbers(a("Number", "I64", [1990, 2004])))]),
    ], date=dt.datetime(2020, 2, 29, 12, tzinfo=dt.timezone.utc), metadata={"none": None, "depth": [1, 2.5], "by": {"crew": "B"}})


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("p") / "quarry.zip")
    w = ProjectWriter(spark, path, pre_release="beta.1")
    project = quarry(w.array, w.image)
    assert w.finish(project) == []
    return path, project


def data_of(project, element, attribute):
    return project["elements"][element]["attributes"][attribute]["data"]


def test_round_trip(spark, written):
    path, project = written
    r = ProjectReader(spark, path)
    assert r.project == project and r.warnings == [] and r.problems() == []
    assert (r.file.version, r.file.pre_release) == ((2, 0), "beta.1")
    assert "1.parquet" in r.file.members and sum(m.endswith(".png") for m in r.file.members) == 2
    geometry = [e["geometry"] for e in project["elements"]]
    rows = lambda x: [tuple(v)[1:] for v in r.array(x).orderBy("pos").collect()]
    assert rows(geometry[1]["vertices"]) == [(100.0 * i, 40.0 * (i % 2), 310.0 + i) for i in range(4)]
    assert rows(geometry[2]["segments"])[-1] == (7, 8) and rows(geometry[3]["triangles"])[1] == (0, 1, 3)
    assert rows(geometry[4]["grid"]["u"]) == [(10.0,), (20.0,), (15.0,)] and rows(geometry[4]["subblocks"]["subblocks"])[2] == (2, 2, 0, 2, 0, 0, 4, 1, 1)
    assert rows(geometry[5]["subblocks"]["subblocks"])[1] == (0, 0, 0, 0.0, 0.0, 0.25, 1.0, 1.0, 1.0)
    assert rows(data_of(project, 0, 1)["values"]) == [("a",), (None,), ("",), ("d",), ("e",), ("f",)]
    assert rows(data_of(project, 1, 2)["values"]) == [(True,), (None,), (False,), (False,)]
    assert [x[0] and tuple(x[0]) for x in rows(data_of(project, 2, 1)["values"])] == [(255, 0, i, 255) for i in range(5)] + [None]
    drilled, seen = data_of(project, 1, 1), data_of(project, 5, 0)["values"]
    assert r.variant(drilled["values"]) == "Date" and r.variant(geometry[3]["vertices"]) == "F32"
    bins = boundary_values(r.array(drilled["colormap"]["boundaries"]))
    assert [(b.value, b.inclusive) for b in bins] == [(day(1), True), (day(60), False)]
    binned = r.array(drilled["values"]).select("pos", K.discrete_bin(F.col("number"), bins).alias("bin")).orderBy("pos").collect()
    assert [x["bin"] for x in binned] == [0, 1, None, 2]
    rock = data_of(project, 1, 0)
    named = J.category(r.array(rock["values"]), r.array(rock["names"]), "index").orderBy("pos").collect()
    assert [x["name"] for x in named] == ["chalk", None, "clay", "chalk"]
    flat = with_vectors3(r.array(data_of(project, 1, 4)["values"])).orderBy("pos").collect()
    assert [x["vector"] and tuple(x["vector"]) for x in flat] == [None, (1, 2, 0), (3, 4, 0), None]
    image = r.image(data_of(project, 3, 0)["image"])
    assert image == PNG and images.decode_png(image).shape == (6, 3, 3)
    with pytest.raises(ValueError, match="cast"):
        as_kind(r.array(rock["attributes"][0]["data"]["values"]), "F64", "I64")
    assert as_kind(r.array(seen), "DateTime", "I64").agg(F.min("number")).first()[0] == 1451629800000000
    # boundaries are widened like numbers
    wide = as_kind(r.array(drilled["colormap"]["boundaries"]), "Date", "I64", "value").orderBy("pos").collect()
    assert [(x["value"], x["inclusive"]) for x in wide] == [((day(i) - dt.date(1970, 1, 1)).days, i == 1) for i in (1, 60)]


def test_index_tables(spark, written):
    t = ProjectReader(spark, written[0]).tables()
    assert t["projects"].first()["name"] == "Quarry"
    assert [r["element_path"] for r in t["elements"].collect()] == [*map(str, range(7)), "6/0", "6/1"]
    got = {(r["element_path"], r["attr_path"]): r for r in t["attributes"].collect()}
    assert got["1", "0/0"]["location"] == "Categories" and got["0", "0"]["item_count"] == 0
    assert all(r["item_count"] == r["location_length"] for k, r in got.items() if k != ("1", "0/0"))
    assert t["arrays"].where("kind = 'Vertex'").count() == 5
    lengths = [catalog.location_lengths(e) for _, e in catalog.elements(written[1])]
    assert lengths[0] == {"Vertices": 12, "Primitives": 6, "Projected": 0} and lengths[2] == {"Vertices": 9, "Primitives": 6, "Projected": 0}
    assert lengths[4] == {"Vertices": 32, "Primitives": 9, "Subblocks": 4, "Projected": 0} and lengths[6] == {"Elements": 2, "Projected": 0}


def at(*path):
    """A function that sets what lies at a path of the tree."""

    def put(tree, value):
        for key in path[:-1]:
            tree = tree[key]
        tree[path[-1]] = value(tree[path[-1]]) if callable(value) else value

    return put


def shorter(array):
    return array | {"item_count": array["item_count"] - 1}


def geometry_of(i, *path):
    return at("elements", i, "geometry", *path)


def attribute_of(i, j, *path):
    return at("elements", i, "attributes", j, *path)


ATTRIBUTE, ORIENT2 = "Error: 'Attribute'", "Error: 'Orient2"
STRUCTURE = [
    ("project's origin", at("origin"), [0.0, NAN, 0.0], ["Error: 'Project::origin' must be finite, inside 'Quarry'"]),
    ("points' origin", geometry_of(1, "origin"), [-INF, 0.0, 0.0], ["Error: 'PointSet::origin' must be finite, inside 'Collars'"]),
    ("two elements of a name", at("elements", 3, "name"), "Chalk", ["Warning: 'Project::elements[..]::name' contains duplicate of \"Chalk\", inside 'Quarry'"]),
    ("two attributes of a name", attribute_of(2, 1, "name"), "assay", ["Warning: 'Element::attributes[..]::name' contains duplicate of \"assay\", inside 'Traces'"]),
    ("two parts of a name", geometry_of(6, "elements", 0, "name"), "Shed", ["Warning: 'Composite::elements[..]::name' contains duplicate of \"Shed\", inside 'Buildings'"]),
    ("values too short", attribute_of(1, 2, "data", "values"), shorter, [f"{ATTRIBUTE} length 3 does not match geometry (4), inside 'flooded'"]),
    ("values of categories too short", attribute_of(1, 0, "data", "attributes", 0, "data", "values"), shorter, [f"{ATTRIBUTE} length 2 does not match geometry (3), inside 'density'"]),
    ("coordinates of a texture too short", attribute_of(3, 0, "data", "texcoords"), shorter, [f"{ATTRIBUTE} length 3 does not match geometry (4), inside 'skin'"]),
    ("no such location", attribute_of(1, 3, "location"), "Subblocks", ["Error: 'Attribute::location' is Subblocks which is not valid on PointSet geometry, inside 'dip'"]),
    ("a projected texture elsewhere", attribute_of(0, 0, "location"), "Vertices", ["Error: 'Attribute::location' is Vertices which is not valid on ProjectedTexture attributes, inside 'photo'"]),
    ("heights too short", geometry_of(0, "heights"), shorter, ["Error: 'GridSurface::heights' length 11 does not match geometry (12), inside 'Terrain'"]),
    ("an axis too short", geometry_of(0, "orient", "u"), [0.3, 0.4, 0.0], [f"{ORIENT2}::u' must be a unit vector but [0.3, 0.4, 0.0] length is 0.5, inside 'Terrain'"]),
    ("axes askew", geometry_of(0, "orient", "v"), [0.0, 1.0, 0.0], [f"{ORIENT2}' vectors are not orthogonal: [0.6, 0.8, 0.0] [0.0, 1.0, 0.0], inside 'Terrain'"]),
    ("the third axis askew", geometry_of(5, "orient", "w"), [0.0, 0.6, 0.8], ["Error: 'Orient3' vectors are not orthogonal: [0.0, 1.0, 0.0] [0.0, 0.6, 0.8], inside 'Overburden'"]),
    ("a size below zero", geometry_of(0, "grid", "size"), [25.0, -1.0], ["Error: 'Grid2::Regular::size' must be greater than zero, inside 'Terrain'"]),
    ("a size that is no number", geometry_of(0, "grid", "size"), [NAN, 1.0], ["Error: 'Grid2::Regular::size' must be finite, inside 'Terrain'"]),
    ("no rows in a grid", geometry_of(5, "grid", "count"), [1, 0, 3], ["Error: 'Grid3::Regular::count' must be greater than zero, inside 'Overburden'", f"{ATTRIBUTE} length 3 does not match geometry (0), inside 'seen'"]),
    ("too many cells", geometry_of(4, "grid", "w", "item_count"), 2**32, [f"Error: 'Grid3::Tensor' grid count [3, 3, {2**32}] exceeds maximum of {2**32 - 1}, inside 'Chalk'"]),
    ("no power of two", geometry_of(4, "subblocks", "count"), [4, 3, 1], ["Error: 'Subblocks::Regular::count' sub-block counts [4, 3, 1] must be powers of two, inside 'Chalk'"]),
    ("too few colors of categories", attribute_of(1, 0, "data", "gradient"), shorter, ["Error: 'AttributeData::Category::colors' length 2 does not match geometry (3), inside 'rock'"]),
    ("too few colors of a colormap", attribute_of(1, 1, "data", "colormap", "gradient"), shorter, ["Error: 'NumberColormap::Discrete::gradient' length 2 does not match geometry (3), inside 'drilled'"]),
    ("a range turned round", attribute_of(2, 0, "data", "colormap", "range"), {"min": 5.0, "max": 1.0}, ["Error: 'NumberColormap::Continuous::range' minimum is greater than maximum in [5.0, 1.0], inside 'assay'"]),
    ("a range without an end", attribute_of(2, 0, "data", "colormap", "range"), {"min": 5.0, "max": INF}, ["Error: 'NumberColormap::Continuous::max' must be finite, inside 'assay'"]),
    ("a texture without width", attribute_of(0, 0, "data", "width"), 0.0, ["Error: 'AttributeData::ProjectedTexture::width' must be greater than zero, inside 'photo'"]),
    ("a texture without end", attribute_of(0, 0, "data", "height"), INF, ["Error: 'AttributeData::ProjectedTexture::height' must be finite, inside 'photo'"]),
]


class Pointers:
    """Stands for a writer where only the tree matters."""

    def __init__(self):
        self.names = set()

    def array(self, kind, variant, data):
        self.names.add(f"{len(self.names)}.parquet")
        return {"filename": f"{len(self.names) - 1}.parquet", "item_count": len(data)}

    def image(self, data):
        self.names.add("x.png")
        return {"filename": "x.png", "item_count": 0}


def sound():
    w = Pointers()
    return quarry(w.array, w.image), w.names


@pytest.mark.parametrize(("put", "value", "messages"), [x[1:] for x in STRUCTURE], ids=[x[0] for x in STRUCTURE])
def test_structure(put, value, messages):
    tree, names = sound()
    assert catalog.check_tree(tree, names)[0] == []
    put(tree, value)
    assert [str(p) for p in catalog.check_tree(tree, names)[0]] == messages


def test_quotes_and_the_first_axes_only():
    tree, names = sound()
    for i in (2, 3, 4):
        tree["elements"][i]["name"] = 'say "x"\\'
    geometry_of(5, "orient")(tree, {"origin": [0.0, 0.0, 0.0], "w": [0.0, 0.6, 0.8]})
    found = [str(p) for p in catalog.check_tree(tree, names, compat=True)[0]]
    assert found == ["Warning: 'Project::elements[..]::name' contains duplicate of \"say \\\"x\\\"\\\\\", inside 'Quarry'"]
    names.discard("0.parquet")
    assert any("refers to non-existent archive member '0.parquet'" in str(p) for p in catalog.check_tree(tree, names)[0])


def one(kind, variant, rows, geometry):
    """A project of one element with one array that has a fault."""
    return lambda a: B.project("Faults", [geometry(a, a(kind, variant, rows))], date=dt.datetime(2021, 1, 1, tzinfo=dt.timezone.utc))


def points(a, n=3):
    return a("Vertex", "F32", [(i, 0, 0) for i in range(n)])


def blocks(subblocks):
    return B.element("cells", B.block_model(B.orient(), B.regular_grid([1, 1, 1], [2, 2, 2]), subblocks))


def regular(mode, *rows):
    return one("RegularSubblock", "U32U32", rows, lambda a, x: blocks(B.regular_subblocks([4, 4, 4], x, mode)))


def freeform(*rows):
    return one("FreeformSubblock", "U32F32", rows, lambda a, x: blocks(B.freeform_subblocks(x)))


SUB = "'Subblocks::Regular::subblocks'"
CONTENTS = [
    ("segments", one("Segment", "U32", [(0, 1), (1, 3), (2, 1)], lambda a, x: B.element("line", B.line_set(points(a), x))), ["'LineSet::segments'", "index value 3 exceeds the maximum index 2"]),
    ("triangles", one("Triangle", "U32", [(0, 1, 2), (7, 1, 2)], lambda a, x: B.element("skin", B.surface(points(a), x))), ["'Surface::triangles'", "index value 7 exceeds the maximum index 2"]),
    ("categories", one("Index", "U32", [None, 1, 2], lambda a, x: B.element("p", B.point_set(points(a)), [B.attribute("c", "Vertices", B.categories(x, a("Name", "String", ["only", "two"])))])), ["'AttributeData::Category::values'", "index value 2 exceeds the maximum index 1"]),
    ("sizes", one("Scalar", "F64", [1.0, -0.5], lambda a, x: B.element("g", B.grid_surface(B.orient(), B.tensor_grid(x, a("Scalar", "F64", [1.0]))))), ["'Grid2::Tensor::u'", "size value -0.5 is zero or less"]),
    ("boundaries", one("Boundary", "I64", [(1, True), (1, False), (0, True)], lambda a, x: B.element("p", B.point_set(points(a)), [B.attribute("n", "Vertices", B.numbers(a("Number", "I64", [1, 2, 3]), B.discrete_colormap(x, a("Gradient", "Rgba8", [(0, 0, 0, 0)] * 4))))])), ["'NumberColormap::Discrete::boundaries'", "discrete colormap boundary decreases"]),
    ("parents", regular(None, (0, 0, 0, 0, 0, 0, 1, 1, 1), (1, 2, 0, 0, 0, 0, 1, 1, 1)), [SUB, "block index [1, 2, 0] exceeds the maximum index [1, 1, 1]"]),
    ("a flat sub-block", regular(None, (0, 0, 0, 1, 1, 1, 2, 1, 2)), [SUB, "sub-block [1, 1, 1] to [2, 1, 2] has zero or negative size"]),
    ("a sub-block too long", regular(None, (0, 0, 0, 1, 1, 1, 2, 5, 2)), [SUB, "sub-block [1, 1, 1] to [2, 5, 2] exceeds the maximum [4, 4, 4]"]),
    ("an octree's", regular("Octree", (0, 0, 0, 1, 0, 0, 3, 2, 2)), [SUB, "sub-block [1, 0, 0] to [3, 2, 2] is invalid for Octree mode"]),
    ("a full one's", regular("Full", (0, 0, 0, 0, 0, 0, 2, 2, 2)), [SUB, "sub-block [0, 0, 0] to [2, 2, 2] is invalid for Full mode"]),
    ("free-form outside", freeform((0, 0, 0, 0.0, 0.0, 0.5, 1.0, 1.0, 1.5)), ["'Subblocks::Freeform::subblocks'", "sub-block [0.0, 0.0, 0.5] to [1.0, 1.0, 1.5] is outside the valid range of 0.0 to 1.0"]),
    ("free-form turned round", freeform((1, 1, 1, 0.5, 0.0, 0.0, 0.25, 1.0, 1.0)), ["'Subblocks::Freeform::subblocks'", "sub-block [0.5, 0.0, 0.0] to [0.25, 1.0, 1.0] has zero or negative size"]),
]


@pytest.mark.parametrize(("make", "parts"), [x[1:] for x in CONTENTS], ids=[x[0] for x in CONTENTS])
def test_contents(spark, tmp_path, make, parts):
    """What is wrong in an array is told on writing, in a report on what was read, and by reading the array."""
    where, reason = parts
    path = str(tmp_path / "faults.zip")
    w = ProjectWriter(spark, path)
    tree = make(w.array)
    (problem,) = w.problems(tree)
    assert str(problem).startswith(f"Error: {where} array contains invalid data: {reason}, inside '")
    w.file.close(tree)
    r = ProjectReader(spark, path)
    assert [str(p) for p in r.problems()] == [str(problem)]
    (use,) = [u for u in r._uses if f"'{u.type}::{u.field}'" == where]
    pointer = use.array.to_json()
    with pytest.raises(Exception, match=re.escape(str(problem))):
        r.array(pointer).collect()
    rows = r.array(pointer, check=False).collect()
    assert len(rows) == use.array.item_count
    v = ProjectWriter(spark, str(tmp_path / "none.zip"))
    with pytest.raises(catalog.ValidationFailed):
        v.finish(make(v.array))
    assert not (tmp_path / "none.zip").exists()


def test_dataframe_arrays_and_compression(spark, tmp_path):
    df = spark.range(50_000).select(F.col("id").alias("pos"), (F.col("id") % 97).cast("double").alias("scalar")).repartition(7)
    sizes = {}
    for level in (0, 9):
        w = ProjectWriter(spark, str(tmp_path / f"{level}.zip"), compression=level)
        a = w.array("Scalar", "F64", df)
        tree = {"name": "p", "date": "2020-01-01T00:00:00Z", "elements": [{"name": "g", "geometry": {"type": "BlockModel", "orient": {"origin": [0, 0, 0]}, "grid": {"type": "Tensor", "u": a, "v": a, "w": a}}}]}
        with pytest.raises(catalog.ValidationFailed, match="size value 0 is zero or less"):
            w.finish(tree)
        w = ProjectWriter(spark, str(tmp_path / f"{level}.zip"), compression=level)
        a = w.array("Scalar", "F64", df.withColumn("scalar", F.col("scalar") + 1))
        tree["elements"][0]["geometry"]["grid"] = {"type": "Tensor", "u": a, "v": a, "w": a}
        w.finish(tree)
        r = ProjectReader(spark, str(tmp_path / f"{level}.zip"))
        got = r.array(a)
        assert got.where("scalar <> pos % 97 + 1").count() == 0 and got.count() == 50_000
        sizes[level] = r.file.compressed_size(r.pointer(a))
    assert sizes[9] < sizes[0]


def rewritten(path, out, comment=None, drop=(), change=None, method=zipfile.ZIP_STORED):
    with zipfile.ZipFile(path) as a, zipfile.ZipFile(out, "w") as b:
        for i in a.infolist():
            if i.filename not in drop:
                data = a.read(i)
                if change and i.filename == container.INDEX:
                    data = gzip.compress(json.dumps(change(json.loads(gzip.decompress(data)))).encode())
                b.writestr(zipfile.ZipInfo(i.filename), data, method)
        b.comment = a.comment if comment is None else comment
    return str(out)


def test_damaged_containers(spark, written, tmp_path):
    path, project = written
    with pytest.raises(container.ContainerError, match="Zip error"):
        bad = tmp_path / "x"
        bad.write_bytes(b"nothing")
        container.Reader(str(bad))
    for comment, message in ((b"something", "zip comment"), (b"x 2.0.1", "zip comment"), (b"\xff", "zip comment"), (b"x 2.1", "only read"), (b"x 2.0-alpha.7", "pre-release"), (b"x 3.0", "only read")):
        with pytest.raises(container.ContainerError, match=message):
            container.Reader(rewritten(path, tmp_path / "c.zip", comment))
    assert container.Reader(rewritten(path, tmp_path / "c.zip", b"any name 1.9")).version == (1, 9)
    with pytest.raises(container.MemberMissing):
        container.Reader(rewritten(path, tmp_path / "d.zip", drop=[container.INDEX]))
    with pytest.raises(container.ContainerError, match="compressed"):
        container.Reader(rewritten(path, tmp_path / "e.zip", method=zipfile.ZIP_DEFLATED))
    with pytest.raises(catalog.ValidationFailed, match="refers to non-existent archive member '1.parquet'"):
        ProjectReader(spark, rewritten(path, tmp_path / "f.zip", drop=["1.parquet"]))

    def longer(p):
        p["elements"][3]["geometry"]["triangles"]["item_count"] = 999
        return p

    r = ProjectReader(spark, rewritten(path, tmp_path / "g.zip", change=longer))
    with pytest.raises(container.ContainerError, match="array length 999 does not match the declared length 4"):
        r.array(r.project["elements"][3]["geometry"]["triangles"])


def test_limits(spark, written):
    path, project = written
    n = len(json.dumps(project, separators=(",", ":")).encode())
    for most in (0, 10, n):
        with pytest.raises(container.LimitExceeded):
            ProjectReader(spark, path, container.Limits(json_bytes=most))
    r = ProjectReader(spark, path, container.Limits(json_bytes=n + 1, image_dim=4))
    with pytest.raises(container.LimitExceeded):
        r.image(data_of(project, 3, 0)["image"])
    problems = [catalog.Problem("T", None, str(i), warning=i % 2 == 1) for i in range(9)]
    assert [str(p) for p in catalog.limited(problems, 3)][3:] == ["Error: '' 3 more errors", "Warning: '' 3 more warnings"]


@pytest.mark.parametrize("limit", [None, 0, 3, 100, 120, 200])
def test_sub_blocks_invalid_for_their_mode_are_shown_to_the_limit_and_counted(spark, limit):
    rows = [(i, 0, 0, 0, i, 0, 0, i + 2, 1, 1) for i in range(120)]
    df = spark.createDataFrame(rows, ["pos", *kinds.KINDS["RegularSubblock"]["U32U32"].names])
    use = catalog.Use(kinds.Array("RegularSubblock", "x", len(rows)), "T", "f", None, {"blocks": [1, 1, 1], "cells": [128, 128, 128], "mode": "Full"})
    got = [str(p) for p in catalog.limited(array_problems(df, use, limit), limit)]
    shown = 120 if limit is None else min(limit, 120)
    assert sum("is invalid for Full mode" in p for p in got) == shown
    assert got[shown:] == ([f"Error: '' {120 - shown} more errors"] if shown < 120 else [])


def test_variants_are_exact(spark):
    import io

    import pyarrow.parquet as pq

    def variant(kind, schema):
        sink = io.BytesIO()
        pq.write_table(schema.empty_table(), sink)
        return kinds.variant_of(kind, pq.ParquetFile(io.BytesIO(sink.getvalue())))

    for kind, variants in kinds.KINDS.items():
        for name, schema in variants.items():
            assert variant(kind, schema) == name
    one = lambda t, null=False: pa.schema([pa.field("scalar", t, nullable=null)])
    for schema in (one(pa.int32()), one(pa.float64(), True), one(pa.float64()).append(pa.field("extra", pa.int64()))):
        with pytest.raises(kinds.SchemaMismatch):
            variant("Scalar", schema)


def test_data_source(spark, written):
    from strata.sources.datasource import register

    register(spark)
    members = spark.read.format("strata").option("path", written[0]).load()
    assert members.where("name = '1.parquet'").count() == 1
    v = written[1]["elements"][3]["geometry"]["vertices"]["filename"]
    rows = spark.read.format("strata").option("path", written[0]).option("kind", "Vertex").option("array", v).load()
    assert [tuple(r) for r in rows.orderBy("pos").collect()] == [(0, 0.0, 0.0, 0.0), (1, 9.0, 0.0, 0.0), (2, 0.0, 9.0, 0.0), (3, 0.0, 0.0, 9.0)]


def test_writer_refuses_what_is_not_an_image_or_parquet(tmp_path):
    w = container.Writer(str(tmp_path / "w.zip"), compression=99)
    assert w.compression == 9
    with pytest.raises(container.ContainerError, match="PNG or JPEG"):
        w.image(b"GIF89a")
    for data in (b"PAR1", b"PAR1xxxxxxx", b"xxxxxxxxPAR1"):
        with pytest.raises(container.ContainerError, match="Parquet"):
            w.parquet_bytes("Scalar", data)
    w.cancel()
    assert not (tmp_path / "w.zip").exists()


def test_png_filters():
    import struct
    import zlib

    pixels = np.random.default_rng(1).integers(0, 256, (6, 7, 4), dtype=np.uint8)
    assert (images.decode_png(images.encode_png(pixels)) == pixels).all()
    deep = np.random.default_rng(2).integers(0, 65536, (3, 4, 1), dtype=np.uint16)
    assert (images.decode_png(images.encode_png(deep)) == deep).all()
    raw, before = b"", np.zeros(28, int)
    for y in range(6):
        line, kind = pixels[y].reshape(-1).astype(int), y % 5
        left, corner = np.append([0] * 4, line[:-4]), np.append([0] * 4, before[:-4])
        paeth = [min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2] for a, b, c in zip(left, before, corner)]
        guess = (0 * line, left, before, (left + before) // 2, np.array(paeth))[kind]
        raw += bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes()
        before = line
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 6, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    assert (images.decode_png(png) == pixels).all() and images.size(png) == (7, 6)


def png_of(head, body, *others):
    import struct
    import zlib

    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", *head)) + b"".join(chunk(*o) for o in others) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def test_png_of_few_bits_palette_transparency_and_interlace():
    import struct

    rng = np.random.default_rng(5)
    for depth in (1, 2, 4):
        level = rng.integers(0, 1 << depth, (5, 11))
        bits = (level[..., None] >> np.arange(depth)[::-1]) & 1
        rows = np.packbits(bits.reshape(5, -1).astype(np.uint8), axis=1)
        body = b"".join(b"\0" + r.tobytes() for r in rows)
        assert (images.decode_png(png_of((11, 5, depth, 0, 0, 0, 0), body))[..., 0] == level * 255 // ((1 << depth) - 1)).all()
        colors = rng.integers(0, 256, (1 << depth, 3), dtype=np.uint8)
        got = images.decode_png(png_of((11, 5, depth, 3, 0, 0, 0), body, (b"PLTE", colors.tobytes()), (b"tRNS", b"\x07")))
        assert (got[..., :3] == colors[level]).all() and (got[..., 3] == np.where(level == 0, 7, 255)).all()
        if level.max() > 0:
            with pytest.raises(container.ContainerError, match="palette"):
                images.decode_png(png_of((11, 5, depth, 3, 0, 0, 0), body, (b"PLTE", colors[:1].tobytes())))
    pixels = rng.integers(0, 256, (2, 3, 3), dtype=np.uint8)
    body = b"".join(b"\0" + r.tobytes() for r in pixels.reshape(2, -1))
    got = images.decode_png(png_of((3, 2, 8, 2, 0, 0, 0), body, (b"tRNS", struct.pack(">3H", *pixels[1, 2].tolist()))))
    assert (got[..., :3] == pixels).all() and got[1, 2, 3] == 0 and (got[..., 3] > 0).sum() == 5
    # each pass of an interlaced image is an image of its own; small ones have no pixel in some passes
    for height, width in ((9, 13), (1, 1), (3, 2)):
        pixels = rng.integers(0, 65536, (height, width, 2), dtype=np.uint16)
        body = b""
        for x, y, dx, dy in images._PASSES:
            part = pixels[y::dy, x::dx]
            if part.size:
                body += b"".join(b"\0" + r.astype(">u2").tobytes() for r in part)
        assert (images.decode_png(png_of((width, height, 16, 4, 0, 0, 1), body)) == pixels).all()
        with pytest.raises(container.ContainerError, match="cut short"):
            images.decode_png(png_of((width, height, 16, 4, 0, 0, 1), body[:-1]))
    for head in ((1, 1, 3, 0, 0, 0, 0), (1, 1, 4, 2, 0, 0, 0), (1, 1, 16, 3, 0, 0, 0), (1, 1, 8, 5, 0, 0, 0)):
        with pytest.raises(container.ContainerError, match="decoded"):
            images.decode_png(png_of(head, b"\0\0"))
    with pytest.raises(container.ContainerError, match="filter"):
        images.decode_png(png_of((1, 1, 8, 0, 0, 0, 0), b"\x09\0"))


def test_a_writer_at_a_uri_and_from_open_files(spark, written, tmp_path):
    uri = (tmp_path / "there.zip").as_uri()
    w = container.Writer(uri)
    picture = tmp_path / "p.png"
    picture.write_bytes(PNG)
    table = tmp_path / "t.parquet"
    pa.parquet.write_table(pa.table({"scalar": [1.5, 2.5]}, schema=kinds.KINDS["Scalar"]["F64"]), table)
    with open(picture, "rb") as p, open(table, "rb") as t:
        image, scalar = w.image(p), w.parquet_bytes("Scalar", t)
    w.close({"name": "there"})
    assert scalar.item_count == 2
    r = container.Reader(uri)
    assert r.bytes(image.filename) == PNG and r.index() == {"name": "there"}
    assert r.bytes(scalar.filename) == table.read_bytes()
    with zipfile.ZipFile(tmp_path / "there.zip") as z:
        assert z.testzip() is None
    gone = container.Writer((tmp_path / "gone.zip").as_uri())
    gone.image(PNG)
    gone.cancel()
    assert not (tmp_path / "gone.zip").exists()
    # a whole project
    p = ProjectWriter(spark, (tmp_path / "quarry.zip").as_uri())
    project = quarry(p.array, p.image)
    assert p.finish(project) == []
    again = ProjectReader(spark, (tmp_path / "quarry.zip").as_uri())
    assert again.project == project and again.problems() == []
    assert again.pixels(data_of(project, 3, 0)["image"]).tolist() == np.arange(54).reshape(6, 3, 3).tolist()


def test_places_of_attributes(written):
    places = [catalog.valid_locations(e) for e in written[1]["elements"]]
    both = ["Vertices", "Primitives"]
    assert places == [both, ["Vertices"], both, both, ["Subblocks", "Primitives"], ["Subblocks", "Primitives"], ["Elements"]]
    assert catalog.valid_locations({"geometry": {"type": "BlockModel"}}) == ["Primitives"]


def test_bounds_belong_to_a_kind():
    for kind, bounds in (("Segment", {}), ("Name", {"count": 1}), ("RegularSubblock", {"blocks": [1, 1, 1]}), ("FreeformSubblock", {"blocks": [1, 1, 1], "mode": None})):
        with pytest.raises(TypeError, match=kind):
            catalog.Use(kinds.Array(kind, "x", 1), "T", "f", None, bounds)


def test_metadata_and_overlaps(spark):
    from strata.functions import casts as C
    from strata.operators import validate as V

    rows = spark.createDataFrame([('{"none": null, "depth": [1, 2.5], "by": {"crew": "B"}}',), ("",), ("{",), (None,)], "m string")
    got = rows.select(C.metadata(F.col("m"), "$.by.crew"), C.metadata(F.col("m"), "$.depth[1]", "double"), C.metadata(F.col("m"), "$.none"), C.metadata(F.col("m"), "$.by", "int")).collect()
    assert [tuple(r) for r in got] == [("B", 2.5, None, None)] + [(None,) * 4] * 3
    names = ["u", "a", "b", "c", "d"]
    boxes = [(0, 0, 0, 2, 2), (0, 1, 1, 3, 2), (0, 2, 0, 4, 1), (1, 0, 0, 2, 2), (1, 0, 0, 0, 2), (2, 0, 0, 1, 1), (2, 0, 0, 1, 1), (2, 0, 0, 1, 1), (3, None, 0, 1, 1)]
    shared = V.shared_cells(spark.createDataFrame(boxes, "u int, a int, b int, c int, d int"), ["u"], names[1:3], names[3:])
    assert sorted(map(tuple, shared.collect())) == [(0, 1, 1, 2), (2, 0, 0, 3)]
    bare = J.surface_vertices(spark.createDataFrame([(0, 2.0, 3.0)], "pos long, x double, y double"), None, [1.0, 1.0, 1.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0])
    assert tuple(bare.first()) == (0, 1.0, 3.0, 4.0)


def test_data_source_reads_all_kinds_and_variants(spark, tmp_path):
    from strata.sources.datasource import register

    register(spark)
    sample = {"float": 1.5, "double": 1.5, "int64": 7, "uint32": 7, "uint8": 7, "string": "s", "bool": True, "date32[day]": dt.date(2020, 1, 2)}

    def value(t):
        if pa.types.is_struct(t):
            return {f.name: value(f.type) for f in t}
        return dt.datetime(2020, 1, 2, tzinfo=dt.timezone.utc) if pa.types.is_timestamp(t) else sample[str(t)]

    path = str(tmp_path / "kinds.omf")
    w, made = container.Writer(path), []
    for kind, variants in kinds.KINDS.items():
        for variant, schema in variants.items():
            row = {f.name: value(f.type) for f in schema}
            made.append((w.batches(kind, variant, pa.Table.from_pylist([row], schema=schema).to_batches()), list(row)))
    w.close({"name": "p"})
    for array, names in made:
        got = spark.read.format("strata").option("path", path).option("array", array.filename).option("kind", array.kind).load()
        assert got.columns == ["pos", *names]
        assert [r["pos"] for r in got.collect()] == [0]
