"""Version 1 files, made here, and their conversion."""

import json
import struct
import uuid
import zlib

import numpy as np
import pytest

from strata.sources import container, images, v1
from strata.sources.project import ProjectReader

ROOT = str(uuid.UUID(int=7))
PNG = images.encode_png(np.zeros((2, 2, 3), np.uint8))


class File:
    def __init__(self):
        self.data, self.objects = b"", {}

    def put(self, kind, key=None, **o):
        key = key or str(uuid.UUID(int=1000 + len(self.objects)))
        self.objects[key] = {"__class__": kind, "date_created": "2019-05-01T10:00:00Z", **o}
        return key

    def blob(self, data, dtype):
        packed = zlib.compress(data)
        at = 60 + len(self.data)
        self.data += packed
        return {"start": at, "length": len(packed), "dtype": dtype}

    def array(self, kind, values, dtype="<f8"):
        return self.put(kind, array=self.blob(np.array(values, dtype).tobytes(), dtype))

    def write(self, path, version=b"ABC-v0.9.0", magic=v1.MAGIC):
        head = magic + version.ljust(32, b"\0") + uuid.UUID(ROOT).bytes + struct.pack("<Q", 60 + len(self.data))
        path.write_bytes(head + self.data + json.dumps(self.objects).encode())
        return str(path)


def full():
    f = File()
    vertices = lambda: f.array("Vector3Array", [[0, 0, 0], [1, 0, 0], [1, 1, 0], [0, 1, 0]])
    nan = float("nan")
    data = lambda kind, location, array, **o: f.put(kind, name=kind, location=location, array=array, **o)
    gradient = f.put("ColorArray", array=[[0, 0, 255], [255, 0, 0]])
    legends = [
        f.put("Legend", name="short", values=f.put("StringArray", array=["a", "b"])),
        f.put("Legend", name="long", description="d", values=f.put("StringArray", array=["aa", "bb"])),
        f.put("Legend", name="colors", values=gradient),
        f.put("Legend", name="numbers", values=f.array("ScalarArray", [1.5])),
    ]
    points = f.put("PointSetElement", name="points", color=[1, 2, 3], subtype="collar", geometry=f.put("PointSetGeometry", origin=[5, 0, 0], vertices=vertices()), data=[
        data("ScalarData", "vertices", f.array("ScalarArray", [1, nan, 3, 4]), colormap=f.put("ScalarColormap", gradient=gradient, limits=[0, 5])),
        data("ScalarData", "vertices", f.array("ScalarArray", [1, 2, 3, 4], "<i8")),
        data("DateTimeData", "vertices", f.put("DateTimeArray", array=["2020-01-01T00:00:00Z", None, "2020-01-02T00:00:00Z", None])),
        data("Vector2Data", "vertices", f.array("Vector2Array", [[1, 2], [nan, 2], [3, 4], [5, 6]])),
        data("ColorData", "vertices", f.array("Int3Array", [[-5, 10, 300], [1, 2, 3], [0, 0, 0], [255, 255, 255]], "<i8")),
        data("StringData", "vertices", f.put("StringArray", array=["x", "", "y", ""])),
        data("MappedData", "vertices", f.array("ScalarArray", [0, -1, 3, 1], "<i8"), legends=legends),
    ], textures=[f.put("ImageTexture", name="t", axis_u=[2, 0, 0], axis_v=[0, 0, 0.5], image=f.blob(PNG, "image/png"))])
    lines = f.put("LineSetElement", name="lines", geometry=f.put("LineSetGeometry", vertices=vertices(), segments=f.array("Int2Array", [[0, 1], [2, 3]], "<i8")), data=[data("Vector3Data", "segments", f.array("Vector3Array", [[1, 2, 3], [4, 5, 6]]))])
    surface = f.put("SurfaceElement", name="surface", geometry=f.put("SurfaceGeometry", vertices=vertices(), triangles=f.array("Int3Array", [[0, 1, 2]], "<i8")))
    grid = f.put("SurfaceElement", name="grid", geometry=f.put("SurfaceGridGeometry", tensor_u=[1, 1], tensor_v=[2], axis_u=[0, 1, 0], axis_v=[1, 0, 0], offset_w=f.array("ScalarArray", range(6))))
    volume = f.put("VolumeElement", name="volume", geometry=f.put("VolumeGridGeometry", tensor_u=[1, 2], tensor_v=[1], tensor_w=[1, 1, 1]), data=[data("ScalarData", "cells", f.array("ScalarArray", range(6)))])
    f.put("Project", ROOT, name="old", author="someone", units="m", revision="3", elements=[points, lines, surface, grid, volume])
    return f


def test_conversion(spark, tmp_path):
    source, target = full().write(tmp_path / "old"), str(tmp_path / "new.zip")
    assert v1.detect(source)
    warnings = v1.Converter(spark).convert(source, target)
    assert [p.reason for p in warnings] == ['contains duplicate of "ScalarData"']
    assert not v1.detect(target)
    r = ProjectReader(spark, target)
    assert r.problems() == []
    p = r.project
    assert (p["name"], p["author"], p["units"], p["date"]) == ("old", "someone", "m", "2019-05-01T10:00:00Z")
    assert p["metadata"]["revision"] == "3" and p["metadata"]["Version 1 conversion"]["from"].endswith("-v0.9.0")
    values = lambda a, c: [x[c] for x in r.array(a).orderBy("pos").collect()]
    points, lines, surface, grid, volume = p["elements"]
    assert points["metadata"]["subtype"] == "collar" and lines["metadata"]["subtype"] == "line" and points["color"] == [1, 2, 3, 255]
    a = [x["data"] for x in points["attributes"]]
    assert values(a[0]["values"], "number") == [1, None, 3, 4] and a[0]["colormap"]["range"] == {"min": 0, "max": 5}
    assert r.variant(a[1]["values"]) == "I64" and [x is None for x in values(a[2]["values"], "number")] == [False, True, False, True]
    assert [x and tuple(x) for x in values(a[3]["values"], "vector")] == [(1, 2), None, (3, 4), (5, 6)]
    assert tuple(values(a[4]["values"], "color")[0]) == (0, 10, 255, 255)
    assert values(a[5]["values"], "text") == ["x", None, "y", None]
    assert values(a[6]["values"], "index") == [0, None, 3, 1] and values(a[6]["names"], "name") == ["aa", "bb", "", ""]
    assert [(x["r"], x["a"]) for x in r.array(a[6]["gradient"]).orderBy("pos").collect()] == [(0, 255), (255, 255), (128, 255), (128, 255)]
    assert [x["name"] for x in a[6]["attributes"]] == ["short", "numbers"]
    assert values(a[6]["attributes"][1]["data"]["values"], "number") == [1.5, None, None, None]
    t = a[7]
    assert (t["width"], t["height"], t["orient"]["v"]) == (2.0, 0.5, [0.0, 0.0, 1.0]) and r.image(t["image"]) == PNG
    assert lines["attributes"][0]["location"] == "Primitives" and values(surface["geometry"]["triangles"], "c") == [2]
    assert values(grid["geometry"]["heights"], "scalar") == [0, 1, 2, 3, 4, 5] and volume["geometry"]["grid"]["w"]["item_count"] == 3


def test_errors(spark, tmp_path):
    f = full()
    for version, magic, message in ((b"ABC-v0.8.0", v1.MAGIC, "supported"), (b"xyz", v1.MAGIC, "version 1"), (b"ABC-v0.9.0", b"PK\x03\x04", "version 1")):
        with pytest.raises(v1.V1Error, match=message):
            v1.V1Reader(f.write(tmp_path / "x", version, magic))
    (tmp_path / "s").write_bytes(b"abc")
    with pytest.raises(OSError):
        v1.detect(str(tmp_path / "s"))
    with pytest.raises(container.LimitExceeded):
        v1.V1Reader(f.write(tmp_path / "x"), container.Limits(json_bytes=10))
    for change, message in ((lambda o: o.pop(next(k for k, x in o.items() if x["__class__"] == "LineSetGeometry")), "missing item"), (lambda o: next(x for x in o.values() if x["__class__"] == "LineSetGeometry").update(__class__="PointSetGeometry"), "not LineSetGeometry")):
        g = full()
        change(g.objects)
        with pytest.raises(v1.V1Error, match=message):
            v1.Converter(spark).convert(g.write(tmp_path / "y"), str(tmp_path / "z"))
        assert not (tmp_path / "z").exists()
    for bad in ([-2.0], [0.5], [2.0**33]):
        with pytest.raises(v1.V1Error):
            v1.category_indices(np.array(bad))
    g = File()
    key = g.put("ScalarArray", array=g.blob(b"\0" * 12, "<f8"))
    g.put("Project", ROOT, name="p", elements=[])
    with pytest.raises(ValueError):
        v1.V1Reader(g.write(tmp_path / "q")).numbers(key, 1)


def test_legends():
    strings = [("a", "", "strings", ["x", "y"]), ("b", "", "strings", ["xx", "y"]), ("c", "", "strings", ["yy", "x"])]
    length, names, colors, others = v1.pick_legends(strings, 4)
    assert (length, names, colors, [o[0] for o in others]) == (5, ["yy", "x"], None, ["a", "b"])
    assert v1.pick_legends(strings, 4, compat=True)[0] == 4
    assert v1.pick_legends([], 2)[1] == ["Category0", "Category1", "Category2"] and v1.pick_legends([], None)[0] == 0
    assert v1.projection_axis([0, 0, 0]) == ([0.0, 0.0, 0.0], 0)
