"""Reading files of format version 1 and converting them.

A file is a header of 60 bytes, compressed arrays, and a JSON map from ids to objects. Objects refer to each other by id. The map is small and is walked
on the driver; arrays are inflated one at a time and written as members of the new container.
"""

from __future__ import annotations

import datetime as dt
import json
import math
import re
import struct
import uuid
import zlib

import numpy as np
from pyspark.sql import SparkSession

from .catalog import Problem
from .container import ContainerError, LimitExceeded, Limits, _filesystem
from .project import ProjectWriter

# The header's first bytes, and what follows them: a name of capitals and the version.
MAGIC = bytes([0x84, 0x83, 0x82, 0x81])
VERSION = re.compile(r"[A-Z]+-v0\.9\.0")
GRAY = (128, 128, 128, 255)
_TYPES = {"<f8": np.dtype("<f8"), "<i8": np.dtype("<i8")}
_LOCATIONS = {"vertices": "Vertices", "segments": "Primitives", "faces": "Primitives", "cells": "Primitives"}


class V1Error(ContainerError):
    pass


def detect(path: str) -> bool:
    """Whether a file looks like version 1. A file too short to tell is an error."""
    fs, at = _filesystem(path)
    with fs.open_input_file(at) as f:
        head = f.read(8)
    if len(head) < 8:
        raise OSError("failed to fill whole buffer")
    return head[:4] == MAGIC and re.fullmatch(rb"[A-Z]+-", head[4:8]) is not None


class V1Reader:
    def __init__(self, path: str, limits: Limits | None = None):
        fs, at = _filesystem(path)
        self._file = fs.open_input_file(at)
        head = self._file.read(60)
        text = head[4:36].rstrip(b"\0").decode(errors="replace")
        if len(head) < 60 or head[:4] != MAGIC or not re.match(r"[A-Z]+-", text):
            raise V1Error("this isn't a file of version 1")
        if not VERSION.fullmatch(text):
            raise V1Error(f"version '{text}' isn't supported")
        self.version, self.root = text, str(uuid.UUID(bytes=head[36:52]))
        (start,) = struct.unpack("<Q", head[52:60])
        size = self._file.size()
        most = (limits or Limits()).json_bytes
        if most is not None and size - start > most:
            raise LimitExceeded("Error: safety limit exceeded")
        self._file.seek(start)
        try:
            self.objects = json.loads(self._file.read())
        except ValueError as e:
            raise V1Error(f"JSON deserialization error: {e}") from e

    def get(self, key: str, *classes: str) -> dict:
        """The object of an id, which must be of one of the classes."""
        if key not in self.objects:
            raise V1Error(f"missing item '{key}'")
        found = self.objects[key]
        if classes and found.get("__class__") not in classes:
            raise V1Error(f"item '{key}' is {found.get('__class__')}, not {' or '.join(classes)}")
        return found

    def blob(self, pointer: dict) -> bytes:
        self._file.seek(pointer["start"])
        return zlib.decompress(self._file.read(pointer["length"]))

    def numbers(self, key: str, width: int, *classes: str) -> np.ndarray:
        """An array of width columns. A last row that isn't whole is an error."""
        pointer = self.get(key, *classes)["array"]
        if pointer["dtype"] not in _TYPES:
            raise V1Error(f"data type {pointer['dtype']} isn't supported")
        flat = np.frombuffer(self.blob(pointer), _TYPES[pointer["dtype"]])
        if flat.size % width:
            raise V1Error(f"array '{key}' is cut short")
        return flat.reshape(-1, width) if width > 1 else flat


def category_indices(values: np.ndarray) -> list[int | None]:
    """-1 as null; anything else must be a whole number from 0 up to 32 bits."""
    if values.dtype.kind == "f" and not (np.floor(values) == values).all():
        raise V1Error("category indices must be whole numbers")
    if len(values) and ((values < -1) | (values > 2**32 - 1)).any():
        raise V1Error("category index out of range")
    return [None if v == -1 else int(v) for v in values]


def pick_legends(legends: list[tuple[str, str, str, list]], most: int | None, compat: bool = False):
    """(length, names, colors, others) of a category's legends (name, description, kind, values).

    Names are those of the string legend with most different names that aren't empty, then the longest text, then the last; colors those of the color legend with most
    different colors, then the last. The table reaches from 0 to the largest index, or one less with compat, and as far as the longest legend.
    """
    used = 0 if most is None else most if compat else most + 1
    length = max([len(v) for *_, v in legends] + [used])
    score = {
        "strings": lambda v: (len({s for s in v if s}), sum(len(s.encode()) for s in v)),
        "colors": lambda v: (len({tuple(c) for c in v}), 0),
    }
    best = {kind: max(((*f(v), i) for i, (*_, k, v) in enumerate(legends) if k == kind), default=None) for kind, f in score.items()}
    chosen = {kind: b[-1] for kind, b in best.items() if b}
    names = legends[chosen["strings"]][3] if "strings" in chosen else [f"Category{i}" for i in range(length)]
    colors = legends[chosen["colors"]][3] if "colors" in chosen else None
    return length, names, colors, [x for i, x in enumerate(legends) if i not in chosen.values()]


def padded(values: list, length: int, default) -> list:
    return list(values[:length]) + [default] * (length - len(values))


class Converter:
    """Writes a version 1 file as a container."""

    def __init__(self, spark: SparkSession, limits: Limits | None = None, compression: int = 6, compat: bool = False):
        self.spark, self.limits, self.compression, self.compat = spark, limits or Limits(), compression, compat

    def convert(self, source: str, target: str) -> list[Problem]:
        """Warnings; errors raise and leave no file."""
        r = V1Reader(source, self.limits)
        w = ProjectWriter(self.spark, target, self.compression)
        try:
            tree = _Project(r, w, self.compat).project()
        except Exception:
            w.cancel()
            raise
        return w.finish(tree)


def _color(c) -> list[int]:
    return [*(max(0, min(255, int(x))) for x in c), 255]


def _time(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text.replace("Z", "+00:00"))


class _Project:
    def __init__(self, r: V1Reader, w: ProjectWriter, compat: bool):
        self.r, self.w, self.compat = r, w, compat

    @staticmethod
    def meta(o: dict) -> dict:
        return {k: o[k] for k in ("date_created", "date_modified") if o.get(k)}

    def head(self, o: dict) -> dict:
        return {k: v for k, v in (("name", o.get("name", "")), ("description", o.get("description", "")), ("metadata", self.meta(o))) if v or k == "name"}

    def project(self) -> dict:
        o = self.r.get(self.r.root, "Project")
        now = dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        extra = {k: o[k] for k in ("revision", "date") if o.get(k)}
        try:
            _time(o.get("date_created", ""))
            date = o["date_created"]
        except ValueError:
            date = now
        out = self.head(o) | {k: o[k] for k in ("units", "author") if o.get(k)}
        out |= {"date": date, "origin": o.get("origin", [0.0, 0.0, 0.0])}
        out["metadata"] = self.meta(o) | extra | {"Version 1 conversion": {"from": self.r.version, "by": "strata", "on": now}}
        out["elements"] = [self.element(k) for k in o.get("elements", [])]
        return out

    def element(self, key: str) -> dict:
        o = self.r.get(key, "PointSetElement", "LineSetElement", "SurfaceElement", "VolumeElement")
        kind = o["__class__"].removesuffix("Element")
        out = self.head(o) | ({"color": _color(o["color"])} if o.get("color") else {})
        if kind in ("PointSet", "LineSet"):
            subtype = o.get("subtype", {"PointSet": "point", "LineSet": "line"}[kind])
            out["metadata"] = out.get("metadata", {}) | {"subtype": subtype}
        out["geometry"] = getattr(self, kind)(o)
        out["attributes"] = [self.attribute(k) for k in o.get("data", [])]
        if out["geometry"]["type"] in ("PointSet", "Surface"):
            out["attributes"] += [self.texture(k) for k in o.get("textures", [])]
        return out

    def rows(self, kind: str, variant: str, values: np.ndarray) -> dict:
        return self.w.array(kind, variant, [tuple(v) for v in values.tolist()] if values.ndim > 1 else values.tolist())

    def vertices(self, g: dict) -> dict:
        return {"origin": g.get("origin", [0.0, 0.0, 0.0]), "vertices": self.rows("Vertex", "F64", self.r.numbers(g["vertices"], 3, "Vector3Array").astype(float))}

    def indices(self, kind: str, key: str, width: int) -> dict:
        values = self.r.numbers(key, width, f"Int{width}Array")
        if values.size and (values.min() < 0 or values.max() > 2**32 - 1 or (values != np.floor(values)).any()):
            raise V1Error("vertex index out of range")
        return self.rows(kind, "U32", values.astype(np.int64))

    def PointSet(self, o: dict) -> dict:
        return {"type": "PointSet", **self.vertices(self.r.get(o["geometry"], "PointSetGeometry"))}

    def LineSet(self, o: dict) -> dict:
        g = self.r.get(o["geometry"], "LineSetGeometry")
        return {"type": "LineSet", **self.vertices(g), "segments": self.indices("Segment", g["segments"], 2)}

    def sizes(self, g: dict, axes: str) -> tuple[dict, dict]:
        default = {"u": [1.0, 0.0, 0.0], "v": [0.0, 1.0, 0.0], "w": [0.0, 0.0, 1.0]}
        orient = {"origin": g.get("origin", [0.0, 0.0, 0.0])} | {a: g.get(f"axis_{a}", default[a]) for a in axes}
        return orient, {"type": "Tensor"} | {a: self.w.array("Scalar", "F64", [float(x) for x in g[f"tensor_{a}"]]) for a in axes}

    def Surface(self, o: dict) -> dict:
        g = self.r.get(o["geometry"], "SurfaceGeometry", "SurfaceGridGeometry")
        if g["__class__"] == "SurfaceGeometry":
            return {"type": "Surface", **self.vertices(g), "triangles": self.indices("Triangle", g["triangles"], 3)}
        orient, grid = self.sizes(g, "uv")
        heights = {"heights": self.rows("Scalar", "F64", self.r.numbers(g["offset_w"], 1, "ScalarArray").astype(float))} if g.get("offset_w") else {}
        return {"type": "GridSurface", "orient": orient, "grid": grid, **heights}

    def Volume(self, o: dict) -> dict:
        orient, grid = self.sizes(self.r.get(o["geometry"], "VolumeGridGeometry"), "uvw")
        return {"type": "BlockModel", "orient": orient, "grid": grid}

    def attribute(self, key: str) -> dict:
        o = self.r.get(key, "ScalarData", "DateTimeData", "Vector2Data", "Vector3Data", "ColorData", "StringData", "MappedData")
        return self.head(o) | {"location": _LOCATIONS[o["location"]], "data": getattr(self, o["__class__"])(o)}

    def scalars(self, key: str) -> tuple[str, list]:
        values = self.r.numbers(key, 1, "ScalarArray")
        return ("I64", values.tolist()) if values.dtype.kind == "i" else ("F64", [None if math.isnan(v) else v for v in values.tolist()])

    def colormap(self, o: dict, kind: str) -> dict:
        if not o.get("colormap"):
            return {}
        c = self.r.get(o["colormap"], kind)
        low, high = c["limits"]
        gradient = self.w.array("Gradient", "Rgba8", [_color(x) for x in self.r.get(c["gradient"], "ColorArray")["array"]])
        return {"colormap": {"type": "Continuous", "range": {"min": low, "max": high}, "gradient": gradient}}

    def ScalarData(self, o: dict) -> dict:
        variant, values = self.scalars(o["array"])
        return {"type": "Number", "values": self.w.array("Number", variant, values), **self.colormap(o, "ScalarColormap")}

    def DateTimeData(self, o: dict) -> dict:
        values = [None if t is None else _time(t) for t in self.r.get(o["array"], "DateTimeArray")["array"]]
        return {"type": "Number", "values": self.w.array("Number", "DateTime", values), **self.colormap(o, "DateTimeColormap")}

    def vectors(self, key: str, n: int) -> list:
        return [None if any(math.isnan(x) for x in v) else tuple(v) for v in self.r.numbers(key, n, f"Vector{n}Array").astype(float).tolist()]

    def Vector2Data(self, o: dict) -> dict:
        return {"type": "Vector", "values": self.w.array("Vector", "F64x2", self.vectors(o["array"], 2))}

    def Vector3Data(self, o: dict) -> dict:
        return {"type": "Vector", "values": self.w.array("Vector", "F64x3", self.vectors(o["array"], 3))}

    def colors(self, key: str) -> list[list[int]]:
        found = self.r.get(key, "Int3Array", "ColorArray")
        values = found["array"] if found["__class__"] == "ColorArray" else self.r.numbers(key, 3).tolist()
        return [_color(c) for c in values]

    def ColorData(self, o: dict) -> dict:
        return {"type": "Color", "values": self.w.array("Color", "Rgba8", self.colors(o["array"]))}

    def StringData(self, o: dict) -> dict:
        return {"type": "Text", "values": self.w.array("Text", "Text", [s or None for s in self.r.get(o["array"], "StringArray")["array"]])}

    def MappedData(self, o: dict) -> dict:
        indices = category_indices(self.r.numbers(o["array"], 1, "ScalarArray"))
        legends = []
        for key in o.get("legends", []):
            legend = self.r.get(key, "Legend")
            found = self.r.get(legend["values"])
            kind = {"StringArray": "strings", "ColorArray": "colors"}.get(found["__class__"], found["__class__"])
            values = found["array"] if kind in ("strings", "colors") else None
            if kind == "ScalarArray":
                variant, values = self.scalars(legend["values"])
                kind = f"Number {variant}"
            elif kind in ("Vector2Array", "Vector3Array"):
                kind, values = f"Vector F64x{kind[6]}", self.vectors(legend["values"], int(kind[6]))
            elif kind == "DateTimeArray":
                kind, values = "Number DateTime", [None if t is None else _time(t) for t in found["array"]]
            elif values is None:
                raise V1Error(f"a legend can't be {kind}")
            legends.append((legend.get("name", ""), legend.get("description", ""), kind, values))
        known = [i for i in indices if i is not None]
        length, names, colors, others = pick_legends(legends, max(known) if known else None, self.compat)
        out = {"type": "Category", "values": self.w.array("Index", "U32", indices), "names": self.w.array("Name", "String", padded(names, length, ""))}
        if colors is not None:
            out["gradient"] = self.w.array("Gradient", "Rgba8", padded([_color(c) for c in colors], length, list(GRAY)))
        parts = []
        for name, description, kind, values in others:
            if kind == "strings":
                data = {"type": "Text", "values": self.w.array("Text", "Text", padded([s or None for s in values], length, None))}
            elif kind == "colors":
                data = {"type": "Color", "values": self.w.array("Color", "Rgba8", padded([_color(c) for c in values], length, None))}
            else:
                type_, variant = kind.split()
                data = {"type": type_, "values": self.w.array(type_, variant, padded(values, length, None))}
            parts.append({"name": name, "location": "Categories", "data": data} | ({"description": description} if description else {}))
        return out | ({"attributes": parts} if parts else {})

    def texture(self, key: str) -> dict:
        o = self.r.get(key, "ImageTexture")
        u, width = projection_axis(o.get("axis_u", [1.0, 0.0, 0.0]))
        v, height = projection_axis(o.get("axis_v", [0.0, 1.0, 0.0]))
        data = {"type": "ProjectedTexture", "image": self.w.image(self.r.blob(o["image"])), "orient": {"origin": o.get("origin", [0.0, 0.0, 0.0]), "u": u, "v": v}, "width": width, "height": height}
        return self.head(o) | {"location": "Projected", "data": data}


def projection_axis(axis) -> tuple[list[float], float]:
    """Direction and length; the zero axis stays zero."""
    length = math.sqrt(sum(x * x for x in axis))
    return [x / length if length else 0.0 for x in axis], length
