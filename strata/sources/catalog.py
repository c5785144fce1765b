"""The index of a container as a tree and as tables, and the checks of its structure.

The tree is small, some thousand nodes at most, so it is walked on the driver; what it points to is checked in Spark, see arrays.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..functions.geometry import LOCATIONS
from .kinds import Array

#: Most rows along an axis of a grid.
MOST_CELLS = 2**32 - 1
TOLERANCE = 1e-6


@dataclass(frozen=True)
class Problem:
    type: str
    field: str | None
    reason: str
    name: str | None = None
    warning: bool = False
    count: int = 1  # problems that it stands for

    def __str__(self) -> str:
        where = self.type if self.field is None else f"{self.type}::{self.field}"
        return f"{'Warning' if self.warning else 'Error'}: '{where}' {self.reason}" + (f", inside '{self.name}'" if self.name is not None else "")


class ValidationFailed(ValueError):
    def __init__(self, problems: list[Problem]):
        self.problems = problems
        super().__init__("Validation failed: " + "; ".join(map(str, problems[:20])))


#: Bounds that a use of an array must have, and those it may have, by kind.
_BOUNDS = {
    "Scalar": (set(), {"above_zero"}),
    "Segment": ({"count"}, set()),
    "Triangle": ({"count"}, set()),
    "Index": ({"count"}, set()),
    "RegularSubblock": ({"blocks", "cells"}, {"mode"}),
    "FreeformSubblock": ({"blocks"}, set()),
}


@dataclass
class Use:
    """An array as its owner needs it: what indices and sub-blocks in it are bounded by."""

    array: Array
    type: str
    field: str
    name: str | None
    bounds: dict = field(default_factory=dict)

    def __post_init__(self):
        needs, may = _BOUNDS.get(self.array.kind, (set(), set()))
        if not needs <= set(self.bounds) <= needs | may:
            raise TypeError(f"bounds {sorted(self.bounds)} don't fit a {self.array.kind} array")


def elements(project: dict) -> Iterator[tuple[str, dict]]:
    """All elements with their paths, "0", "1/0" ...; parts of a composite follow it."""

    def walk(items: list, prefix: str):
        for i, e in enumerate(items):
            path = f"{prefix}{i}"
            yield path, e
            if e["geometry"]["type"] == "Composite":
                yield from walk(e["geometry"].get("elements", []), f"{path}/")

    yield from walk(project.get("elements", []), "")


def attributes(element: dict, prefix: str = "") -> Iterator[tuple[str, dict]]:
    """All attributes with their paths; those of categories follow the attribute they belong to."""
    for i, a in enumerate(element.get("attributes", [])):
        yield f"{prefix}{i}", a
        if a["data"]["type"] == "Category":
            yield from attributes(a["data"], f"{prefix}{i}/")


def _grid_counts(grid: dict) -> list[int]:
    if grid["type"] == "Regular":
        return list(grid["count"])
    return [grid[a]["item_count"] for a in "uvw" if a in grid]


def valid_locations(element: dict) -> list[str]:
    """Where an application should let attributes lie: of a block model its sub-blocks, if it has any, and its blocks, not their corners."""
    g = element["geometry"]
    places = list(LOCATIONS[g["type"]])
    if g["type"] == "BlockModel":
        return ["Subblocks", "Primitives"] if g.get("subblocks") else ["Primitives"]
    return places


def location_lengths(element: dict) -> dict[str, int]:
    """How many values each location of an element takes. Projected textures take none."""
    g = element["geometry"]
    n: dict[str, int] = {}
    if "vertices" in g:
        n["vertices"] = g["vertices"]["item_count"]
    for key in ("segments", "triangles"):
        if key in g:
            n[key] = g[key]["item_count"]
    if "grid" in g:
        count = _grid_counts(g["grid"])
        n["corners"] = math.prod(c + 1 for c in count)
        n["cells"] = n["blocks"] = math.prod(count)
    if g.get("subblocks"):
        n["subblocks"] = g["subblocks"]["subblocks"]["item_count"]
    if g["type"] == "Composite":
        n["elements"] = len(g.get("elements", []))
    lengths = {place: n[key] for place, key in LOCATIONS[g["type"]].items() if key in n}
    return lengths | {"Projected": 0}


def _array(kind: str, a: dict) -> Array:
    return Array(kind, a["filename"], a["item_count"])


def _data_arrays(data: dict) -> list[tuple[str, str, dict]]:
    kind = data["type"]
    first = {"Number": "Number", "Vector": "Vector", "Text": "Text", "Category": "Index", "Boolean": "Boolean", "Color": "Color"}
    out = [(first[kind], "values", data["values"])] if kind in first else []
    if kind == "Category":
        out.append(("Name", "names", data["names"]))
        out += [("Gradient", "gradient", data["gradient"])] if data.get("gradient") else []
    if kind == "MappedTexture":
        out += [("Image", "image", data["image"]), ("Texcoord", "texcoords", data["texcoords"])]
    if kind == "ProjectedTexture":
        out.append(("Image", "image", data["image"]))
    return out


class _Walk:
    """Checks a tree, and notes the arrays that it uses."""

    def __init__(self, members: set[str] | None, all_axes: bool):
        self.members, self.all_axes, self.problems, self.uses = members, all_axes, [], []

    def error(self, type_: str, field_: str | None, reason: str, name: str | None) -> None:
        self.problems.append(Problem(type_, field_, reason, name))

    def finite(self, values, type_: str, field_: str, name) -> None:
        if not all(math.isfinite(v) for v in values):
            self.error(type_, field_, "must be finite", name)

    def positive(self, values, type_: str, field_: str, name) -> None:
        if any(v <= 0 for v in values):
            self.error(type_, field_, "must be greater than zero", name)

    def unique(self, names: list[str], type_: str, field_: str, name) -> None:
        for value, n in Counter(names).items():
            if n > 1:
                quoted = '"' + value.replace("\\", "\\\\").replace('"', '\\"') + '"'
                self.problems.append(Problem(type_, field_, f"contains duplicate of {quoted}", name, warning=True))

    def same_length(self, found: int, needed: int, type_: str, field_: str | None, name) -> None:
        if found != needed:
            self.error(type_, field_, f"length {found} does not match geometry ({needed})", name)

    def use(self, kind: str, a: dict, type_: str, field_: str, name, **bounds) -> None:
        if self.members is not None and a["filename"] not in self.members:
            self.error(type_, field_, f"refers to non-existent archive member '{a['filename']}'", name)
        self.uses.append(Use(_array(kind, a), type_, field_, name, bounds))

    def project(self, p: dict) -> None:
        name = p.get("name", "")
        self.finite(p.get("origin", (0, 0, 0)), "Project", "origin", name)
        for e in p.get("elements", []):
            self.element(e)
        self.unique([e.get("name", "") for e in p.get("elements", [])], "Project", "elements[..]::name", name)

    def element(self, e: dict) -> None:
        name, g = e.get("name", ""), e["geometry"]
        getattr(self, f"_{g['type']}")(g, name)
        lengths = location_lengths(e)
        for a in e.get("attributes", []):
            self.attribute(a, lengths, g["type"])
        self.unique([a.get("name", "") for a in e.get("attributes", [])], "Element", "attributes[..]::name", name)

    def _points(self, g: dict, type_: str, name) -> None:
        self.finite(g.get("origin", (0, 0, 0)), type_, "origin", name)
        self.use("Vertex", g["vertices"], type_, "vertices", name)

    def _PointSet(self, g: dict, name) -> None:
        self._points(g, "PointSet", name)

    def _LineSet(self, g: dict, name) -> None:
        self._points(g, "LineSet", name)
        self.use("Segment", g["segments"], "LineSet", "segments", name, count=g["vertices"]["item_count"])

    def _Surface(self, g: dict, name) -> None:
        self._points(g, "Surface", name)
        self.use("Triangle", g["triangles"], "Surface", "triangles", name, count=g["vertices"]["item_count"])

    def _GridSurface(self, g: dict, name) -> None:
        self.orient(g["orient"], 2, name)
        count = self.grid(g["grid"], 2, name)
        if g.get("heights"):
            self.use("Scalar", g["heights"], "GridSurface", "heights", name)
            self.same_length(g["heights"]["item_count"], math.prod(c + 1 for c in count), "GridSurface", "heights", name)

    def _BlockModel(self, g: dict, name) -> None:
        self.orient(g["orient"], 3, name)
        count = self.grid(g["grid"], 3, name)
        sub = g.get("subblocks")
        if sub and sub["type"] == "Regular":
            self.positive(sub["count"], "Subblocks::Regular", "count", name)
            mode = sub.get("mode")
            if mode == "Octree" and any(c < 1 or c & (c - 1) for c in sub["count"]):
                self.error("Subblocks::Regular", "count", f"sub-block counts {list(sub['count'])} must be powers of two", name)
            self.use("RegularSubblock", sub["subblocks"], "Subblocks::Regular", "subblocks", name, blocks=count, cells=list(sub["count"]), mode=mode)
        elif sub:
            self.use("FreeformSubblock", sub["subblocks"], "Subblocks::Freeform", "subblocks", name, blocks=count)

    def _Composite(self, g: dict, name) -> None:
        for e in g.get("elements", []):
            self.element(e)
        self.unique([e.get("name", "") for e in g.get("elements", [])], "Composite", "elements[..]::name", name)

    def grid(self, grid: dict, axes: int, name) -> list[int]:
        type_ = f"Grid{axes}::{grid['type']}"
        count = _grid_counts(grid)
        if grid["type"] == "Regular":
            self.finite(grid["size"], type_, "size", name)
            self.positive(grid["size"], type_, "size", name)
            self.positive(count, type_, "count", name)
        else:
            for a in "uvw"[:axes]:
                self.use("Scalar", grid[a], type_, a, name, above_zero=True)
            if any(c > MOST_CELLS for c in count):
                self.error(type_, None, f"grid count {count} exceeds maximum of {MOST_CELLS}", name)
        return count

    def orient(self, orient: dict, axes: int, name, orthogonal: bool = True) -> None:
        type_ = f"Orient{axes}"
        default = {"u": (1.0, 0.0, 0.0), "v": (0.0, 1.0, 0.0), "w": (0.0, 0.0, 1.0)}
        vectors = {a: [float(x) for x in orient.get(a, default[a])] for a in "uvw"[:axes]}
        self.finite(orient.get("origin", (0, 0, 0)), type_, "origin", name)
        for a, v in vectors.items():
            length = math.sqrt(sum(x * x for x in v))
            if not abs(1 - sum(x * x for x in v)) < TOLERANCE:
                shown = math.floor(length * 1e7) / 1e7 if math.isfinite(length) else length
                self.error(type_, a, f"must be a unit vector but {v} length is {shown:g}" if shown != round(shown, 7) else f"must be a unit vector but {v} length is {shown}", name)
        if not orthogonal:
            return
        pairs = [("u", "v"), ("u", "w"), ("v", "w")] if axes == 3 and self.all_axes else [("u", "v")]
        for a, b in pairs:
            x, y = (_unit(vectors[k]) for k in (a, b))
            if not abs(sum(p * q for p, q in zip(x, y, strict=True))) < TOLERANCE:
                self.error(type_, None, f"vectors are not orthogonal: {vectors[a]} {vectors[b]}", name)

    def attribute(self, a: dict, lengths: dict[str, int], owner: str) -> None:
        name, location, data = a.get("name", ""), a["location"], a["data"]
        kind = data["type"]
        if (kind == "ProjectedTexture") != (location == "Projected"):
            self.error("Attribute", "location", f"is {location} which is not valid on {kind} attributes", name)
        elif location not in lengths:
            self.error("Attribute", "location", f"is {location} which is not valid on {owner} geometry", name)
        elif kind != "ProjectedTexture":
            values = data["texcoords"] if kind == "MappedTexture" else data["values"]
            self.same_length(values["item_count"], lengths[location], "Attribute", None, name)
        type_ = f"AttributeData::{kind}"
        names = data["names"]["item_count"] if kind == "Category" else 0
        for k, field_, array in _data_arrays(data):
            self.use(k, array, type_, field_, name, **({"count": names} if k == "Index" else {}))
        if kind == "Number" and data.get("colormap"):
            self.colormap(data["colormap"], name)
        if kind == "Category":
            if data.get("gradient"):
                self.same_length(data["gradient"]["item_count"], names, type_, "colors", name)
            for sub in data.get("attributes", []):
                self.attribute(sub, {"Categories": names}, "Category")
            self.unique([x.get("name", "") for x in data.get("attributes", [])], type_, "attributes[..]::name", name)
        if kind == "ProjectedTexture":
            self.orient(data["orient"], 2, name, orthogonal=False)
            for side in ("width", "height"):
                self.finite([data[side]], type_, side, name)
                self.positive([data[side]], type_, side, name)

    def colormap(self, c: dict, name) -> None:
        type_ = f"NumberColormap::{c['type']}"
        self.use("Gradient", c["gradient"], type_, "gradient", name)
        if c["type"] == "Discrete":
            self.use("Boundary", c["boundaries"], type_, "boundaries", name)
            self.same_length(c["gradient"]["item_count"], c["boundaries"]["item_count"] + 1, type_, "gradient", name)
        else:
            low, high = c["range"]["min"], c["range"]["max"]
            bad = [(f, v) for f, v in (("min", low), ("max", high)) if isinstance(v, float) and not math.isfinite(v)]
            for f, _ in bad:
                self.error(type_, f, "must be finite", name)
            if not bad and low > high:
                self.error(type_, "range", f"minimum is greater than maximum in [{low}, {high}]", name)


def _unit(v: list[float]) -> list[float]:
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if n > 0 else v


def check_tree(project: dict, members: set[str] | None = None, compat: bool = False) -> tuple[list[Problem], list[Use]]:
    """Problems of the structure, and the arrays in use with their bounds. compat: of three axes only the first two are compared."""
    walk = _Walk(members, not compat)
    walk.project(project)
    return walk.problems, walk.uses


def limited(problems: list[Problem], limit: int | None) -> list[Problem]:
    """The first errors and warnings up to the limit, and how many more there are."""
    if limit is None or len(problems) <= limit:
        return problems
    shown, rest = problems[:limit], problems[limit:]
    errors = sum(p.count for p in rest if not p.warning)
    for n, what, warning in ((errors, "errors", False), (sum(p.count for p in rest) - errors, "warnings", True)):
        if n:
            shown.append(Problem("", None, f"{n} more {what}", None, warning))
    return shown


def tables(spark: SparkSession, project: dict) -> dict[str, DataFrame]:
    """The tree as tables: projects, elements, attributes, arrays. Missing members of the index take their defaults."""
    import json

    def text(d: dict, *keys: str) -> tuple:
        return tuple(d.get(k, "") for k in keys)

    def meta(d: dict) -> str:
        return json.dumps(d.get("metadata", {}), sort_keys=True)

    rows = {"elements": [], "attributes": []}
    for path, e in elements(project):
        rows["elements"].append((path, *text(e, "name", "description"), e.get("color"), meta(e), e["geometry"]["type"], [float(x) for x in e["geometry"].get("origin", (0, 0, 0))]))
        lengths = location_lengths(e)
        for at, a in attributes(e):
            found = _data_arrays(a["data"])
            n = 0 if a["data"]["type"] == "ProjectedTexture" else (a["data"].get("values") or a["data"]["texcoords"])["item_count"]
            rows["attributes"].append((path, at, *text(a, "name", "description", "units"), meta(a), a["location"], a["data"]["type"], n, lengths.get(a["location"]), [f[2]["filename"] for f in found]))
    head = [(*text(project, "name", "description", "coordinate_reference_system", "units", "author", "application"), project["date"], [float(x) for x in project.get("origin", (0, 0, 0))], meta(project))]
    uses = check_tree(project)[1]
    return {
        "projects": spark.createDataFrame(head, "name string, description string, coordinate_reference_system string, units string, author string, application string, date string, origin array<double>, metadata string"),
        "elements": spark.createDataFrame(rows["elements"], "element_path string, name string, description string, color array<int>, metadata string, geometry string, origin array<double>"),
        "attributes": spark.createDataFrame(rows["attributes"], "element_path string, attr_path string, name string, description string, units string, metadata string, location string, type string, item_count long, location_length long, filenames array<string>"),
        "arrays": spark.createDataFrame([(u.array.filename, u.array.kind, u.array.item_count, u.type, u.field) for u in uses], "filename string, kind string, item_count long, owner string, field string"),
    }


def map_arrays(node, f: Callable[[dict], dict]):
    """The tree with every array pointer replaced."""
    if isinstance(node, dict):
        if set(node) == {"filename", "item_count"}:
            return f(node)
        return {k: map_arrays(v, f) for k, v in node.items()}
    return [map_arrays(x, f) for x in node] if isinstance(node, list) else node


def json_schema() -> dict:
    """The index's format as JSON schema, draft 2019-09. What isn't required has a default."""
    ref = lambda name: {"$ref": f"#/$defs/{name}"}
    text, number, count = {"type": "string"}, {"type": "number"}, {"type": "integer", "minimum": 0}
    many = lambda of: {"type": "array", "items": of}
    fixed = lambda of, n: {"type": "array", "items": of, "minItems": n, "maxItems": n}

    def record(needed: dict, **optional) -> dict:
        return {"type": "object", "properties": needed | optional, "required": list(needed)}

    def one_of(**variants: dict) -> dict:
        return {"oneOf": [v | {"properties": {"type": {"const": k}} | v["properties"], "required": ["type", *v["required"]]} for k, v in variants.items()]}

    array, vector, meta = ref("Array"), fixed(number, 3), {"type": "object"}
    values = {"values": array}
    defs = {
        "Array": record({"filename": text, "item_count": count}),
        "Orient": record({}, origin=vector, u=vector, v=vector, w=vector),
        "Grid": one_of(Regular=record({"size": many(number), "count": many(count)}), Tensor=record({"u": array, "v": array}, w=array)),
        "Subblocks": one_of(Regular=record({"count": fixed(count, 3), "subblocks": array}, mode={"enum": ["Octree", "Full"]}), Freeform=record({"subblocks": array})),
        "Colormap": one_of(Continuous=record({"range": record({"min": {"type": ["number", "string"]}, "max": {"type": ["number", "string"]}}), "gradient": array}), Discrete=record({"boundaries": array, "gradient": array})),
        "Data": one_of(
            Number=record(values, colormap=ref("Colormap")), Vector=record(values), Text=record(values), Boolean=record(values), Color=record(values),
            Category=record(values | {"names": array}, gradient=array, attributes=many(ref("Attribute"))),
            MappedTexture=record({"image": array, "texcoords": array}), ProjectedTexture=record({"image": array, "orient": ref("Orient"), "width": number, "height": number}),
        ),
        "Attribute": record({"name": text, "location": {"enum": ["Vertices", "Primitives", "Subblocks", "Elements", "Projected", "Categories"]}, "data": ref("Data")}, description=text, units=text, metadata=meta),
        "Geometry": one_of(
            PointSet=record({"vertices": array}, origin=vector), LineSet=record({"vertices": array, "segments": array}, origin=vector), Surface=record({"vertices": array, "triangles": array}, origin=vector),
            GridSurface=record({"orient": ref("Orient"), "grid": ref("Grid")}, heights=array), BlockModel=record({"orient": ref("Orient"), "grid": ref("Grid")}, subblocks=ref("Subblocks")), Composite=record({"elements": many(ref("Element"))}),
        ),
        "Element": record({"name": text, "geometry": ref("Geometry")}, description=text, color=fixed({"type": "integer", "minimum": 0, "maximum": 255}, 4), metadata=meta, attributes=many(ref("Attribute"))),
    }
    root = record({"date": text}, name=text, description=text, coordinate_reference_system=text, units=text, origin=vector, author=text, application=text, metadata=meta, elements=many(ref("Element")))
    return {"$schema": "https://json-schema.org/draft/2019-09/schema", "title": "Project"} | root | {"$defs": defs}
