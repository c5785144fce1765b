"""Parts of an index as plain trees, for use with ProjectWriter, and arrays as NumPy values.

Arrays are the pointers that ProjectWriter.array() gives. What is left at its default isn't written.
"""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import DataFrame

_ORIGIN = [0.0, 0.0, 0.0]


def _with(tree: dict, **optional) -> dict:
    return tree | {k: v for k, v in optional.items() if v not in (None, "", {}, [], _ORIGIN)}


def project(name: str, elements: list | None = None, date: dt.datetime | None = None, **optional) -> dict:
    """optional: description, coordinate_reference_system, units, origin, author, application, metadata."""
    date = date or dt.datetime.now(dt.timezone.utc)
    return _with({"name": name, "date": date.astimezone(dt.timezone.utc).isoformat().replace("+00:00", "Z")}, elements=elements, **optional)


def element(name: str, geometry: dict, attributes: list | None = None, **optional) -> dict:
    """optional: description, color, metadata."""
    return _with({"name": name, "geometry": geometry}, attributes=attributes, **optional)


def point_set(vertices: dict, origin: list | None = None) -> dict:
    return _with({"type": "PointSet", "vertices": vertices}, origin=origin)


def line_set(vertices: dict, segments: dict, origin: list | None = None) -> dict:
    return _with({"type": "LineSet", "vertices": vertices, "segments": segments}, origin=origin)


def surface(vertices: dict, triangles: dict, origin: list | None = None) -> dict:
    return _with({"type": "Surface", "vertices": vertices, "triangles": triangles}, origin=origin)


def orient(origin=None, u=None, v=None, w=None) -> dict:
    return _with({}, origin=origin, u=u, v=v, w=w)


def regular_grid(size: list, count: list) -> dict:
    return {"type": "Regular", "size": [float(x) for x in size], "count": [int(x) for x in count]}


def tensor_grid(u: dict, v: dict, w: dict | None = None) -> dict:
    return _with({"type": "Tensor", "u": u, "v": v}, w=w)


def grid_surface(orient: dict, grid: dict, heights: dict | None = None) -> dict:
    return _with({"type": "GridSurface", "orient": orient, "grid": grid}, heights=heights)


def block_model(orient: dict, grid: dict, subblocks: dict | None = None) -> dict:
    return _with({"type": "BlockModel", "orient": orient, "grid": grid}, subblocks=subblocks)


def regular_subblocks(count: list, subblocks: dict, mode: str | None = None) -> dict:
    """mode: "Octree", "Full" or none."""
    return _with({"type": "Regular", "count": [int(x) for x in count], "subblocks": subblocks}, mode=mode)


def freeform_subblocks(subblocks: dict) -> dict:
    return {"type": "Freeform", "subblocks": subblocks}


def composite(elements: list) -> dict:
    return {"type": "Composite", "elements": elements}


def continuous_colormap(least, most, gradient: dict) -> dict:
    return {"type": "Continuous", "range": {"min": least, "max": most}, "gradient": gradient}


def discrete_colormap(boundaries: dict, gradient: dict) -> dict:
    return {"type": "Discrete", "boundaries": boundaries, "gradient": gradient}


def attribute(name: str, location: str, data: dict, **optional) -> dict:
    """optional: description, units, metadata."""
    return _with({"name": name, "location": location, "data": data}, **optional)


def numbers(values: dict, colormap: dict | None = None) -> dict:
    return _with({"type": "Number", "values": values}, colormap=colormap)


def vectors(values: dict) -> dict:
    return {"type": "Vector", "values": values}


def strings(values: dict) -> dict:
    return {"type": "Text", "values": values}


def booleans(values: dict) -> dict:
    return {"type": "Boolean", "values": values}


def colors(values: dict) -> dict:
    return {"type": "Color", "values": values}


def categories(values: dict, names: dict, gradient: dict | None = None, attributes: list | None = None) -> dict:
    return _with({"type": "Category", "values": values, "names": names}, gradient=gradient, attributes=attributes)


def mapped_texture(image: dict, texcoords: dict) -> dict:
    return {"type": "MappedTexture", "image": image, "texcoords": texcoords}


def projected_texture(image: dict, orient: dict, width: float, height: float) -> dict:
    """Its attribute's location is "Projected"."""
    return {"type": "ProjectedTexture", "image": image, "orient": orient, "width": float(width), "height": float(height)}


def to_numpy(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Values of an array in order of pos, one row each, and the mask that is true at nulls, whose values are zero or empty. The
    whole array comes to the driver: for arrays that fit there."""
    table = df.orderBy("pos").drop("pos").toArrow()
    columns, mask = [], np.zeros(table.num_rows, bool)
    for name in table.column_names:
        column = table.column(name).combine_chunks()
        if hasattr(column.type, "fields") and column.type.num_fields:
            mask |= np.array(column.is_null())
            columns += [column.field(i) for i in range(column.type.num_fields)]
        else:
            mask |= np.array(column.is_null())
            columns.append(column)
    filled = []
    for c in columns:
        v = c.to_pandas()
        empty = "" if v.dtype == object and c.type == "string" else False if v.dtype == object else np.zeros(1, v.dtype)[0]
        values = v.to_numpy(copy=True)
        values[mask] = empty
        filled.append(values.astype(bool) if c.type == "bool" else values)
    return (np.column_stack(filled) if len(filled) > 1 else filled[0]), mask
