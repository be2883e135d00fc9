"""Polygon parsing and point-in-polygon as column expressions (C1-C4 without a geometry engine).

A polygon, whatever its text or binary form, becomes one flat list of edges over all its rings.
Even-odd crossing counts over that list handle holes and multi-part shapes alike. Horizontal edges
bound a polygon but can never be crossed by a horizontal ray: ``crossable`` leaves them out, which
also keeps the slope finite.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RING_TYPE = "array<array<array<double>>>"


def rings_from_wkt(wkt: Column) -> Column:
    """Rings as array<array<array<double>>>, by pattern: every innermost parenthesis is a ring."""
    texts = F.regexp_extract_all(wkt, F.lit(r"\(([^()]+)\)"), F.lit(1))
    return F.transform(
        texts,
        lambda ring: F.transform(
            F.split(ring, ","),
            lambda pair: F.transform(F.split(F.trim(pair), r"\s+"), lambda v: v.try_cast("double")),
        ),
    )


def rings_from_geojson(kind: Column, coordinates: Column) -> Column:
    """Rings from the coordinates JSON text of a Polygon or MultiPolygon."""
    single = F.from_json(coordinates, RING_TYPE)
    multi = F.flatten(F.from_json(coordinates, f"array<{RING_TYPE}>"))
    return F.when(kind == "MultiPolygon", multi).when(kind == "Polygon", single)


def decode_wkb_rings(df: DataFrame, wkb_col: str, out_col: str = "rings") -> DataFrame:
    """Add the rings of a WKB column. Runs Arrow batches in Python: polygon tables only, never points."""
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T._parse_datatype_string(RING_TYPE))])

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame[out_col] = [None if v is None else _wkb_rings(bytes(v)) for v in frame[wkb_col]]
            yield frame

    return df.mapInPandas(batches, schema)


def _wkb_rings(data: bytes) -> list[list[list[float]]]:
    rings, _ = _wkb_geometry(data, 0)
    return rings


def _wkb_geometry(data: bytes, pos: int) -> tuple[list, int]:
    """Rings of the geometry at ``pos`` and the position after it. Points and lines have no rings."""
    order = "<" if data[pos] == 1 else ">"
    (code,) = struct.unpack_from(order + "I", data, pos + 1)
    pos += 5
    if code & 0x20000000:  # an SRID follows
        pos += 4
    extra = bin(code >> 30).count("1")  # Z and M as high bits
    base = code & 0x0FFFFFFF
    extra += {0: 0, 1: 1, 2: 1, 3: 2}[base // 1000]  # Z and M as thousands
    kind, width = base % 1000, 2 + extra

    def count(at: int) -> tuple[int, int]:
        return struct.unpack_from(order + "I", data, at)[0], at + 4

    if kind == 1:
        return [], pos + 8 * width
    if kind == 2:
        n, pos = count(pos)
        return [], pos + 8 * width * n
    n, pos = count(pos)
    rings: list = []
    for _ in range(n):
        if kind == 3:
            points, pos = count(pos)
            flat = struct.unpack_from(f"{order}{points * width}d", data, pos)
            rings.append([[flat[i], flat[i + 1]] for i in range(0, len(flat), width)])
            pos += 8 * width * points
        else:  # multi-part and collection: each part is a full geometry
            part, pos = _wkb_geometry(data, pos)
            rings.extend(part)
    return rings, pos


def edges_from_rings(rings: Column) -> Column:
    """array<struct<x1,y1,x2,y2>>; each ring is closed, rings without an area dropped."""

    def ring_edges(ring: Column) -> Column:
        points = F.filter(ring, lambda p: p.getItem(0).isNotNull() & p.getItem(1).isNotNull())
        following = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
        return F.zip_with(
            points, following,
            lambda a, b: F.struct(
                a.getItem(0).alias("x1"), a.getItem(1).alias("y1"),
                b.getItem(0).alias("x2"), b.getItem(1).alias("y2"),
            ),
        )

    usable = F.filter(rings, lambda r: F.size(r) >= 3)
    return F.flatten(F.transform(usable, ring_edges))


def crossable(edges: Column) -> Column:
    """The edges a horizontal ray can cross."""
    return F.filter(edges, lambda e: e["y1"] != e["y2"])


def edge_extent(edges: Column) -> dict[str, Column]:
    """Bounding box columns of an edge list."""

    def over(fn, a: str, b: str) -> Column:
        pick = F.least if fn is F.array_min else F.greatest
        return fn(F.transform(edges, lambda e: pick(e[a], e[b])))

    return {
        "min_x": over(F.array_min, "x1", "x2"), "max_x": over(F.array_max, "x1", "x2"),
        "min_y": over(F.array_min, "y1", "y2"), "max_y": over(F.array_max, "y1", "y2"),
    }


def contains_point(edges: Column, x: Column, y: Column) -> Column:
    """Even-odd rule over crossable edges: an odd number of them lies to the right of the point."""

    def crossed(e: Column) -> Column:
        spans = (e["y1"] > y) != (e["y2"] > y)
        at = e["x1"] + (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"])
        return spans & (x < at)

    return F.size(F.filter(edges, crossed)) % 2 == 1
