"""Polygons and point-in-polygon."""

import json
import random
import struct

import pytest
from helpers import by, dicts
from pyspark.sql import functions as F

from tallyward.operators.spatial import CROWD, fill_from_layer, first_cells, locate, locate_layers, polygon_cells, polygon_pieces
from tallyward.schema import pick_col, pick_label_col
from tallyward.sources.boundaries import area_names, boundary_layer, geojson_layer, read_geojson


def box(x1, y1, x2, y2):
    return [(x1, y1), (x2, y1), (x2, y2), (x1, y2), (x1, y1)]


def ring_text(ring):
    return "(" + ", ".join(f"{x} {y}" for x, y in ring) + ")"


BOXES = {"1": box(-87.695, 41.99, -87.65, 42.02), "2": box(-87.71, 41.99, -87.66, 42.02), "3": box(-87.68, 41.96, -87.63, 41.99)}
POINTS = [("a", -87.655, 42.00), ("b", -87.70, 42.00), ("c", -87.65, 41.97), ("d", -87.68, 42.00), ("e", 0.0, 0.0),
          ("f", None, 42.0), ("g", -87.655, None)]


@pytest.fixture(scope="module")
def areas(spark):
    rows = [(k, f"Area {k}", f"POLYGON ({ring_text(r)})") for k, r in BOXES.items()]
    return boundary_layer(spark.createDataFrame(rows, "AREA_NUMBE string, COMMUNITY string, the_geom string"), "community_area")


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame(POINTS, "id string, longitude double, latitude double")


@pytest.mark.parametrize("large", [False, True])
def test_sample_boxes(areas, points, large):
    limits = {"max_broadcast_cells": 0} if large else {}
    first = {k: v["poly_id"] for k, v in by(locate(points, areas, **limits), "id").items()}
    assert first == {"a": "1", "b": "2", "c": "3", "d": "1", "e": None, "f": None, "g": None}
    every = dicts(locate(points, areas, on_overlap="all", **limits))
    assert len(every) == len(POINTS) + 1
    assert {r["poly_id"] for r in every if r["id"] == "d"} == {"1", "2"}


def test_source_value_wins(spark, areas):
    df = spark.createDataFrame([("1", -87.70, 42.0, "9"), ("2", -87.70, 42.0, "  "), ("3", -87.70, 42.0, None), ("4", 0.0, 0.0, " 5 ")],
                               "id string, longitude double, latitude double, community_area string")
    df = df.withColumn("community_area_name", F.lit(None).cast("string"))
    out = by(fill_from_layer(df, areas, "community_area", "community_area_name"), "id")
    assert {k: v["community_area"] for k, v in out.items()} == {"1": "9", "2": "2", "3": "2", "4": "5"}
    assert out["3"]["community_area_name"] == "Area 2"


def inside(rings, x, y):
    """Brute force over all edges."""
    hits = 0
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            if (y1 > y) != (y2 > y) and x < x1 + (x2 - x1) * (y - y1) / (y2 - y1):
                hits += 1
    return hits % 2 == 1


def wkb(rings_per_part, order="<"):
    flag = 1 if order == "<" else 0

    def polygon(rings):
        body = struct.pack(f"{order}BII", flag, 3, len(rings))
        for ring in rings:
            body += struct.pack(f"{order}I", len(ring)) + b"".join(struct.pack(f"{order}dd", *p) for p in ring)
        return body

    if len(rings_per_part) == 1:
        return polygon(rings_per_part[0])
    return struct.pack(f"{order}BII", flag, 6, len(rings_per_part)) + b"".join(polygon(p) for p in rings_per_part)


@pytest.mark.parametrize("encoding", ["wkt", "wkb"])
@pytest.mark.parametrize("large", [False, True])
def test_random_shapes_against_brute_force(spark, encoding, large):
    rng = random.Random(5)
    shapes = {}
    for i in range(12):
        cx, cy, r = rng.uniform(0, 10), rng.uniform(0, 10), rng.uniform(0.3, 4)
        star = [(cx + r * rng.uniform(0.4, 1) * dx, cy + r * rng.uniform(0.4, 1) * dy)
                for dx, dy in ((1, 0), (.7, .7), (0, 1), (-.7, .7), (-1, 0), (-.7, -.7), (0, -1), (.7, -.7))]
        part = [star + star[:1]]
        if i % 2:
            part.append(box(cx - r / 6, cy - r / 6, cx + r / 6, cy + r / 6))
        shapes[f"p{i}"] = [part] if i % 3 else [part, [box(cx + 12, cy, cx + 13, cy + 1)]]
    pts = [(str(i), rng.uniform(-1, 24), rng.uniform(-1, 12)) for i in range(1500)]
    if encoding == "wkt":
        text = {k: "MULTIPOLYGON (" + ", ".join("(" + ", ".join(map(ring_text, part)) + ")" for part in parts) + ")"
                for k, parts in shapes.items()}
        raw = spark.createDataFrame(list(text.items()), "ward string, geometry string")
    else:
        raw = spark.createDataFrame([(k, bytearray(wkb(p, "<" if i % 2 else ">"))) for i, (k, p) in enumerate(shapes.items())],
                                    "ward string, geometry binary")
    layer = boundary_layer(raw, "ward")
    frame = spark.createDataFrame(pts, "id string, longitude double, latitude double")
    limits = {"max_broadcast_cells": 0} if large else {}
    got = {(r["id"], r["poly_id"]) for r in locate(frame, layer, on_overlap="all", **limits).collect() if r["poly_id"]}
    want = {(i, k) for i, x, y in pts for k, parts in shapes.items() if inside([r for p in parts for r in p], x, y)}
    assert got == want and len(want) > 300


@pytest.mark.parametrize("large", [False, True])
def test_extents_far_apart_and_several_layers(spark, large):
    """Shapes of 1 to 2,000 times the extent do not set each other's cells; two layers in one pass; cells stay bounded."""
    rng = random.Random(7)
    shapes = {f"{i:03d}": (rng.uniform(0, 40), rng.uniform(0, 40), 0.01 * 2 ** (i % 12)) for i in range(60)}
    raw = [(k, f"POLYGON ({ring_text(box(x - r, y - r, x + r, y + r))})") for k, (x, y, r) in shapes.items()]
    layer = boundary_layer(spark.createDataFrame(raw, "ward string, geometry string"), "ward")
    half = boundary_layer(spark.createDataFrame([("w", f"POLYGON ({ring_text(box(-50, -50, 20, 90))})")],
                                                "ward string, geometry string"), "ward")
    spread = [(f"i{i}", rng.uniform(-5, 45), rng.uniform(-5, 45)) for i in range(800)]
    near = [(f"n{k}{j}", x + r * rng.uniform(-1.2, 1.2), y + r * rng.uniform(-1.2, 1.2)) for k, (x, y, r) in shapes.items() for j in range(5)]
    frame = spark.createDataFrame(spread + near + [("none", None, None)], "id string, longitude double, latitude double")
    limits = {"max_broadcast_cells": 0} if large else {}
    got = {r["id"]: (r["_in_a"] and r["_in_a"]["poly_id"], r["_in_b"] and r["_in_b"]["poly_id"])
           for r in locate_layers(frame, {"a": layer, "b": half}, **limits).collect()}
    want = {i: (min((k for k, (x, y, r) in shapes.items() if inside([box(x - r, y - r, x + r, y + r)], px, py)), default=None),
                "w" if inside([box(-50, -50, 20, 90)], px, py) else None) for i, px, py in spread + near} | {"none": (None, None)}
    assert got == want and len({a for a, _ in want.values()}) > 20
    cells = polygon_cells(layer, 8)
    assert cells.groupBy("poly_id").count().agg(F.max("count")).first()[0] <= 100
    assert cells.select("level").distinct().count() >= 11


def diamond(x, y, r):
    return [(x + r, y), (x, y + r), (x - r, y), (x, y - r), (x + r, y)]


@pytest.mark.parametrize("large", [False, True])
def test_candidates_do_not_grow_with_shapes_on_top_of_each_other(spark, large):
    """Slanted shapes of several sizes, copies among them: a cell holds few candidates however many shapes cover it."""
    rng = random.Random(11)
    shapes = {f"{i:04d}": (rng.uniform(0, 10), rng.uniform(0, 10), 0.5 * 2 ** (i % 5)) for i in range(600)}
    shapes |= {f"copy{i}": (5.03, 5.07, 0.7) for i in range(100)}
    raw = [(k, f"POLYGON ({ring_text(diamond(*v))})") for k, v in shapes.items()] + [(None, f"POLYGON ({ring_text(diamond(1, 1, 1.3))})")]
    layer = boundary_layer(spark.createDataFrame(raw, "ward string, geometry string"), "ward")
    pieces = polygon_pieces(layer, 4).withColumn("layer", F.lit("a"))
    crowd = first_cells(pieces, len(raw)).groupBy("layer", "level", "cell_x", "cell_y").count().agg(F.max("count")).first()[0]
    assert crowd <= CROWD + 1 < pieces.groupBy("level", "cell_x", "cell_y").count().agg(F.max("count")).first()[0] / 4
    pts = [(f"i{i}", rng.uniform(-3, 13), rng.uniform(-3, 13)) for i in range(1500)] + [("i0", 5.03, 5.07), (None, 5.5, 5.2)]
    got = sorted(((r["id"] or "", r["longitude"], r["poly_id"] or "") for r in locate(
        spark.createDataFrame(pts, "id string, longitude double, latitude double"), layer,
        **({"max_broadcast_cells": 0} if large else {})).collect()))
    held = lambda x, y: [k or "" for k, v in [*shapes.items(), (None, (1, 1, 1.3))] if inside([diamond(*v)], x, y)]
    assert got == sorted((i or "", x, min(held(x, y), default="")) for i, x, y in pts)


@pytest.mark.parametrize("point_id", ["id", None])
def test_points_that_share_an_id_or_a_busy_place_keep_their_own_matches(spark, areas, monkeypatch, point_id):
    """Every row counts once per polygon that holds it, also where ids repeat or lack and a place has more points than a salt takes."""
    monkeypatch.setattr("tallyward.operators.spatial.POINTS_PER_SALT", 5)
    rows = [("x", -87.68, 42.0)] * 40 + [("x", -87.655, 42.0), (None, -87.70, 42.0), (None, None, 42.0), ("x", None, None), ("y", 0.0, 0.0)]
    frame = spark.createDataFrame(rows, "id string, longitude double, latitude double")
    held = lambda x, y: sorted(k for k, r in BOXES.items() if x is not None and inside([r], x, y))
    for overlap in ("all", "first"):
        got = locate(frame, areas, on_overlap=overlap, point_id=point_id, max_broadcast_cells=0)
        want = [(i or "", x or 0, k or "") for i, x, y in rows for k in (held(x, y) or [None])[:None if overlap == "all" else 1]]
        assert got.columns == ["id", "longitude", "latitude", "poly_id", "poly_name"]
        assert sorted((r["id"] or "", r["longitude"] or 0, r["poly_id"] or "") for r in got.collect()) == sorted(want)


def test_no_nested_loop_join(areas, points):
    for limits in ({}, {"max_broadcast_cells": 0}):
        plan = locate(points, areas, **limits)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_column_roles():
    assert pick_col(["OBJECTID", "DIST_NUM", "the_geom"], "district") == "DIST_NUM"
    assert pick_col(["police_beat", "g"], "beat") == "police_beat"
    assert pick_col(["x"], "ward") is None
    assert pick_label_col(["dist_num", "dist_label", "geom"], "dist_num", "geom") == "dist_label"
    assert pick_label_col(["area_numbe", "community", "geom"], "area_numbe", "geom") == "community"
    assert pick_label_col(["area_numbe", "label_code", "geom", "perimeter"], "area_numbe", "geom") is None


def test_boundary_without_roles_is_refused(spark):
    with pytest.raises(ValueError):
        boundary_layer(spark.createDataFrame([("x",)], "foo string"), "ward")


def test_geojson_variants(spark, tmp_path):
    def feature(props, rings=None, parts=None):
        geometry = ({"type": "MultiPolygon", "coordinates": [[list(map(list, r)) for r in p] for p in parts]} if parts
                    else {"type": "Polygon", "coordinates": [list(map(list, r)) for r in rings]})
        return {"type": "Feature", "properties": props, "geometry": geometry}

    data = {"type": "FeatureCollection", "name": "areas", "features": [
        feature({"area_numbe": "35.0", "community": "DOUGLAS"}, [box(0, 0, 2, 2), box(0.5, 0.5, 1, 1)]),
        feature({"area_num_1": "36", "name": "OAK"}, parts=[[box(3, 0, 4, 1)], [box(5, 0, 6, 1)]]),
        feature({"comarea_id": "n/a", "area": "LOST"}, [box(9, 9, 10, 10)]),
        feature({"comarea_id": 7}, [box(7, 0, 8, 1)]),
        feature({"area_id": 8, "name": "Ready"}, [box(8.5, 0, 9, 1)]),
    ]}
    path = tmp_path / "areas.geojson"
    path.write_text(json.dumps(data))
    features = read_geojson(spark, str(path))
    assert {r["area_id"]: r["area_name"] for r in features.collect()} == {35: "DOUGLAS", 36: "OAK", 7: "7", 8: "Ready"}
    pts = spark.createDataFrame([("in", 0.2, 0.2), ("hole", 0.7, 0.7), ("part", 5.5, 0.5), ("gap", 4.5, 0.5)],
                                "id string, longitude double, latitude double")
    got = {k: v["poly_id"] for k, v in by(locate(pts, geojson_layer(features)), "id").items()}
    assert got == {"in": "35", "hole": None, "part": "36", "gap": None}


def test_area_names_by_candidates(spark):
    assert dicts(area_names(spark.createDataFrame([("3.0", "Uptown")], "area_numbe string, community string"))) == [
        {"area_id": 3, "area_name": "Uptown"}]
    assert area_names(spark.createDataFrame([(1,)], "foo int")) is None
