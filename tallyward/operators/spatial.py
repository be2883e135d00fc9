"""Point-in-polygon enrichment.

Both sides are assigned to square cells and joined on the cell, never pairwise. Cells have sides of powers of two, and a
polygon goes to the grid that fits its own extent, to about ``per_side`` cells along its longer side: so a polygon makes a bounded
number of cells whatever its size, and one large polygon does not make the cells of the others large. A point is looked
up once per grid that is in use. Where no edge of a polygon comes near a cell, the whole cell is inside or
outside: outside cells are dropped and inside cells need no further test. In the other cells the
polygon takes along only the edges that can matter there: a horizontal ray to the right from a
point in the cell meets no edge outside the cell's band or left of it.

Where only the smallest polygon of a point is asked for, a cell keeps the smallest polygon that holds all of it, be it in its own
grid or in a coarser one, and of the others those that are smaller still: no other can be the answer. So shapes that lie on top of
each other do not make a cell's candidates grow with their number.

The cells of all layers stand in one table, keyed by layer, grid and cell. It is written once, and two exact join forms follow, chosen
by its measured size:

* bounded: one row per cell holding its candidates, broadcast per grid. Points are neither shuffled nor
  multiplied, and all layers are looked up in one pass over them.
* large: points are reduced to their different places, unfolded over the grids and shuffled once with a salt, so that a cell
  holding a third of all places is spread over many tasks; matches are reduced to one row per place with a column per layer, and
  joined back once, places with many points with a salt too.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.functions.geometry import contains_point, crossable, edge_extent
from tallyward.operators.layout import stage

MAX_BROADCAST_CELLS = 200_000
MAX_BROADCAST_EDGES = 1_000_000
POINTS_PER_SALT = 100_000
# From so many polygons on they are dealt to all cores before they are cut into cells.
POLYGONS_PER_TASK = 1_000
# Cells along the longer side of a polygon: as many as the broadcast bound affords, within these.
MIN_CELLS_PER_SIDE, MAX_CELLS_PER_SIDE = 4, 16
CELL = ["layer", "level", "cell_x", "cell_y"]
# A cell with more shapes that hold part of it is cut into cells that are CUT levels finer, MAX_CUTS times at most, and only while that
# makes a bounded number of pieces.
CROWD, CUT, MAX_CUTS, MAX_PIECES_PER_POLYGON = 16, 2, 6, 400
# Tolerance around a cell, as a share of its side: covers rounding in the cell index.
CELL_MARGIN = 1e-3

Grid = tuple[str, int]  # layer, level: cells of side 2 ** level


def count_polygons(layers: Mapping[str, DataFrame]) -> dict[str, int]:
    named = [layer.select(F.lit(name).alias("layer")) for name, layer in layers.items()]
    return {r["layer"]: r["count"] for r in reduce(DataFrame.unionByName, named).groupBy("layer").count().collect()}


def cells_per_side(polygons: int) -> int:
    """From the number of polygons of all layers: the more cells, the more of them lie wholly inside a polygon."""
    return int(min(max((MAX_BROADCAST_CELLS / 2 / max(polygons, 1)) ** 0.5, MIN_CELLS_PER_SIDE), MAX_CELLS_PER_SIDE))


def dealt(layer: DataFrame, polygons: int) -> DataFrame:
    """A polygon table is often one small file, which would be cut into cells by one task."""
    tasks = min(-(-polygons // POLYGONS_PER_TASK), layer.sparkSession.sparkContext.defaultParallelism)
    return layer.repartition(tasks) if tasks > 1 else layer


def polygon_cells(layer: DataFrame, per_side: int) -> DataFrame:
    """(level, cell_x, cell_y, poly_id, poly_name, whole, edges): the polygon pieces each cell needs."""
    return polygon_pieces(layer, per_side).withColumn("edges", crossable(F.col("edges")))


def polygon_pieces(layer: DataFrame, per_side: int) -> DataFrame:
    """``polygon_cells`` before edges that cannot be crossed are left out, so that the pieces can be cut finer."""
    boxed = layer.select("poly_id", "poly_name", "edges", *[
        c.alias(n) for n, c in edge_extent(F.col("edges")).items()]).filter(F.col("min_x").isNotNull())
    side = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"))
    boxed = boxed.withColumn("side", side).filter("side > 0").withColumn(
        "level", F.ceil(F.log2(F.col("side") / per_side)).cast("int"))
    size = F.pow(F.lit(2.0), F.col("level"))
    return _cut(boxed.withColumn("cell_x", F.explode(F.sequence(_cell(F.col("min_x"), size), _cell(F.col("max_x"), size))))
                .withColumn("cell_y", F.explode(F.sequence(_cell(F.col("min_y"), size), _cell(F.col("max_y"), size)))))


def _cut(cells: DataFrame) -> DataFrame:
    """Rows of a cell and the edges of a polygon: the edges that matter in the cell, and whether the polygon holds all of it;
    cells outside are dropped."""
    size = F.pow(F.lit(2.0), F.col("level"))
    mid_x, mid_y, half = (F.col("cell_x") + 0.5) * size, (F.col("cell_y") + 0.5) * size, (0.5 + CELL_MARGIN) * size

    def touches(e: Column) -> Column:
        """Whether an edge of the band comes into the cell: it begins left of the cell's right side, and its line has corners of
        the cell on both sides."""
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        return (F.least(e["x1"], e["x2"]) <= mid_x + half) & (
            F.abs(dx * (mid_y - e["y1"]) - dy * (mid_x - e["x1"])) <= half * (F.abs(dx) + F.abs(dy)))

    local = F.filter("edges", lambda e: (F.greatest(e["y1"], e["y2"]) >= mid_y - half)
                     & (F.least(e["y1"], e["y2"]) <= mid_y + half)
                     & (F.greatest(e["x1"], e["x2"]) >= mid_x - half))
    pieces = cells.withColumn("edges", local).withColumn("whole", ~F.exists("edges", touches))
    judged = pieces.filter(~F.col("whole") | contains_point(crossable(F.col("edges")), mid_x, mid_y))
    kept_edges = F.when(F.col("whole"), F.slice("edges", 1, 0)).otherwise(F.col("edges"))
    return judged.select("level", "cell_x", "cell_y", "poly_id", "poly_name", "whole", kept_edges.alias("edges"),
                         *[c for c in cells.columns if c == "layer"])


def _cell(value: Column, size: Column) -> Column:
    return F.floor(value / size).cast("bigint")


def _holds(whole: Column, edges: Column) -> Column:
    """Whether a polygon piece holds the point of its row."""
    return whole | contains_point(edges, F.col("_x"), F.col("_y"))


def first_candidates(pieces: DataFrame) -> DataFrame:
    """The pieces that can hold the smallest polygon of a point, as told above, with the columns of ``pieces``; of pieces with
    the same edges in a cell the smallest.

    ``pieces`` is read several times. Grids are compared by shifting cell numbers: sides are powers of two, so every cell lies in one
    cell of each coarser grid.
    """
    shape = F.struct("poly_id", "poly_name")
    levels = pieces.groupBy("layer").agg(F.collect_set("level").alias("_levels"))
    whole = pieces.filter("whole").groupBy(*CELL).agg(F.min(shape).alias("_shape"))
    above = whole.withColumnsRenamed({"level": "_up", "cell_x": "_ux", "cell_y": "_uy"})
    least = (
        pieces.select(*CELL).distinct().join(F.broadcast(levels), "layer")
        .withColumn("_up", F.explode(F.filter("_levels", lambda up: up >= F.col("level"))))
        .withColumns({"_ux": F.expr("shiftright(cell_x, _up - level)"), "_uy": F.expr("shiftright(cell_y, _up - level)")})
        .join(above, ["layer", "_up", "_ux", "_uy"]).groupBy(*CELL).agg(F.min("_shape").alias("_least"))
    )
    parts = pieces.filter("not whole").join(least, CELL, "left").filter(
        F.col("_least").isNull() | (shape < F.col("_least"))).groupBy(*CELL, "edges").agg(F.min(shape).alias("_shape"))
    holders = whole.join(least, CELL).filter(F.col("_shape") == F.col("_least")).withColumn(
        "edges", F.array().cast(pieces.schema["edges"].dataType))
    return parts.withColumn("whole", F.lit(False)).unionByName(
        holders.drop("_least").withColumn("whole", F.lit(True))).withColumns(
        {"poly_id": F.col("_shape.poly_id"), "poly_name": F.col("_shape.poly_name")}).select(*pieces.columns)


def first_cells(pieces: DataFrame, polygons: int) -> DataFrame:
    """``first_candidates``, with crowded cells cut into finer ones until they are not: the finer a cell, the more of its shapes
    hold all of it, and the smallest of these rules the others out."""
    kept = stage(first_candidates(pieces), "candidates")
    for _ in range(MAX_CUTS):
        crowded = kept.filter("not whole").groupBy(*CELL).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > CROWD)
        n = crowded.agg(F.sum("_n")).first()[0] or 0
        if not n or n * 4 ** CUT > MAX_PIECES_PER_POLYGON * polygons:
            break
        marked = kept.join(crowded, CELL, "left")
        calm = marked.filter("whole or _n is null").drop("_n")
        finer = marked.filter("not whole and _n is not null").withColumn("level", F.col("level") - CUT)
        for c in ("cell_x", "cell_y"):
            finer = finer.withColumn(c, F.explode(F.sequence(F.col(c) * 2 ** CUT, F.col(c) * 2 ** CUT + 2 ** CUT - 1)))
        kept = stage(first_candidates(stage(calm.unionByName(_cut(finer)), "cells")), "candidates")
    return kept


def locate_layers(points: DataFrame, layers: Mapping[str, DataFrame], lon: str = "longitude", lat: str = "latitude",
                  on_overlap: str = "first", point_id: str | None = "id",
                  max_broadcast_cells: int = MAX_BROADCAST_CELLS,
                  max_broadcast_edges: int = MAX_BROADCAST_EDGES) -> DataFrame:
    """Left join of points with the polygons of several layers that hold them: adds a struct ``_in_<layer>`` of ``poly_id`` and
    ``poly_name`` per layer, null where none does.

    ``on_overlap="first"`` keeps the row count and takes the smallest poly_id; ``"all"`` gives one
    row per combination of holding polygons. Points without usable coordinates never match. ``point_id`` names a column that
    tells points of the same place apart, if there is one; it need not be unique.
    """
    if on_overlap not in ("first", "all"):
        raise ValueError("on_overlap is 'first' or 'all'")
    polygons = count_polygons(layers)
    per_side = cells_per_side(sum(polygons.values()))
    cells = stage(reduce(DataFrame.unionByName, [
        polygon_pieces(dealt(layer, polygons.get(name, 0)), per_side).withColumn("layer", F.lit(name))
        for name, layer in layers.items()]), "cells")
    if on_overlap == "first":
        cells = first_cells(cells, sum(polygons.values()))
    cells = cells.withColumn("edges", crossable(F.col("edges")))
    weight = cells.groupBy("layer", "level").agg(
        F.count(F.lit(1)).alias("cells"), F.sum(F.size("edges")).alias("edges")).orderBy("layer", "level").collect()
    grids = [(r["layer"], r["level"]) for r in weight]
    small = not grids or (max_broadcast_cells > 0 and sum(r["cells"] for r in weight) <= max_broadcast_cells
                          and sum(r["edges"] or 0 for r in weight) <= max_broadcast_edges)
    placed = points.withColumns({"_x": F.col(lon).try_cast("double"), "_y": F.col(lat).try_cast("double")})
    if small:
        found = _locate_bounded(placed, cells, grids, list(layers), on_overlap)
    else:
        found = _locate_large(placed, cells, grids, list(layers), on_overlap, point_id)
    return found.drop("_x", "_y")


def locate(points: DataFrame, layer: DataFrame, lon: str = "longitude", lat: str = "latitude",
           on_overlap: str = "first", point_id: str | None = "id",
           max_broadcast_cells: int = MAX_BROADCAST_CELLS,
           max_broadcast_edges: int = MAX_BROADCAST_EDGES) -> DataFrame:
    """``locate_layers`` with one layer: adds ``poly_id`` and ``poly_name``."""
    found = locate_layers(points, {"layer": layer}, lon, lat, on_overlap, point_id, max_broadcast_cells, max_broadcast_edges)
    return found.withColumns({"poly_id": F.col("_in_layer.poly_id"), "poly_name": F.col("_in_layer.poly_name")}).drop("_in_layer")


def _locate_bounded(placed: DataFrame, cells: DataFrame, grids: Sequence[Grid], names: Sequence[str],
                    on_overlap: str) -> DataFrame:
    columns, lists = placed.columns, {name: [] for name in names}
    for k, (name, level) in enumerate(grids):
        size = F.lit(2.0 ** level)
        per_cell = F.broadcast(cells.filter((F.col("layer") == name) & (F.col("level") == level)).groupBy("cell_x", "cell_y").agg(
            F.collect_list(F.struct("poly_id", "poly_name", "whole", "edges")).alias(f"_near_{k}")))
        placed = placed.join(per_cell, (_cell(F.col("_x"), size) == F.col("cell_x"))
                             & (_cell(F.col("_y"), size) == F.col("cell_y")), "left").drop("cell_x", "cell_y")
        hits = F.transform(F.filter(F.col(f"_near_{k}"), lambda c: _holds(c["whole"], c["edges"])),
                           lambda c: F.struct(c["poly_id"].alias("poly_id"), c["poly_name"].alias("poly_name")))
        lists[name].append(hits)
    none = F.lit(None).cast("struct<poly_id: string, poly_name: string>")
    if on_overlap == "first":
        # the smallest of a grid's smallest; least skips nulls
        firsts = {name: [F.array_min(hits) for hits in found] for name, found in lists.items()}
        return placed.select(*columns, *[
            (F.least(*f) if len(f) > 1 else f[0] if f else none).alias(f"_in_{name}") for name, f in firsts.items()])
    empty = F.array().cast("array<struct<poly_id: string, poly_name: string>>")
    for name, found in lists.items():
        every = F.concat(*[F.coalesce(hits, empty) for hits in found]) if found else empty
        placed = placed.withColumn(f"_in_{name}", F.explode_outer(every))
    return placed.select(*columns, *[f"_in_{name}" for name in names])


def _locate_large(placed: DataFrame, cells: DataFrame, grids: Sequence[Grid], names: Sequence[str], on_overlap: str,
                  point_id: str | None) -> DataFrame:
    used = F.array(*[F.struct(F.lit(name).alias("layer"), F.lit(level).alias("level")) for name, level in grids])
    size = F.pow(F.lit(2.0), F.col("_grid.level"))
    key, place = ["_layer", "_level", "_cx", "_cy"], ["_x", "_y"]
    places = placed.filter("_x is not null and _y is not null").groupBy(*place).agg(F.count(F.lit(1)).alias("_n"))
    narrow = places.select(*place, F.explode(used).alias("_grid")).select(
        *place, F.col("_grid.layer").alias("_layer"), F.col("_grid.level").alias("_level"),
        _cell(F.col("_x"), size).alias("_cx"), _cell(F.col("_y"), size).alias("_cy"))
    hot = narrow.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / POINTS_PER_SALT).alias("_salts")).filter("_salts > 1")
    salts = F.coalesce("_salts", F.lit(1))
    every_salt = F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1))
    salted = narrow.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(*place), salts)).drop("_salts")
    pieces = cells.withColumnsRenamed({"layer": "_layer", "level": "_level", "cell_x": "_cx", "cell_y": "_cy"})
    copies = pieces.join(hot, key, "left").withColumn("_salt", every_salt).drop("_salts")
    matches = salted.join(copies, [*key, "_salt"]).filter(_holds(F.col("whole"), F.col("edges")))
    hits = matches.select(*place, "_layer", F.struct("poly_id", "poly_name").alias("_hit"))
    # at most one in POINTS_PER_SALT points is such a place
    busy = places.select(*place, F.ceil(F.col("_n") / POINTS_PER_SALT).alias("_salts")).filter("_salts > 1")
    mark = F.xxhash64(point_id) if point_id else F.monotonically_increasing_id()
    # points without a place find nothing, wherever they go
    salt = F.when(F.col("_x").isNull() | F.col("_y").isNull(), mark).otherwise(F.pmod(mark, salts))
    placed = placed.join(F.broadcast(busy), place, "left").withColumn("_salt", salt).drop("_salts")

    def back(found: DataFrame) -> DataFrame:
        return placed.join(found.join(F.broadcast(busy), place, "left").withColumn("_salt", every_salt).drop("_salts"), [*place, "_salt"], "left")

    if on_overlap == "first":
        return back(hits.groupBy(*place).agg(*[
            F.min(F.when(F.col("_layer") == name, F.col("_hit"))).alias(f"_in_{name}") for name in names])).drop("_salt")
    for name in names:
        placed = back(hits.filter(F.col("_layer") == name).select(*place, F.col("_hit").alias(f"_in_{name}")))
    return placed.drop("_salt")


def source_or_boundary(source: Column, boundary: Column) -> Column:
    """A non-blank source value wins, the polygon is the fallback."""
    return F.coalesce(F.nullif(F.trim(source), F.lit("")), boundary)


def fill_from_layers(df: DataFrame, layers: Mapping[str, tuple[DataFrame, str, str | None]], **locate_options) -> DataFrame:
    """Fill ``id_col`` (and ``name_col``) of each layer, given as name -> (layer, id_col, name_col), from the polygon that holds the
    point; all layers in one pass over the points."""
    located = locate_layers(df, {name: layer for name, (layer, _, _) in layers.items()}, **locate_options)
    filled = {}
    for name, (_, id_col, name_col) in layers.items():
        filled[id_col] = source_or_boundary(F.col(id_col), F.col(f"_in_{name}.poly_id"))
        if name_col:
            filled[name_col] = source_or_boundary(F.col(name_col), F.col(f"_in_{name}.poly_name"))
    return located.withColumns(filled).select(*df.columns)


def fill_from_layer(df: DataFrame, layer: DataFrame, id_col: str, name_col: str | None = None,
                    **locate_options) -> DataFrame:
    """One enrichment step."""
    return fill_from_layers(df, {"layer": (layer, id_col, name_col)}, **locate_options)
