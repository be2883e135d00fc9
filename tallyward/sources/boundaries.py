"""Boundary layers and area names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.functions.geometry import decode_wkb_rings, edges_from_rings, rings_from_geojson, rings_from_wkt
from tallyward.schema import (
    AREA_ID_CANDIDATES, AREA_NAME_CANDIDATES, first_present, lower_columns, pick_col, pick_label_col,
)

# Property names of boundary features, in order of preference.
FEATURE_ID_PROPERTIES = ["area_numbe", "area_num_1", "comarea_id"]
FEATURE_NAME_PROPERTIES = ["community", "name", "area"]

FEATURE_COLLECTION = """
type string, name string,
features array<struct<type: string, properties: map<string, string>,
                      geometry: struct<type: string, coordinates: string>>>
"""


def boundary_layer(raw: DataFrame, role: str) -> DataFrame:
    """A layer (poly_id, poly_name, edges) from a boundary table whose columns are found by name.

    The geometry may be WKB binary or WKT text.
    """
    df = lower_columns(raw)
    id_col, geom_col = pick_col(df.columns, role), pick_col(df.columns, "geometry")
    if not id_col or not geom_col:
        raise ValueError(f"no id or geometry column for {role!r} among {df.columns}")
    name_col = pick_label_col(df.columns, id_col, geom_col)
    named = df.select(
        F.col(id_col).cast("string").alias("poly_id"),
        (F.col(name_col).cast("string") if name_col else F.lit(None).cast("string")).alias("poly_name"),
        F.col(geom_col).alias("_geom"),
    )
    if dict(named.dtypes)["_geom"] == "binary":
        rings = decode_wkb_rings(named, "_geom")
    else:
        rings = named.withColumn("rings", rings_from_wkt(F.col("_geom")))
    return rings.select("poly_id", "poly_name", edges_from_rings(F.col("rings")).alias("edges"))


def read_boundary(spark: SparkSession, path: str, role: str) -> DataFrame:
    """A6."""
    return boundary_layer(spark.read.parquet(path), role)


def feature_id(properties: Column) -> Column:
    """First non-empty id property, read as int(float(x)); null when unreadable."""
    return _first_text(properties, FEATURE_ID_PROPERTIES).try_cast("double").try_cast("int")


def feature_name(properties: Column, area_id: Column) -> Column:
    """First non-empty name property, else the id as text."""
    return F.coalesce(_first_text(properties, FEATURE_NAME_PROPERTIES), area_id.cast("string"))


def _first_text(properties: Column, names: list[str]) -> Column:
    return F.coalesce(*[F.nullif(F.element_at(properties, n), F.lit("")) for n in names])


def normalize_features(features: DataFrame, properties_col: str = "properties") -> DataFrame:
    """Add area_id and area_name; features without a readable id are dropped."""
    with_id = features.withColumn("area_id", feature_id(F.col(properties_col)))
    return (with_id.filter(F.col("area_id").isNotNull())
            .withColumn("area_name", feature_name(F.col(properties_col), F.col("area_id"))))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(area_id, area_name, kind, coordinates, edges) per feature of a FeatureCollection file.

    A file that is already normalized carries area_id and name as properties.
    """
    features = (spark.read.schema(FEATURE_COLLECTION).json(path, multiLine=True)
                .select(F.explode("features").alias("f"))
                .select("f.properties", F.col("f.geometry.type").alias("kind"),
                        F.col("f.geometry.coordinates").alias("coordinates")))
    ready = F.element_at("properties", "area_id").try_cast("int")
    merged = F.when(
        ready.isNotNull() & feature_id(F.col("properties")).isNull(),
        F.map_concat("properties", F.create_map(F.lit("area_numbe"), ready.cast("string"))),
    ).otherwise(F.col("properties"))
    out = normalize_features(features.withColumn("properties", merged))
    rings = rings_from_geojson(F.col("kind"), F.col("coordinates"))
    return out.select("area_id", "area_name", "kind", "coordinates", edges_from_rings(rings).alias("edges"))


def geojson_layer(features: DataFrame) -> DataFrame:
    """A GeoJSON table as a boundary layer."""
    return features.select(F.col("area_id").cast("string").alias("poly_id"),
                           F.col("area_name").alias("poly_name"), "edges")


def area_names(ref: DataFrame) -> DataFrame | None:
    """(area_id, area_name) from a table of unknown shape, or None when a role is missing."""
    id_col = first_present(ref.columns, AREA_ID_CANDIDATES)
    name_col = first_present(ref.columns, AREA_NAME_CANDIDATES)
    if not id_col or not name_col:
        return None
    return ref.select(F.col(id_col).try_cast("double").try_cast("int").alias("area_id"),
                      F.col(name_col).cast("string").alias("area_name"))
