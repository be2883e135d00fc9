"""Landing, dedupe, silver and spatial queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyward.catalog import inputs
from tallyward.catalog.oracle_blocks import EVENT_KIND, classified, hits_cte, layer_ctes, with_landing, with_silver
from tallyward.functions.taxonomy import FLAG_CATEGORY, TAXONOMY_COLUMNS, ensure_taxonomy
from tallyward.operators.dedupe import dedupe_landing, full_order, keep_latest
from tallyward.operators.layout import spread
from tallyward.operators.spatial import locate, locate_layers
from tallyward.session import scratch_path
from tallyward.sources.boundaries import boundary_layer, normalize_features
from tallyward.sources.landing import read_landing, write_landing


def dedupe_latest(spark, sf):
    df = inputs.table(spark, sf, "lineitem")
    keys = ["l_orderkey", "l_linenumber"]
    return keep_latest(df, keys, full_order(df, [F.desc_nulls_last("l_shipdate")], skip=[*keys, "l_shipdate"]))


DEDUPE_LATEST = """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY l_shipdate DESC NULLS LAST, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
  l_returnflag, l_linestatus) AS rn FROM lineitem) WHERE rn = 1"""


def landing_dedupe(spark, sf):
    return dedupe_landing(inputs.landing(spark, sf))


LANDING_DEDUPE = with_landing("""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id
  ORDER BY TRY_CAST(updated_on AS TIMESTAMP) DESC NULLS LAST, case_number NULLS LAST, "date" NULLS LAST,
  block NULLS LAST, iucr NULLS LAST, primary_type NULLS LAST, description NULLS LAST, location_description NULLS LAST,
  arrest NULLS LAST, domestic NULLS LAST, beat NULLS LAST, district NULLS LAST, ward NULLS LAST,
  community_area NULLS LAST, fbi_code NULLS LAST, x_coordinate NULLS LAST, y_coordinate NULLS LAST, "year" NULLS LAST,
  updated_on NULLS LAST, latitude NULLS LAST, longitude NULLS LAST, "location" NULLS LAST) AS rn
  FROM landing) WHERE rn = 1""")


def landing_days(spark, sf):
    """A2, A3: the events of every day through the landing folder, written twice, read back whole."""
    full = inputs.event_landing(spark, sf)
    path = scratch_path(spark, "landing")
    write_landing(full, path)
    write_landing(full, path)
    return read_landing(spark, path).groupBy(F.substring("date", 1, 10).alias("day"), "primary_type").agg(
        F.count(F.lit(1)).alias("records"), F.countDistinct("id").alias("ids"),
        F.countDistinct("community_area").alias("areas"))


LANDING_DAYS = f"""SELECT strftime(ts, '%Y-%m-%d') AS day, {EVENT_KIND} AS primary_type, count(*) AS records,
  count(DISTINCT event_id) AS ids, count(DISTINCT user_id % 77) AS areas FROM events GROUP BY 1, 2"""


def silver_incidents(spark, sf):
    return inputs.naive_times(inputs.silver(spark, sf))


def silver_located(spark, sf):
    return inputs.naive_times(inputs.silver(spark, sf, located=True))


def taxonomy(spark, sf):
    """B15 on a partly classified frame: stale columns are dropped and all fourteen recomputed."""
    stale = inputs.landing(spark, sf).withColumn("crime_category", F.lit("stale"))
    full = ensure_taxonomy(stale, key_method="md5")
    full = full.withColumns({c: F.col(c).cast("bigint") for c in FLAG_CATEGORY})
    return full.groupBy("primary_type", "description", "iucr", *TAXONOMY_COLUMNS).agg(F.count(F.lit(1)).alias("records"))


_TAX = ", ".join(TAXONOMY_COLUMNS)
TAXONOMY = with_silver(f"""SELECT primary_type, description, iucr, {_TAX}, count(*) AS records FROM tax GROUP BY ALL""",
                       extra=["tax AS (" + classified("landing") + ")"])


def pip_join(spark, sf):
    """Every lineitem's point against overlapping shapes with holes and parts, all matches kept."""
    points = spread(inputs.table(spark, sf, "lineitem")).selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        f"{inputs.LANDING_EXPRESSIONS['longitude']} as longitude",
        f"{inputs.LANDING_EXPRESSIONS['latitude']} as latitude")
    layer = boundary_layer(inputs.raw_boundary(spark, sf, "districts"), "district")
    return per_polygon(locate(points, layer, on_overlap="all", point_id=None))


def pip_join_many(spark, sf):
    """C2 with one polygon per supplier, on the salted cell join that large polygon tables take."""
    points = spread(inputs.table(spark, sf, "lineitem")).selectExpr(
        "struct(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) as pid",
        "l_orderkey", "l_partkey", f"{inputs.LANDING_EXPRESSIONS['longitude']} as longitude",
        f"{inputs.LANDING_EXPRESSIONS['latitude']} as latitude")
    points = points.withColumn("pid", F.to_json("pid"))
    layer = boundary_layer(inputs.raw_boundary(spark, sf, "beats"), "beat")
    return per_polygon(locate(points, layer, on_overlap="all", point_id="pid", max_broadcast_cells=0))


def silver_located_many(spark, sf):
    """C2, C4 at size: shapes of 1 to 1,024 times the extent and the districts, both in one pass of the shuffled form."""
    points = spread(inputs.table(spark, sf, "lineitem")).selectExpr(
        "to_json(struct(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate)) as pid",
        "l_orderkey", "l_partkey", f"{inputs.LANDING_EXPRESSIONS['longitude']} as longitude",
        f"{inputs.LANDING_EXPRESSIONS['latitude']} as latitude")
    layers = {name: boundary_layer(inputs.raw_boundary(spark, sf, name), role)
              for name, role in (("diamonds", "beat"), ("districts", "district"))}
    found = locate_layers(points, layers, point_id="pid", max_broadcast_cells=0)
    return found.groupBy(
        F.col("_in_diamonds.poly_id").alias("diamond"), F.col("_in_diamonds.poly_name").alias("diamond_name"),
        F.col("_in_districts.poly_id").alias("district")).agg(
        F.count(F.lit(1)).alias("points"), F.sum("l_orderkey").alias("order_sum"), F.sum("l_partkey").alias("part_sum"))


def _located_many_sql() -> str:
    return f"""WITH pts AS (SELECT row_number() OVER () AS id, l_orderkey, l_partkey,
  CAST({inputs.LANDING_EXPRESSIONS['longitude']} AS DOUBLE) AS px,
  CAST({inputs.LANDING_EXPRESSIONS['latitude']} AS DOUBLE) AS py FROM lineitem),
{layer_ctes('diamonds')},
{hits_cte('diamonds', 'pts')},
{layer_ctes('districts')},
{hits_cte('districts', 'pts')}
SELECT a.poly_id AS diamond, a.poly_name AS diamond_name, b.poly_id AS district, count(*) AS points,
  CAST(sum(p.l_orderkey) AS BIGINT) AS order_sum, CAST(sum(p.l_partkey) AS BIGINT) AS part_sum
FROM pts p LEFT JOIN first_diamonds a ON a.id = p.id LEFT JOIN first_districts b ON b.id = p.id GROUP BY 1, 2, 3"""


def per_polygon(located):
    return located.groupBy("poly_id", "poly_name").agg(
        F.count(F.lit(1)).alias("points"), F.sum("l_orderkey").alias("order_sum"), F.sum("l_partkey").alias("part_sum"))


def _pip_sql(layer: str) -> str:
    return f"""WITH pts AS (SELECT row_number() OVER () AS id, l_orderkey, l_partkey,
  CAST({inputs.LANDING_EXPRESSIONS['longitude']} AS DOUBLE) AS px,
  CAST({inputs.LANDING_EXPRESSIONS['latitude']} AS DOUBLE) AS py FROM lineitem),
{layer_ctes(layer)},
{hits_cte(layer, 'pts')}
SELECT h.poly_id, h.poly_name, count(*) AS points, CAST(sum(p.l_orderkey) AS BIGINT) AS order_sum,
  CAST(sum(p.l_partkey) AS BIGINT) AS part_sum
FROM pts p LEFT JOIN hit_{layer} h ON p.id = h.id GROUP BY 1, 2"""


def geojson_normalize(spark, sf):
    """Feature properties of three shapes, one feature per customer."""
    k = "c_custkey"
    features = inputs.table(spark, sf, "customer").selectExpr(f"""map_filter(map(
      'area_numbe', case when {k} % 3 = 0 then cast({k} as string) || '.0' when {k} % 3 = 1 then '' end,
      'area_num_1', case when {k} % 3 = 1 then cast({k} as string) end,
      'comarea_id', case when {k} % 3 = 2 and {k} % 5 <> 0 then cast({k} as string) when {k} % 3 = 2 then 'n/a' end,
      'community', case when {k} % 2 = 0 then c_name end,
      'name', case when {k} % 7 = 0 then c_mktsegment end), (k, v) -> v is not null) as properties""")
    return normalize_features(features).select("area_id", "area_name")


GEOJSON_NORMALIZE = """SELECT CAST(c_custkey AS INTEGER) AS area_id,
  CASE WHEN c_custkey % 2 = 0 THEN c_name WHEN c_custkey % 7 = 0 THEN c_mktsegment
    ELSE CAST(c_custkey AS VARCHAR) END AS area_name
FROM customer WHERE c_custkey % 3 <> 2 OR c_custkey % 5 <> 0"""

QUERIES = {
    "dedupe_latest": (dedupe_latest, DEDUPE_LATEST),
    "landing_dedupe": (landing_dedupe, LANDING_DEDUPE),
    "landing_days": (landing_days, LANDING_DAYS),
    "silver_incidents": (silver_incidents, with_silver("SELECT * FROM silver")),
    "silver_located": (silver_located, with_silver("SELECT * FROM silver", located=True)),
    "silver_located_many": (silver_located_many, _located_many_sql()),
    "taxonomy": (taxonomy, TAXONOMY),
    "pip_join": (pip_join, _pip_sql("districts")),
    "pip_join_many": (pip_join_many, _pip_sql("beats")),
    "geojson_normalize": (geojson_normalize, GEOJSON_NORMALIZE),
}
