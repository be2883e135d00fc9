"""Property graph tables, retention and pattern counts."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from tallyward.catalog import inputs
from tallyward.catalog.oracle_blocks import LAST_DAY, with_silver
from tallyward.functions.taxonomy import TAXONOMY_COLUMNS
from tallyward.operators import graph as g
from tallyward.operators.layout import stage

RETENTION = 1500
TREND_START = "1997-03-01"
VIOLENT_RANGE = ("1998-01-01", "1999-12-31")
#: What the graph reads of silver.
SILVER_COLUMNS = [
    "id", "case_number", "date", "block", "primary_type", "description", "location_description", "arrest", "domestic",
    "beat", "district", "ward", "community_area", "community_area_name", "district_name", "latitude", "longitude",
    "updated_on", *TAXONOMY_COLUMNS]
AREA_TEXT, OFFENSE = "nation_1", "Theft"


def stored(spark, sf, *names, located=True):
    """The graph with the named tables stored: the incidents are computed once, each of these tables is written once.
    Area and district names need the spatial step; queries that read none do without (``located=False``)."""
    silver = stage(inputs.silver(spark, sf, located=located).select(*SILVER_COLUMNS), "silver")
    return {name: stage(df, name) if name in names else df for name, df in g.build_graph(silver, "md5").items()}


def crime_nodes(spark, sf):
    return stored(spark, sf)["Crime"]


def case_nodes(spark, sf):
    """F6 on repeated case numbers: the lines of an order share one, the newest incident makes the node."""
    silver = stage(inputs.silver(spark, sf).select(*SILVER_COLUMNS), "silver").withColumn(
        "case_number", F.concat(F.lit("CASE"), (F.col("id") / 8).cast("bigint").cast("string")))
    return g.build_graph(silver, "md5")["Crime"].select("case_number", "primary_type", "beat_id", "ward_id", "arrest")


CASE_NODES = with_silver("""SELECT case_number, primary_type, beat AS beat_id, ward AS ward_id, arrest FROM (
  SELECT *, row_number() OVER (PARTITION BY case_number ORDER BY "date" DESC NULLS LAST, id DESC) AS rn FROM (
    SELECT * REPLACE ('CASE' || (id // 8) AS case_number) FROM silver)) WHERE rn = 1""")


def date_nodes(spark, sf):
    return stored(spark, sf)["Date"]


def location_nodes(spark, sf):
    return stored(spark, sf)["Location"]


def crime_type_nodes(spark, sf):
    return stored(spark, sf)["CrimeType"]


def edges(spark, sf):
    return stored(spark, sf)["edges"]


_TEXT_KEY = ("concat_ws('|', coalesce(trim(community_area_name), 'Unknown'), coalesce(trim(district_name), 'Unknown'), "
             "coalesce(trim(block), 'Unknown'), coalesce(trim(location_description), 'Unknown'))")
GRAPH_CTES = [
    f"""src AS MATERIALIZED (SELECT *, {_TEXT_KEY} AS location_text_key, strftime("date", '%Y-%m-%d') AS date_label FROM silver)""",
    """crime AS (SELECT case_number, primary_type, description, crime_category, crime_offense_group, crime_offense_subtype,
  arrest, domestic, beat AS beat_id, district AS district_id, ward AS ward_id, community_area AS community_area_id,
  district_name, community_area_name FROM src)""",
    """dates AS (SELECT DISTINCT date_label, strftime("date", '%Y%m%d') AS yyyymmdd_key, CAST("date" AS DATE) AS full_date,
  CAST(isodow("date") - 1 AS INTEGER) AS day_of_week, CAST(month("date") AS INTEGER) AS "month",
  CAST(year("date") AS INTEGER) AS "year" FROM src)""",
    """places AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY location_text_key ORDER BY
    latitude NULLS LAST, longitude NULLS LAST, location_description NULLS LAST, block NULLS LAST, beat_id NULLS LAST,
    district_id NULLS LAST, ward_id NULLS LAST, community_area_id NULLS LAST, district_name NULLS LAST,
    community_area_name NULLS LAST) AS rn FROM (
  SELECT location_text_key, latitude, longitude, location_description, block, beat AS beat_id, district AS district_id,
    ward AS ward_id, community_area AS community_area_id, district_name, community_area_name FROM src)) WHERE rn = 1)""",
    """types AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY crime_type_key ORDER BY
    crime_offense_label, crime_category, crime_offense_group) AS rn FROM (
  SELECT crime_type_key, crime_offense_label, crime_category, crime_offense_group, crime_offense_subtype,
    violent_crime_flag, property_crime_flag, drug_crime_flag, weapon_crime_flag FROM src)) WHERE rn = 1)""",
    """edges AS (SELECT case_number AS src, 'OCCURRED_ON' AS "type", date_label AS dst FROM src
  UNION ALL SELECT case_number, 'OCCURRED_AT', location_text_key FROM src
  UNION ALL SELECT case_number, 'IS_OF_TYPE', CAST(crime_type_key AS VARCHAR) FROM src)""",
]


def with_graph(body: str, extra: list[str] | None = None) -> str:
    return with_silver(body, located=True, extra=[*GRAPH_CTES, *(extra or [])])


def _today(spark, sf):
    return inputs.first_last_day(spark, sf)[1]


def pruned(spark, sf):
    """Prune, then drop what dangles; rows left per table plus what was deleted."""
    before = stored(spark, sf, "Crime", "Location", "CrimeType", "edges")
    after = g.prune(before, _today(spark, sf), RETENTION)
    after = {**after, "edges": stage(after["edges"], "edges")}
    cleaned, deleted = g.drop_dangling(after)

    def size(kind, name, df):
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), F.lit(name).alias("name"), "n")

    parts = [size("left", name, cleaned[name]) for name in ("Crime", "Date", "Location", "CrimeType", "edges")]
    parts.append(deleted.select(F.lit("deleted").alias("kind"), F.col("label").alias("name"), F.col("deleted_nodes").alias("n")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def pruned_by_days(spark, sf):
    """J6, J7, C19 by days and degrees: what ``graph_prune`` reports, without comparing all edges with the removed incidents."""
    silver = stage(inputs.silver(spark, sf, located=True).select(*SILVER_COLUMNS), "silver")
    graph = {name: stage(df, name) if name in ("Crime", "Location", "CrimeType", "edges") else df
             for name, df in g.dated_graph(silver, "md5").items()}
    degrees = stage(g.node_degrees(graph), "degrees")
    cleaned, _, deleted = g.prune_days(graph, degrees, _today(spark, sf), RETENTION)
    sizes = [cleaned[name].agg(F.count(F.lit(1)).alias("n")).select(F.lit("left").alias("kind"), F.lit(name).alias("name"), "n")
             for name in ("Crime", "Date", "Location", "CrimeType", "edges")]
    out = deleted.groupBy(F.col("label").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("deleted").alias("kind"), "name", "n")
    for part in sizes:
        out = out.unionByName(part)
    return out


def pruned_edges(spark, sf):
    """The edges that survive, as rows."""
    return g.prune(stored(spark, sf, "edges"), _today(spark, sf), RETENTION)["edges"]


def dangling_nodes(spark, sf):
    """C19 after a prune, as rows."""
    return g.dangling(g.prune(stored(spark, sf, "edges"), _today(spark, sf), RETENTION))


_PRUNE_CTES = [
    f"cutoff AS (SELECT strftime({LAST_DAY} - {RETENTION}, '%Y-%m-%d') AS c)",
    "stored AS MATERIALIZED (SELECT * FROM edges)",
    """gone AS MATERIALIZED (SELECT DISTINCT src FROM stored, cutoff WHERE "type" = 'OCCURRED_ON' AND dst < c)""",
    "kept AS MATERIALIZED (SELECT e.* FROM stored e WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.src = e.src))",
    """lost AS (SELECT 'Location' AS label, location_text_key AS key FROM places
    WHERE NOT EXISTS (SELECT 1 FROM kept WHERE "type" = 'OCCURRED_AT' AND dst = location_text_key)
  UNION ALL SELECT 'CrimeType', CAST(crime_type_key AS VARCHAR) FROM types
    WHERE NOT EXISTS (SELECT 1 FROM kept WHERE "type" = 'IS_OF_TYPE' AND dst = CAST(crime_type_key AS VARCHAR)))""",
]
PRUNED = with_graph("""SELECT 'left' AS kind, 'Crime' AS name, count(*) AS n FROM crime WHERE NOT EXISTS (SELECT 1 FROM gone WHERE src = case_number)
UNION ALL SELECT 'left', 'Date', count(*) FROM dates WHERE date_label >= (SELECT c FROM cutoff)
UNION ALL SELECT 'left', 'Location', (SELECT count(*) FROM places) - count(*) FROM lost WHERE label = 'Location'
UNION ALL SELECT 'left', 'CrimeType', (SELECT count(*) FROM types) - count(*) FROM lost WHERE label = 'CrimeType'
UNION ALL SELECT 'left', 'edges', count(*) FROM kept
UNION ALL SELECT 'deleted', label, count(*) FROM lost GROUP BY label""", _PRUNE_CTES)


def violent_count(spark, sf):
    return g.violent_between(stored(spark, sf, "edges", located=False), *VIOLENT_RANGE)


def area_group_count(spark, sf):
    return g.group_in_area(stored(spark, sf), AREA_TEXT, OFFENSE)


def month_trend(spark, sf):
    return g.month_trend(stored(spark, sf, located=False), TREND_START)


def coverage(spark, sf):
    """Incidents per day inside the span that may be asked for."""
    silver = inputs.silver(spark, sf).withColumn("day", F.to_date("date"))
    last = _today(spark, sf)
    rows = g.clamp_coverage(silver, "day", last, last - timedelta(days=700))
    return rows.groupBy("day").agg(F.count(F.lit(1)).alias("incidents"))


def edge_upsert(spark, sf):
    """Loading the same batch twice leaves nodes and edges as they were."""
    from tallyward.sources.tables import upsert, upsert_edges

    graph = stored(spark, sf, "edges", "CrimeType")
    twice = upsert_edges(graph["edges"], graph["edges"])
    nodes = upsert(graph["CrimeType"], graph["CrimeType"], ["crime_type_key"])
    return twice.groupBy("type").agg(F.count(F.lit(1)).alias("rows")).unionByName(
        nodes.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("CrimeType").alias("type"), "rows"))


QUERIES = {
    "graph_crime_nodes": (crime_nodes, with_graph("SELECT * FROM crime")),
    "graph_case_nodes": (case_nodes, CASE_NODES),
    "graph_date_nodes": (date_nodes, with_graph("SELECT * FROM dates")),
    "graph_location_nodes": (location_nodes, with_graph("SELECT * FROM places")),
    "graph_type_nodes": (crime_type_nodes, with_graph("SELECT * FROM types")),
    "graph_edges": (edges, with_graph("SELECT * FROM edges")),
    "graph_prune": (pruned, PRUNED),
    "graph_prune_days": (pruned_by_days, PRUNED),
    "graph_pruned_edges": (pruned_edges, with_graph("SELECT * FROM kept", _PRUNE_CTES)),
    "graph_dangling": (dangling_nodes, with_graph("SELECT * FROM lost", _PRUNE_CTES)),
    "graph_violent_count": (violent_count, with_graph(f"""SELECT count(*) AS n FROM edges o
  JOIN edges t ON o.src = t.src AND t."type" = 'IS_OF_TYPE' JOIN types y ON CAST(y.crime_type_key AS VARCHAR) = t.dst
  WHERE o."type" = 'OCCURRED_ON' AND o.dst BETWEEN '{VIOLENT_RANGE[0]}' AND '{VIOLENT_RANGE[1]}' AND y.violent_crime_flag = 1""")),
    "graph_area_count": (area_group_count, with_graph(f"""SELECT count(*) AS n FROM crime
  WHERE lower(community_area_name) LIKE '%' || replace('{AREA_TEXT}', '_', '\\_') || '%' ESCAPE '\\'
  AND crime_offense_group = '{OFFENSE}'""")),
    "graph_month_trend": (month_trend, with_graph(f"""SELECT CAST(year("date") AS INTEGER) AS "year",
  CAST(month("date") AS INTEGER) AS "month", count(*) AS incidents FROM src WHERE date_label >= '{TREND_START}' GROUP BY 1, 2""")),
    "graph_upsert": (edge_upsert, with_graph("""SELECT "type", count(*) AS "rows" FROM edges GROUP BY 1
  UNION ALL SELECT 'CrimeType', count(*) FROM types""")),
    "coverage_clamp": (coverage, with_silver(f"""SELECT CAST("date" AS DATE) AS day, count(*) AS incidents FROM silver
  WHERE CAST("date" AS DATE) BETWEEN {LAST_DAY} - 700 AND {LAST_DAY} - 10 GROUP BY 1""")),
}
