"""Idempotent writers, merges, evolution and quality suites."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyward.catalog import inputs
from tallyward.catalog.oracle_blocks import LAST_DAY, with_landing, with_silver
from tallyward.catalog.star_queries import FACT_ROWS, PLACE_ROWS, TYPE_ROWS
from tallyward.operators import dimensions as dim
from tallyward.operators import facts, quality
from tallyward.operators.joins import current_rows
from tallyward.operators.layout import stage
from tallyward.schema import evolve
from tallyward.session import scratch_path
from tallyward.sources.tables import merge_slices, replace_slices, upsert, upsert_slices


def _orders(spark, sf):
    """Orders by month of the order date."""
    return inputs.table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", F.trunc("o_orderdate", "month").alias("batch_month"))


def slice_replace(spark, sf):
    """Write all slices, rewrite the months of 1998 with doubled prices twice, read back."""
    orders, path = _orders(spark, sf), scratch_path(spark, "slices")
    replace_slices(orders, path, ["batch_month"])
    again = orders.filter(F.year("batch_month") == 1998).withColumn("o_totalprice", F.col("o_totalprice") * 2)
    for _ in range(2):
        replace_slices(again, path, ["batch_month"])
    return spark.read.parquet(path).groupBy("batch_month").agg(
        F.count(F.lit(1)).alias("orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("price"))


SLICE_REPLACE = """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS batch_month, count(*) AS orders,
  CAST(sum(CAST(CASE WHEN year(o_orderdate) = 1998 THEN o_totalprice * 2 ELSE o_totalprice END AS DECIMAL(18,2))) AS DOUBLE) AS price
FROM orders GROUP BY 1"""


def upsert_merge(spark, sf):
    """A21 in place: finished orders get a new status, half of them twice; other rows stay."""
    orders, path = _orders(spark, sf), scratch_path(spark, "upsert-target")
    replace_slices(orders, path, ["batch_month"])
    updates = orders.filter(F.col("o_orderstatus") == "F").withColumn("o_orderstatus", F.lit("X"))
    upsert_slices(spark, path, updates, ["o_orderkey"], "batch_month")
    upsert_slices(spark, path, updates.filter(F.col("o_orderkey") % 2 == 0), ["o_orderkey"], "batch_month")
    return spark.read.parquet(path).select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "batch_month")


UPSERT_MERGE = """SELECT o_orderkey, o_custkey, o_totalprice, CASE o_orderstatus WHEN 'F' THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
  CAST(date_trunc('month', o_orderdate) AS DATE) AS batch_month FROM orders"""


def upsert_customers(spark, sf):
    """A21 as a frame: suppliers share the key space of customers and win; new keys are added."""
    target = inputs.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    updates = inputs.table(spark, sf, "supplier").select(
        (F.col("s_suppkey") * 20).alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return upsert(target, updates, ["key"])


UPSERT_CUSTOMERS = """SELECT s_suppkey * 20 AS key, s_name AS name, s_acctbal AS balance FROM supplier
UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey * 20 FROM supplier)"""


def staging_merge(spark, sf):
    """Staging holds every line twice; all ship years are promoted, 1998 once more."""
    lines = inputs.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.year("l_shipdate").alias("process_year"))
    lines = lines.groupBy("process_year", "l_orderkey", "l_linenumber").agg(
        F.max("l_partkey").alias("l_partkey"), F.max("l_quantity").alias("l_quantity"))
    staging, final = scratch_path(spark, "staging"), scratch_path(spark, "final")
    replace_slices(lines.unionByName(lines), staging, ["process_year"])
    keys = ["l_orderkey", "l_linenumber"]
    merge_slices(spark, staging, final, keys, partition_col="process_year")
    merge_slices(spark, staging, final, keys, [1998], "process_year")
    return spark.read.parquet(final).groupBy("process_year").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("l_partkey").alias("part_sum"),
        F.sum("l_quantity").alias("quantity"))


STAGING_MERGE = """SELECT CAST(y AS INTEGER) AS process_year, count(*) AS lines, CAST(sum(p) AS BIGINT) AS part_sum, sum(q) AS quantity
FROM (SELECT year(l_shipdate) AS y, l_orderkey, l_linenumber, max(l_partkey) AS p, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2, 3)
GROUP BY 1"""


def schema_evolve(spark, sf):
    """Events written by an old job lack two columns; new days have them; read as one table."""
    events = inputs.table(spark, sf, "events").select("event_id", "event_type", "value", F.to_date("ts").alias("day"))
    path = scratch_path(spark, "evolve")
    old = events.filter(F.col("day") < "2024-01-15").select("event_id", "day")
    replace_slices(old, path, ["day"])
    replace_slices(events.filter(F.col("day") >= "2024-01-15"), path, ["day"])
    table = spark.read.option("mergeSchema", "true").parquet(path)
    return evolve(table, "event_type string, value double, note string").select("event_id", "event_type", "value", "note", "day")


SCHEMA_EVOLVE = """SELECT event_id, CASE WHEN ts >= TIMESTAMP '2024-01-15' THEN event_type END AS event_type,
  CASE WHEN ts >= TIMESTAMP '2024-01-15' THEN value END AS value, CAST(NULL AS VARCHAR) AS note, CAST(ts AS DATE) AS day FROM events"""


def dimension_current(spark, sf):
    """The location dimension appended by two batches, written twice, cut to current rows."""
    first, last = inputs.first_last_day(spark, sf)
    silver, path = stage(inputs.silver(spark, sf), "silver"), scratch_path(spark, "dim-location")
    for batch in (first, last, last):
        replace_slices(dim.location_dimension(silver, batch, "md5"), path, ["updated_date"])
    stored = spark.read.parquet(path)
    return current_rows(stored, "location_key", tie_break=["community_area"]).select(
        "location_key", "beat", "district", "community_area", "location_type", "updated_date")


DIMENSION_CURRENT = with_silver(f"""SELECT location_key, beat, district, community_area, location_type, {LAST_DAY} AS updated_date
FROM ({PLACE_ROWS})""")


def quality_suites(spark, sf):
    """Landing, silver and star suites over the whole history."""
    first, last = inputs.first_last_day(spark, sf)
    silver = stage(inputs.silver(spark, sf), "silver")
    dims = {
        "dim_date": dim.date_dimension_for(spark, last), "dim_time_of_day": dim.time_of_day_dimension(spark, last),
        "dim_location": dim.location_dimension(silver, last, "md5"),
        "dim_crime_type": dim.crime_type_dimension(silver, last, "md5"),
    }
    # every check of a suite reads its table
    fact = stage(facts.incident_fact(silver, F.col("process_date"), "md5"), "fact")
    return (quality.run_suite("bronze_parquet", last, inputs.landing(spark, sf))
            .unionByName(quality.run_suite("silver_iceberg", first, silver))
            .unionByName(quality.run_suite("gold_bi", last, fact, dims))
            .withColumn("observed", F.round("observed", 6)))


def check_sql(layer: str, name: str, observed: str, threshold: float, source: str, op: str = "<=") -> str:
    return (f"SELECT '{layer}' AS layer, '{name}' AS \"check\", o {op} {threshold} AS passed, round(o, 6) AS observed, "
            f"{threshold}::DOUBLE AS threshold FROM (SELECT CAST({observed} AS DOUBLE) AS o FROM {source})")


def null_rate_sql(column: str) -> str:
    return f"avg(CASE WHEN {column} IS NULL THEN 1.0 ELSE 0.0 END)"


QUALITY_CHECKS = [
    check_sql("bronze", "row_count>=1", "count(*)", 1.0, "landing", ">="),
    check_sql("bronze", "null_rate(id)", null_rate_sql("id"), 0.0, "landing"),
    check_sql("bronze", "null_rate(date)", null_rate_sql('"date"'), 0.0, "landing"),
    check_sql("bronze", "null_rate(latitude)", null_rate_sql("latitude"), 0.5, "landing"),
    check_sql("bronze", "schema(3 columns)", "0", 0.0, "(SELECT 1)"),
    check_sql("bronze", "unique(id)", "count(*)", 0.0, "(SELECT id FROM landing GROUP BY id HAVING count(*) > 1)"),
    check_sql("silver", "row_count>=1", "count(*)", 1.0, "silver", ">="),
    check_sql("silver", "null_rate(id)", null_rate_sql("id"), 0.0, "silver"),
    check_sql("silver", "null_rate(date)", null_rate_sql('"date"'), 0.0, "silver"),
    check_sql("silver", "null_rate(crime_category)", null_rate_sql("crime_category"), 0.0, "silver"),
    check_sql("silver", "accepted_values(crime_category)", "0", 0.0, "(SELECT 1)"),
    check_sql("silver", "range(latitude)", "count(CASE WHEN NOT latitude BETWEEN -90 AND 90 THEN 1 END)", 0.0, "silver"),
    check_sql("silver", "range(longitude)", "count(CASE WHEN NOT longitude BETWEEN -180 AND 180 THEN 1 END)", 0.0, "silver"),
    check_sql("silver", "freshness(process_date)",
           "date_diff('day', CAST(max(process_date) AS DATE), (SELECT min(CAST(l_shipdate AS DATE)) FROM lineitem))", 0.0, "silver"),
    check_sql("silver", "unique(id)", "count(*)", 0.0, "(SELECT id FROM silver GROUP BY id HAVING count(*) > 1)"),
    check_sql("gold", "row_count>=1", "count(*)", 1.0, "fact", ">="),
    check_sql("gold", "null_rate(incident_id)", null_rate_sql("incident_id"), 0.0, "fact"),
    check_sql("gold", "null_rate(date_key)", null_rate_sql("date_key"), 0.0, "fact"),
    check_sql("gold", "null_rate(beat)", null_rate_sql("beat"), 0.5, "fact"),
    check_sql("gold", "reference(date_key)", "count(DISTINCT date_key)", 0.0,
           f"(SELECT date_key FROM fact WHERE process_date NOT BETWEEN {LAST_DAY} - 1825 AND {LAST_DAY} + 365)"),
    check_sql("gold", "reference(location_key)", "count(DISTINCT location_key)", 0.0,
           "(SELECT location_key FROM fact WHERE location_key NOT IN (SELECT location_key FROM places))"),
    check_sql("gold", "reference(crime_type_key)", "count(DISTINCT crime_type_key)", 0.0,
           "(SELECT crime_type_key FROM fact WHERE crime_type_key NOT IN (SELECT crime_type_key FROM types))"),
    check_sql("gold", "reference(time_of_day_key)", "0", 0.0, "(SELECT 1)"),
]
QUALITY_CTES = [f"fact AS ({FACT_ROWS})", f"places AS ({PLACE_ROWS})", f"types AS ({TYPE_ROWS})"]
QUALITY = with_silver("\nUNION ALL ".join(QUALITY_CHECKS), extra=QUALITY_CTES)


def unique_keys(spark, sf):
    """Repeated landing ids with their counts."""
    return quality.duplicate_keys(inputs.landing(spark, sf), "id")


UNIQUE_KEYS = with_landing("SELECT id, count(*) AS n FROM landing GROUP BY id HAVING count(*) > 1")

QUERIES = {
    "slice_replace": (slice_replace, SLICE_REPLACE),
    "upsert_merge": (upsert_merge, UPSERT_MERGE),
    "upsert_customers": (upsert_customers, UPSERT_CUSTOMERS),
    "staging_merge": (staging_merge, STAGING_MERGE),
    "schema_evolve": (schema_evolve, SCHEMA_EVOLVE),
    "dimension_current": (dimension_current, DIMENSION_CURRENT),
    "quality_suites": (quality_suites, QUALITY),
    "unique_keys": (unique_keys, UNIQUE_KEYS),
}
