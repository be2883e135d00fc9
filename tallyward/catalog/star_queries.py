"""Dimensions, facts, summaries and star queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyward.catalog import inputs
from tallyward.catalog.oracle_blocks import (
    DATE_KEY, LAST_DAY, LOCATION_CATEGORY, LOCATION_KEY, LOCATION_TYPE, RISK_LEVEL, TIME_PERIOD, with_landing,
    with_silver,
)
from tallyward.functions import location as loc
from tallyward.operators import dimensions as dim
from tallyward.operators import facts
from tallyward.operators.dedupe import dedupe_fact
from tallyward.operators.joins import missing_keys, small_side
from tallyward.operators.layout import stage


def _silver(spark, sf):
    return inputs.silver(spark, sf)


def _stored(spark, sf):
    """Silver as a stored table, for queries that read it more than once; facts read it to find repeated ids, too."""
    return stage(inputs.silver(spark, sf).drop("x_coordinate", "y_coordinate", "location", "fbi_code", "year", "updated_on"),
                 "silver")


def _anchor(spark, sf):
    """Batch date of the dimensions: the newest incident day."""
    return inputs.first_last_day(spark, sf)[1]


def location_classify(spark, sf):
    """B17-B21 over all landing records, counted per combination."""
    kind = loc.location_type(F.col("location_description"))
    rows = inputs.landing(spark, sf).select(
        "location_description", kind.alias("location_type"), loc.location_category(kind).alias("location_category"),
        loc.risk_level(kind).alias("risk_level"), loc.incident_risk(F.col("location_description")).alias("incident_risk"),
        loc.clean_upper(F.col("block")).alias("block_address"),
        loc.district_label(F.col("district")).alias("district_name"))
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("records"))


LOCATION_CLASSIFY = with_landing(f"""SELECT location_description, location_type, {LOCATION_CATEGORY} AS location_category,
  {RISK_LEVEL} AS risk_level,
  CASE WHEN regexp_matches(location_description, '(?i)(STREET|SIDEWALK|ALLEY)') THEN 'High Risk'
    WHEN regexp_matches(location_description, '(?i)(RESIDENCE|APARTMENT)') THEN 'Medium Risk' ELSE 'Low Risk' END AS incident_risk,
  trim(upper(block)) AS block_address, 'District ' || district AS district_name, count(*) AS records
FROM (SELECT *, {LOCATION_TYPE} AS location_type FROM landing) GROUP BY ALL""")


def dim_date(spark, sf):
    """G1 around the newest incident day, with the incidents each calendar day received."""
    lineitem = inputs.table(spark, sf, "lineitem")
    day = F.col("l_shipdate").cast("date")
    calendar = dim.date_dimension(lineitem.agg(F.max(day).alias("anchor")))
    per_day = lineitem.groupBy(day.alias("date")).agg(F.count(F.lit(1)).alias("records"))
    return calendar.join(per_day, "date", "left").withColumn("records", F.coalesce("records", F.lit(0)).cast("bigint"))


DIM_DATE = f"""WITH a AS (SELECT {LAST_DAY} AS anchor),
cal AS (SELECT CAST(unnest(generate_series(anchor - 1825, anchor + 365, INTERVAL 1 DAY)) AS DATE) AS d, anchor FROM a),
per_day AS (SELECT CAST(l_shipdate AS DATE) AS d, count(*) AS n FROM lineitem GROUP BY 1)
SELECT cal.d AS "date", CAST(strftime(cal.d, '%Y%m%d') AS INTEGER) AS date_key, CAST(year(cal.d) AS INTEGER) AS "year",
  CAST(quarter(cal.d) AS INTEGER) AS quarter, CAST(month(cal.d) AS INTEGER) AS "month", CAST(day(cal.d) AS INTEGER) AS "day",
  CAST(isodow(cal.d) AS INTEGER) AS day_of_week, CAST(week(cal.d) AS INTEGER) AS week_of_year,
  strftime(cal.d, '%Y-%m-%d') AS date_string, strftime(cal.d, '%B') AS month_name, strftime(cal.d, '%A') AS day_name,
  'Q' || quarter(cal.d) AS quarter_name, isodow(cal.d) >= 6 AS is_weekend, isodow(cal.d) < 6 AS is_weekday,
  CASE WHEN month(cal.d) IN (12, 1, 2) THEN 'Winter' WHEN month(cal.d) <= 5 THEN 'Spring' WHEN month(cal.d) <= 8 THEN 'Summer'
    ELSE 'Fall' END AS season,
  CAST(CASE WHEN month(cal.d) < 7 THEN year(cal.d) ELSE year(cal.d) + 1 END AS INTEGER) AS fiscal_year,
  anchor AS created_date, anchor AS updated_date, coalesce(n, 0) AS records
FROM cal LEFT JOIN per_day ON cal.d = per_day.d"""


def dim_time_of_day(spark, sf):
    """G2 with the events that fell into each hour; the dimension has 24 rows, so it is broadcast."""
    events = inputs.table(spark, sf, "events")
    per_hour = events.groupBy(F.hour("ts").alias("hour")).agg(
        F.count(F.lit(1)).alias("records"), F.countDistinct("user_id").alias("users"))
    hours = dim.time_of_day_dimension(spark, inputs.first_last_day(spark, sf)[1])
    return hours.join(per_hour, "hour", "left").withColumns({
        "records": F.coalesce("records", F.lit(0)).cast("bigint"), "users": F.coalesce("users", F.lit(0)).cast("bigint")})


DIM_TIME_OF_DAY = f"""SELECT CAST(h AS INTEGER) AS time_of_day_key, CAST(h AS INTEGER) AS "hour", {TIME_PERIOD.format(h='h')} AS time_period,
  CASE WHEN h BETWEEN 9 AND 17 THEN 'Business Hours' WHEN h BETWEEN 18 AND 22 THEN 'Evening Hours'
    WHEN h >= 23 OR h <= 5 THEN 'Late Night' ELSE 'Early Morning' END AS business_period,
  CASE WHEN h BETWEEN 6 AND 14 THEN 'Day Shift' WHEN h BETWEEN 15 AND 23 THEN 'Evening Shift' ELSE 'Night Shift' END AS police_shift,
  CASE WHEN h BETWEEN 7 AND 9 OR h BETWEEN 17 AND 19 THEN 'High' WHEN h BETWEEN 10 AND 16 OR h BETWEEN 20 AND 22 THEN 'Medium'
    ELSE 'Low' END AS activity_level,
  printf('%02d:00', h) AS hour_display, printf('%02d:00', h) AS hour_24_format,
  {LAST_DAY} AS created_date, {LAST_DAY} AS updated_date, coalesce(records, 0) AS records, coalesce(users, 0) AS users
FROM range(24) t(h) LEFT JOIN (SELECT hour(ts) AS eh, count(*) AS records, count(DISTINCT user_id) AS users FROM events GROUP BY 1)
  ON h = eh"""


def dim_crime_type(spark, sf):
    return dim.crime_type_dimension(_silver(spark, sf), _anchor(spark, sf), "md5")


TYPE_ROWS = """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY crime_type_key ORDER BY crime_category,
    crime_offense_group, crime_offense_subtype, crime_offense_label, primary_type, primary_type_clean,
    crime_description NULLS LAST, crime_description_clean, iucr_code NULLS LAST) AS rn FROM (
  SELECT crime_type_key, crime_category, crime_offense_group, crime_offense_subtype, crime_offense_label, primary_type,
    crime_primary_type_clean AS primary_type_clean, description AS crime_description, crime_description_clean,
    iucr AS iucr_code, crime_severity_level AS severity_level, crime_fbi_classification AS fbi_classification,
    crime_clearance_bucket AS typical_clearance_rate, violent_crime_flag, property_crime_flag, drug_crime_flag,
    weapon_crime_flag FROM silver WHERE primary_type IS NOT NULL)) WHERE rn = 1"""
DIM_CRIME_TYPE = with_silver(f"SELECT *, {LAST_DAY} AS created_date, {LAST_DAY} AS updated_date FROM ({TYPE_ROWS})")


def dim_location(spark, sf):
    return dim.location_dimension(_silver(spark, sf), _anchor(spark, sf), "md5")


PLACE_ROWS = f"""SELECT location_key, beat, district, district_name, ward, community_area, location_type,
  location_description_clean, {LOCATION_CATEGORY} AS location_category, {RISK_LEVEL} AS risk_level, block_address FROM (
  SELECT DISTINCT {LOCATION_KEY} AS location_key, TRY_CAST(beat AS INTEGER) AS beat, TRY_CAST(district AS INTEGER) AS district,
    coalesce(trim(district_name), 'District ' || district) AS district_name, TRY_CAST(ward AS INTEGER) AS ward,
    TRY_CAST(community_area AS INTEGER) AS community_area, {LOCATION_TYPE} AS location_type,
    trim(upper(location_description)) AS location_description_clean, trim(upper(block)) AS block_address
  FROM silver WHERE beat IS NOT NULL OR district IS NOT NULL)"""
DIM_LOCATION = with_silver(f"SELECT *, {LAST_DAY} AS created_date, {LAST_DAY} AS updated_date FROM ({PLACE_ROWS})")


def fact_incidents(spark, sf):
    return inputs.naive_times(facts.incident_fact(_stored(spark, sf), F.col("process_date"), "md5"))


FACT_ROWS = f"""SELECT CAST(id AS VARCHAR) AS incident_id, case_number, {DATE_KEY} AS date_key, {LOCATION_KEY} AS location_key,
  crime_type_key, CAST(hour("date") AS INTEGER) AS time_of_day_key, "date" AS incident_datetime, arrest AS arrest_made,
  domestic AS domestic_incident, latitude, longitude, primary_type AS crime_type, description AS crime_description,
  crime_category, crime_offense_group AS crime_group, crime_offense_subtype AS crime_subtype, location_description,
  TRY_CAST(beat AS INTEGER) AS beat, TRY_CAST(district AS INTEGER) AS district, TRY_CAST(ward AS INTEGER) AS ward,
  TRY_CAST(community_area AS INTEGER) AS community_area, iucr AS iucr_code,
  CASE WHEN arrest THEN 1 ELSE 0 END AS arrest_flag, CASE WHEN domestic THEN 1 ELSE 0 END AS domestic_flag,
  1 AS incident_count, CAST(violent_crime_flag AS INTEGER) AS violent_crime_flag,
  CAST(property_crime_flag AS INTEGER) AS property_crime_flag, CAST(drug_crime_flag AS INTEGER) AS drug_crime_flag,
  CAST(weapon_crime_flag AS INTEGER) AS weapon_crime_flag, CAST(dayofweek("date") + 1 AS INTEGER) AS day_of_week,
  CAST(year("date") AS INTEGER) AS "year", CAST(month("date") AS INTEGER) AS "month", CAST(day("date") AS INTEGER) AS "day",
  CAST(hour("date") AS INTEGER) AS "hour",
  CASE WHEN regexp_matches(location_description, '(?i)(STREET|SIDEWALK|ALLEY)') THEN 'High Risk'
    WHEN regexp_matches(location_description, '(?i)(RESIDENCE|APARTMENT)') THEN 'Medium Risk' ELSE 'Low Risk' END
    AS location_risk_category, CAST("date" AS DATE) AS process_date FROM silver"""
FACT_INCIDENTS = with_silver(FACT_ROWS)


def fact_dedupe(spark, sf):
    """E3 on repeated incidents: each fact row comes with an older version of itself that says otherwise."""
    fact = facts.incident_fact(_stored(spark, sf), F.col("process_date"), "md5")
    older = fact.withColumns({"incident_datetime": F.col("incident_datetime") - F.expr("interval 1 day"),
                              "crime_type": F.lit("OLD"), "arrest_flag": 1 - F.col("arrest_flag")})
    return inputs.naive_times(dedupe_fact(older.unionByName(fact)))


def _dense(silver):
    """Incidents moved to few days, places and types, so that summaries have many of them per group."""
    none = F.lit(None).cast("string")
    return silver.withColumns({
        "date": F.date_trunc("quarter", "date") + F.make_dt_interval(hours=F.hour("date")), "beat": none, "ward": none,
        "community_area": none, "block": none, "location_description": none, "crime_type_key": F.col("violent_crime_flag")})


def daily_summary_dense(spark, sf):
    """D2, B31 with groups of many incidents: rates between 0 and 100."""
    return facts.daily_summary(facts.summary_input(_dense(_silver(spark, sf)), "md5"))


def hourly_summary_dense(spark, sf):
    """D3 with groups of many incidents."""
    return facts.hourly_summary(facts.summary_input(_dense(_silver(spark, sf)), "md5"))


def daily_summary(spark, sf):
    return facts.daily_summary(facts.summary_input(_silver(spark, sf), "md5"))


_PREPARED = f"""prepared AS (SELECT {DATE_KEY} AS date_key, {LOCATION_KEY} AS location_key, crime_type_key,
  TRY_CAST(district AS INTEGER) AS district, CAST("date" AS DATE) AS process_date, hour("date") AS h,
  CASE WHEN arrest THEN 1 ELSE 0 END AS a, CASE WHEN domestic THEN 1 ELSE 0 END AS m, violent_crime_flag AS v FROM silver)"""
_DENSE = """dense AS (SELECT * REPLACE (date_trunc('quarter', "date") + to_hours(hour("date")) AS "date", CAST(NULL AS VARCHAR) AS beat,
  CAST(NULL AS VARCHAR) AS ward, CAST(NULL AS VARCHAR) AS community_area, CAST(NULL AS VARCHAR) AS block,
  CAST(NULL AS VARCHAR) AS location_description, violent_crime_flag AS crime_type_key) FROM silver)"""
_DENSELY = [_DENSE, _PREPARED.replace("FROM silver)", "FROM dense)")]
_DAILY = """SELECT date_key, location_key, crime_type_key, district, process_date,
  count(*) AS total_incidents, CAST(sum(a) AS BIGINT) AS total_arrests, CAST(sum(m) AS BIGINT) AS total_domestic,
  CAST(sum(v) AS BIGINT) AS total_violent_crimes, count(*) AS incident_count_check,
  CAST(sum(a) AS DOUBLE) / count(*) * 100.0::DOUBLE AS arrest_rate,
  CAST(sum(m) AS DOUBLE) / count(*) * 100.0::DOUBLE AS domestic_rate,
  CAST(sum(v) AS DOUBLE) / count(*) * 100.0::DOUBLE AS violent_crime_rate, 'daily' AS summary_type
FROM prepared GROUP BY 1, 2, 3, 4, 5"""
DAILY_SUMMARY = with_silver(_DAILY, extra=[_PREPARED])


def hourly_summary(spark, sf):
    return facts.hourly_summary(facts.summary_input(_silver(spark, sf), "md5"))


_HOURLY = f"""SELECT date_key, CAST(h AS INTEGER) AS time_of_day_key, district, process_date,
  count(*) AS hourly_incidents, CAST(sum(a) AS BIGINT) AS hourly_arrests, CAST(sum(v) AS BIGINT) AS hourly_violent_crimes,
  {TIME_PERIOD.format(h='h')} AS time_period, 'hourly' AS summary_type FROM prepared GROUP BY date_key, h, district, process_date"""
HOURLY_SUMMARY = with_silver(_HOURLY, extra=[_PREPARED])


def summary_reconciled(spark, sf):
    """The summary's check total against the source."""
    prepared = stage(facts.summary_input(_silver(spark, sf), "md5"), "prepared")
    return facts.count_gap(facts.daily_summary(prepared), prepared)


SUMMARY_RECONCILED = with_silver("""SELECT count(*) AS source_count, count(*) AS summary_count,
  CAST(0 AS BIGINT) AS gap FROM silver""")


def fk_missing(spark, sf):
    """Locations of incidents without beat and district are not in the dimension."""
    silver = _stored(spark, sf)
    prepared = facts.summary_input(silver, "md5")
    return missing_keys(prepared, dim.location_dimension(silver, _anchor(spark, sf), "md5"), "location_key")


FK_MISSING = with_silver(f"""SELECT DISTINCT {LOCATION_KEY} AS location_key FROM silver
WHERE beat IS NULL AND district IS NULL""")


def fk_complete(spark, sf):
    """C5 with the unknown member kept: nothing is missing, shown as counts per side."""
    silver = _stored(spark, sf)
    prepared = facts.summary_input(silver, "md5")
    places = stage(dim.location_dimension(silver, _anchor(spark, sf), "md5", unknown_member=True), "places")
    lost = missing_keys(prepared, places, "location_key").agg(F.count(F.lit(1)).alias("n"))
    return places.agg(F.count(F.lit(1)).alias("dim_rows")).withColumn("missing", lost.scalar())


FK_COMPLETE = with_silver(f"SELECT count(DISTINCT {LOCATION_KEY}) AS dim_rows, CAST(0 AS BIGINT) AS missing FROM silver")


def star_rollup(spark, sf):
    silver, day = _stored(spark, sf), _anchor(spark, sf)
    fact = facts.incident_fact(silver, F.col("process_date"), "md5")
    return facts.star_rollup(fact, dim.location_dimension(silver, day, "md5"), dim.date_dimension_for(spark, day),
                             dim.crime_type_dimension(silver, day, "md5")).orderBy(F.desc("year"))


STAR_ROLLUP = with_silver(f"""SELECT l.community_area, f."year", CAST(count(*) AS BIGINT) AS total,
  CAST(sum(CASE WHEN c.violent_crime_flag = 1 THEN 1 ELSE 0 END) AS BIGINT) AS violent_crimes
FROM ({FACT_ROWS}) f JOIN ({PLACE_ROWS}) l ON f.location_key = l.location_key
JOIN ({TYPE_ROWS}) c ON f.crime_type_key = c.crime_type_key
WHERE f.process_date BETWEEN {LAST_DAY} - 1825 AND {LAST_DAY} + 365 GROUP BY 1, 2""")


def star_rollup_orders(spark, sf):
    """C17 on the sales tables: revenue and lines per nation and year.

    Each step reduces before it joins: lines to orders, orders to customers and years, customers to
    nations. A customer or order that owns a third of the rows is a single row at its join.
    """
    line = inputs.table(spark, sf, "lineitem")
    orders = inputs.table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    customer = inputs.table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    nation = small_side(inputs.table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"))
    region = small_side(inputs.table(spark, sf, "region"))
    cents = (F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)")))
    per_order = line.groupBy("l_orderkey").agg(
        F.sum(cents).cast("decimal(28,4)").alias("rev"), F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("returned"))
    per_customer = (per_order.join(orders, per_order["l_orderkey"] == orders["o_orderkey"])
                    .groupBy("o_custkey", "year").agg(F.sum("rev").cast("decimal(28,4)").alias("rev"),
                                                      F.sum("n").alias("n"), F.sum("returned").alias("returned")))
    per_nation = (per_customer.join(customer, per_customer["o_custkey"] == customer["c_custkey"])
                  .groupBy("c_nationkey", "year").agg(F.sum("rev").cast("decimal(28,4)").alias("rev"),
                                                      F.sum("n").alias("n"), F.sum("returned").alias("returned")))
    named = per_nation.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
        region, F.col("n_regionkey") == F.col("r_regionkey"))
    return named.select("r_name", "n_name", "year", F.col("rev").cast("double").alias("revenue"),
                        F.col("n").alias("lines"), F.col("returned").alias("returned_lines")).orderBy(F.desc("year"))


STAR_ROLLUP_ORDERS = """SELECT r_name, n_name, CAST(year(o_orderdate) AS INTEGER) AS "year",
  CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS revenue,
  count(*) AS lines, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS returned_lines
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3"""

QUERIES = {
    "location_classify": (location_classify, LOCATION_CLASSIFY),
    "dim_date": (dim_date, DIM_DATE),
    "dim_time_of_day": (dim_time_of_day, DIM_TIME_OF_DAY),
    "dim_crime_type": (dim_crime_type, DIM_CRIME_TYPE),
    "dim_location": (dim_location, DIM_LOCATION),
    "fact_incidents": (fact_incidents, FACT_INCIDENTS),
    "fact_dedupe": (fact_dedupe, FACT_INCIDENTS),
    "daily_summary_dense": (daily_summary_dense, with_silver(_DAILY, extra=_DENSELY)),
    "hourly_summary_dense": (hourly_summary_dense, with_silver(_HOURLY, extra=_DENSELY)),
    "daily_summary": (daily_summary, DAILY_SUMMARY),
    "hourly_summary": (hourly_summary, HOURLY_SUMMARY),
    "summary_reconciled": (summary_reconciled, SUMMARY_RECONCILED),
    "fk_missing": (fk_missing, FK_MISSING),
    "fk_complete": (fk_complete, FK_COMPLETE),
    "star_rollup": (star_rollup, STAR_ROLLUP),
    "star_rollup_orders": (star_rollup_orders, STAR_ROLLUP_ORDERS),
}
