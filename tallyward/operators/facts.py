"""Fact tables and the star query."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.functions.calendar import time_period
from tallyward.functions.keys import date_key, location_key
from tallyward.functions.location import incident_risk
from tallyward.functions.measures import bool_flag, percentage
from tallyward.functions.taxonomy import ensure_taxonomy
from tallyward.operators.dedupe import dedupe_fact
from tallyward.operators.joins import current_rows


def incident_fact(silver: DataFrame, process_date: date | Column, key_method: str = "xxhash64") -> DataFrame:
    """36 columns, one row per incident id."""
    df = ensure_taxonomy(silver, key_method=key_method)
    ts = F.col("date")
    stamp = process_date if isinstance(process_date, Column) else F.lit(process_date)
    flags = ["violent_crime_flag", "property_crime_flag", "drug_crime_flag", "weapon_crime_flag"]
    fact = df.select(
        F.col("id").alias("_source_id"),
        F.col("id").cast("string").alias("incident_id"),
        "case_number",
        date_key(ts).alias("date_key"),
        location_key(key_method).alias("location_key"),
        F.col("crime_type_key").cast("bigint").alias("crime_type_key"),
        F.hour(ts).alias("time_of_day_key"),
        ts.cast("timestamp").alias("incident_datetime"),
        F.col("arrest").cast("boolean").alias("arrest_made"),
        F.col("domestic").cast("boolean").alias("domestic_incident"),
        F.col("latitude").cast("double").alias("latitude"),
        F.col("longitude").cast("double").alias("longitude"),
        F.col("primary_type").alias("crime_type"),
        F.col("description").alias("crime_description"),
        "crime_category",
        F.col("crime_offense_group").alias("crime_group"),
        F.col("crime_offense_subtype").alias("crime_subtype"),
        "location_description",
        *[F.col(c).try_cast("int").alias(c) for c in ("beat", "district", "ward", "community_area")],
        F.col("iucr").alias("iucr_code"),
        bool_flag(F.col("arrest")).alias("arrest_flag"),
        bool_flag(F.col("domestic")).alias("domestic_flag"),
        F.lit(1).alias("incident_count"),
        *[F.col(c).cast("int").alias(c) for c in flags],
        F.dayofweek(ts).alias("day_of_week"),
        F.year(ts).alias("year"),
        F.month(ts).alias("month"),
        F.dayofmonth(ts).alias("day"),
        F.hour(ts).alias("hour"),
        incident_risk(F.col("location_description")).alias("location_risk_category"),
        stamp.cast("date").alias("process_date"),
    )
    return dedupe_fact(fact, "_source_id").drop("_source_id")


def summary_input(silver: DataFrame, key_method: str = "xxhash64") -> DataFrame:
    """The columns both summaries read."""
    df = ensure_taxonomy(silver, key_method=key_method)
    return df.select(
        date_key(F.col("date")).alias("date_key"),
        location_key(key_method).alias("location_key"),
        F.col("crime_type_key").cast("bigint").alias("crime_type_key"),
        F.col("district").try_cast("int").alias("district"),
        F.hour("date").alias("hour"),
        bool_flag(F.col("arrest").cast("boolean")).alias("arrest_flag"),
        bool_flag(F.col("domestic").cast("boolean")).alias("domestic_flag"),
        F.col("violent_crime_flag").cast("int").alias("violent_crime_flag"),
        F.to_date("date").alias("process_date"),
    )


def daily_summary(prepared: DataFrame) -> DataFrame:
    """Per day, location, offense and district."""
    keys = ["date_key", "location_key", "crime_type_key", "district", "process_date"]
    counts = prepared.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_incidents"),
        F.sum("arrest_flag").alias("total_arrests"),
        F.sum("domestic_flag").alias("total_domestic"),
        F.sum("violent_crime_flag").alias("total_violent_crimes"),
        F.count(F.lit(1)).alias("incident_count_check"),
    )
    total = F.col("total_incidents")
    return counts.withColumns({
        "arrest_rate": percentage(F.col("total_arrests"), total),
        "domestic_rate": percentage(F.col("total_domestic"), total),
        "violent_crime_rate": percentage(F.col("total_violent_crimes"), total),
        "summary_type": F.lit("daily"),
    })


def hourly_summary(prepared: DataFrame) -> DataFrame:
    """Per day, hour and district."""
    counts = prepared.groupBy("date_key", F.col("hour").alias("time_of_day_key"), "district", "process_date").agg(
        F.count(F.lit(1)).alias("hourly_incidents"),
        F.sum("arrest_flag").alias("hourly_arrests"),
        F.sum("violent_crime_flag").alias("hourly_violent_crimes"),
    )
    return counts.withColumns({
        "time_period": time_period(F.col("time_of_day_key")),
        "summary_type": F.lit("hourly"),
    })


def count_gap(summary: DataFrame, source: DataFrame) -> DataFrame:
    """One row with the summary's check total, the source count and their difference."""
    total = summary.agg(F.sum("incident_count_check").alias("n"))
    return source.agg(F.count(F.lit(1)).alias("source_count")).select(
        "source_count", total.scalar().alias("summary_count"),
    ).withColumn("gap", F.col("source_count") - F.col("summary_count"))


def star_rollup(fact: DataFrame, dim_location: DataFrame, dim_date: DataFrame, dim_type: DataFrame) -> DataFrame:
    """C17: incidents and violent incidents per community area and year.

    The fact is reduced to its key combinations before any dimension is joined, so a location or
    offense that owns a third of the incidents is one row per task by then. Dimensions that keep a
    copy per batch are cut to their current rows, otherwise the join would multiply counts.
    """
    per_key = fact.groupBy("location_key", "crime_type_key", "date_key").agg(F.count("incident_id").alias("n"))
    years = dim_date.select("date_key", F.col("year").alias("dim_year"))
    per_year = (per_key.join(years, "date_key")
                .groupBy("location_key", "crime_type_key", "dim_year").agg(F.sum("n").alias("n")))
    places = current_rows(dim_location, "location_key", tie_break=["community_area"]).select(
        "location_key", "community_area")
    types = current_rows(dim_type, "crime_type_key", tie_break=["violent_crime_flag"]).select(
        "crime_type_key", "violent_crime_flag")
    joined = per_year.join(places, "location_key").join(types, "crime_type_key")
    return joined.groupBy("community_area", F.col("dim_year").alias("year")).agg(
        F.sum("n").alias("total"),
        F.sum(F.when(F.col("violent_crime_flag") == 1, F.col("n")).otherwise(0)).alias("violent_crimes"),
    )
