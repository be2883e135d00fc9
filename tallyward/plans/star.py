"""Star schema of a batch: four dimensions, one incident fact, two summaries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.operators import dimensions as dim
from tallyward.operators import facts
from tallyward.operators.joins import require_keys, require_rows
from tallyward.sources.tables import overwrite, replace_slices


FACT_TABLES = ["fact_incidents", "daily_summary", "hourly_summary"]


def build_dimensions(silver: DataFrame, batch: date, key_method: str = "xxhash64",
                     unknown_member: bool = False) -> dict[str, DataFrame]:
    """The four dimensions."""
    spark = silver.sparkSession
    return {
        "dim_date": dim.date_dimension_for(spark, batch),
        "dim_time_of_day": dim.time_of_day_dimension(spark, batch),
        "dim_location": dim.location_dimension(silver, batch, key_method, unknown_member),
        "dim_crime_type": dim.crime_type_dimension(silver, batch, key_method),
    }


def build_facts(silver_day: DataFrame, dims: dict[str, DataFrame], process_date: date | Column,
                key_method: str = "xxhash64", check_keys: bool = True) -> dict[str, DataFrame]:
    """Facts of the given incidents. Stops when a dimension is empty or a location key is unknown."""
    require_rows(**dims)
    prepared = facts.summary_input(silver_day, key_method)
    if check_keys:
        require_keys(prepared, dims["dim_location"], "location_key")
    return {
        "fact_incidents": facts.incident_fact(silver_day, process_date, key_method),
        "daily_summary": facts.daily_summary(prepared),
        "hourly_summary": facts.hourly_summary(prepared),
    }


def write_star(dims: dict[str, DataFrame], fact_tables: dict[str, DataFrame], base: str) -> None:
    """Generated dimensions are replaced whole, the others by batch slice; facts by process date."""
    overwrite(dims["dim_date"], f"{base}/dim_date")
    overwrite(dims["dim_time_of_day"], f"{base}/dim_time_of_day")
    for name in ("dim_location", "dim_crime_type"):
        replace_slices(dims[name], f"{base}/{name}", ["updated_date"])
    for name, df in fact_tables.items():
        replace_slices(df.withColumn("process_date", F.col("process_date").cast("date")), f"{base}/{name}",
                       ["process_date"])
