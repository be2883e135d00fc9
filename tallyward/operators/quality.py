"""Data quality checks.

A check result is a row (check, passed, observed, threshold). All conditions on one table are
evaluated in a single aggregate; uniqueness and referential checks add one each.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.operators.joins import missing_keys
from tallyward.sources.tables import replace_slices

# Unique node keys.
NODE_KEYS = {"Crime": "case_number", "Date": "date_label", "Location": "location_text_key",
             "CrimeType": "crime_type_key"}
CATEGORIES = ["Violent", "Sex offense", "Weapons", "Drug", "Property", "Public order", "Other", "Unknown"]

Check = tuple[str, Column, float, str]


def row_count_at_least(minimum: int) -> Check:
    return (f"row_count>={minimum}", F.count(F.lit(1)).cast("double"), float(minimum), "min")


def null_rate_at_most(column: str, limit: float) -> Check:
    rate = F.avg(F.when(F.col(column).isNull(), 1.0).otherwise(0.0))
    return (f"null_rate({column})", F.coalesce(rate, F.lit(0.0)), limit, "max")


def violations(name: str, bad: Column, limit: float = 0.0) -> Check:
    """Rows for which ``bad`` is true."""
    return (name, F.count(F.when(bad, 1)).cast("double"), limit, "max")


def accepted_values(column: str, values: Sequence) -> Check:
    return violations(f"accepted_values({column})", F.col(column).isNotNull() & ~F.col(column).isin(*values))


def in_range(column: str, low, high) -> Check:
    return violations(f"range({column})", F.col(column).isNotNull() & ~F.col(column).between(low, high))


def freshness(column: str, at_least: date) -> Check:
    age = F.datediff(F.lit(at_least), F.max(F.to_date(column)))
    return (f"freshness({column})", F.coalesce(age.cast("double"), F.lit(float("inf"))), 0.0, "max")


def run_checks(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """One aggregate over ``df`` for all checks, unfolded to result rows."""
    cells = []
    for name, observed, threshold, kind in checks:
        cells.append(F.struct(F.lit(name).alias("check"), observed.cast("double").alias("observed"),
                              F.lit(float(threshold)).alias("threshold"), F.lit(kind).alias("kind")))
    rows = df.agg(F.array(*cells).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    passed = F.when(F.col("kind") == "min", F.col("observed") >= F.col("threshold")).otherwise(
        F.col("observed") <= F.col("threshold"))
    return rows.select("check", passed.alias("passed"), "observed", "threshold")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def unique_check(df: DataFrame, key: str) -> DataFrame:
    """I5 as a result row."""
    return run_checks(duplicate_keys(df, key), [(f"unique({key})", F.count(F.lit(1)), 0.0, "max")])


def reference_check(facts: DataFrame, dim: DataFrame, key: str, dim_key: str | None = None) -> DataFrame:
    """Distinct fact keys without a dimension row."""
    return run_checks(missing_keys(facts, dim, key, dim_key),
                      [(f"reference({key})", F.count(F.lit(1)), 0.0, "max")])


def schema_check(df: DataFrame, required: Sequence[str]) -> Check:
    """Missing columns, known without reading data."""
    missing = [c for c in required if c not in df.columns]
    return (f"schema({len(required)} columns)", F.max(F.lit(len(missing))), 0.0, "max")


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@dataclass
class SuiteInput:
    """Tables a suite may need; each suite names the ones it requires."""

    table: DataFrame | None = None
    dims: dict[str, DataFrame] = field(default_factory=dict)


def landing_suite(given: SuiteInput, day: date) -> DataFrame:
    df = given.table
    return _union([
        run_checks(df, [row_count_at_least(1), null_rate_at_most("id", 0.0), null_rate_at_most("date", 0.0),
                        null_rate_at_most("latitude", 0.5), schema_check(df, ["id", "case_number", "date"])]),
        unique_check(df, "id"),
    ])


def silver_suite(given: SuiteInput, day: date) -> DataFrame:
    df = given.table
    return _union([
        run_checks(df, [row_count_at_least(1), null_rate_at_most("id", 0.0), null_rate_at_most("date", 0.0),
                        null_rate_at_most("crime_category", 0.0), accepted_values("crime_category", CATEGORIES),
                        in_range("latitude", -90.0, 90.0), in_range("longitude", -180.0, 180.0),
                        freshness("process_date", day)]),
        unique_check(df, "id"),
    ])


def star_suite(given: SuiteInput, day: date) -> DataFrame:
    """Row count, references to four dimensions, null rates."""
    df, dims = given.table, given.dims
    return _union([
        run_checks(df, [row_count_at_least(1), null_rate_at_most("incident_id", 0.0),
                        null_rate_at_most("date_key", 0.0), null_rate_at_most("beat", 0.5)]),
        *[reference_check(df, dims[name], key) for name, key in (
            ("dim_date", "date_key"), ("dim_location", "location_key"), ("dim_crime_type", "crime_type_key"),
            ("dim_time_of_day", "time_of_day_key"))],
    ])


def feature_suite(given: SuiteInput, day: date) -> DataFrame:
    df = given.table
    return run_checks(df, [
        row_count_at_least(1), null_rate_at_most("process_date", 0.0),
        violations("windows_nested", (F.col("count_3d") > F.col("count_7d")) | (F.col("count_7d") > F.col("count_14d"))),
        in_range("arrest_rate_7d", 0.0, 1.0), in_range("domestic_rate_7d", 0.0, 1.0), freshness("process_date", day),
    ])


def prediction_suite(given: SuiteInput, day: date) -> DataFrame:
    df = given.table
    low, high, p = F.col("predicted_count_low"), F.col("predicted_count_high"), F.col("predicted_count")
    return run_checks(df, [
        row_count_at_least(1), null_rate_at_most("predicted_count", 0.0), in_range("safety_score", 0.0, 100.0),
        violations("interval_ordered", (low > high) | (low > p + 0.05) | (high < p - 0.05)),
        freshness("process_date", day),
    ])


SUITES = {
    "bronze_parquet": ("bronze", landing_suite, []),
    "silver_iceberg": ("silver", silver_suite, []),
    "gold_bi": ("gold", star_suite, ["dim_date", "dim_location", "dim_crime_type", "dim_time_of_day"]),
    "gold_ml_features": ("gold_ml", feature_suite, []),
    "ml_predictions": ("ml", prediction_suite, []),
}


def run_suite(name: str, day: date, table: DataFrame | None = None, dims: dict[str, DataFrame] | None = None) -> DataFrame:
    """Run a suite by name after checking that its tables were given."""
    if name not in SUITES:
        raise ValueError(f"unknown suite {name!r}; one of {sorted(SUITES)}")
    layer, suite, needed = SUITES[name]
    absent = [d for d in needed if d not in (dims or {})]
    if table is None or absent:
        raise ValueError(f"suite {name!r} needs table{' and dims ' + str(absent) if absent else ''}")
    return suite(SuiteInput(table, dims or {}), day).select(F.lit(layer).alias("layer"), "*")


def fail_if(results: DataFrame, fail_on_error: bool) -> int:
    """Number of failed checks; raises only when asked to."""
    failed = [r["check"] for r in results.filter(~F.col("passed")).select("check").collect()]  # one row per check
    if failed and fail_on_error:
        raise ValueError(f"{len(failed)} check(s) failed: {', '.join(failed)}")
    return len(failed)


def persist_results(results: DataFrame, path: str, day: date, idempotency_key: str) -> None:
    """One slice per layer, day and idempotency key; a retry replaces its own slice."""
    keyed = results.withColumns({"result_date": F.lit(day), "idempotency_key": F.lit(idempotency_key)})
    replace_slices(keyed, path, ["layer", "result_date", "idempotency_key"])
