"""Star schema."""

from datetime import date

import pytest
from helpers import by, dicts, landing_frame
from pyspark.sql import functions as F

from tallyward.operators import dimensions as dim
from tallyward.operators import facts
from tallyward.operators.joins import BROADCAST_ROWS, missing_keys, require_keys, require_rows, small_side
from tallyward.plans.silver import build_silver
from tallyward.plans.star import build_dimensions, build_facts, write_star

DAY = date(2025, 6, 1)


def incident(i, **over):
    return {"id": str(i), "case_number": f"C{i}", "date": "2025-06-01T22:15:00.000", "block": "001XX N STATE", "iucr": "0110",
            "primary_type": "THEFT", "description": "OVER $500", "location_description": "STREET", "arrest": "true",
            "domestic": "false", "beat": "0111", "district": "001", "ward": "2", "community_area": "32",
            "latitude": "41.9", "longitude": "-87.6", **over}


@pytest.fixture
def silver(spark):
    return build_silver(landing_frame(spark, [
        incident(1), incident(2, arrest=None), incident(3, primary_type="BATTERY", description="SIMPLE"),
        incident(4, location_description="BARBERSHOP", district="002"), incident(5, primary_type=None, beat="x12"),
    ]), DAY)


def test_fact_has_36_columns_and_flags(silver):
    fact = facts.incident_fact(silver, DAY)
    assert len(fact.columns) == 36
    rows = by(fact, "incident_id")
    one = rows["1"]
    assert (one["date_key"], one["time_of_day_key"], one["day_of_week"], one["year"], one["month"], one["day"]) == (
        20250601, 22, 1, 2025, 6, 1)
    assert one["location_risk_category"] == "High Risk" and rows["4"]["location_risk_category"] == "Low Risk"
    assert (one["arrest_flag"], rows["2"]["arrest_flag"]) == (1, 0)
    assert rows["5"]["beat"] is None and one["beat"] == 111


def test_fact_dedupes_by_incident(silver):
    later = silver.filter("id = 1").withColumns({"date": F.col("date") + F.expr("interval 1 hour"), "case_number": F.lit("LATER")})
    fact = facts.incident_fact(silver.unionByName(later), DAY)
    assert fact.count() == 5 and by(fact, "incident_id")["1"]["case_number"] == "LATER"


def test_dimensions(silver):
    places, types = dim.location_dimension(silver, DAY), dim.crime_type_dimension(silver, DAY)
    assert len(places.columns) == 13 and places.count() == 3
    assert len(types.columns) == 19 and types.count() == 2
    assert {r["district_name"] for r in places.collect()} == {"District 001", "District 002"}
    assert {r["updated_date"] for r in types.collect()} == {DAY}


def test_summaries(silver):
    prepared = facts.summary_input(silver)
    daily = dicts(facts.daily_summary(prepared))
    street_theft = next(r for r in daily if r["total_incidents"] == 2)
    assert (street_theft["total_arrests"], street_theft["arrest_rate"], street_theft["violent_crime_rate"]) == (1, 50.0, 0.0)
    hourly = by(facts.hourly_summary(prepared), "district")
    assert (hourly[1]["hourly_incidents"], hourly[1]["hourly_violent_crimes"], hourly[1]["time_period"]) == (4, 1, "Evening")
    assert facts.count_gap(facts.daily_summary(prepared), prepared).first()["gap"] == 0


def test_unknown_location_fails_the_key_check(spark, silver):
    lost = build_silver(landing_frame(spark, [incident(9, beat=None, district=None)]), DAY)
    both = silver.unionByName(lost)
    prepared = facts.summary_input(both)
    assert missing_keys(prepared, dim.location_dimension(both, DAY), "location_key").count() == 1
    with pytest.raises(ValueError, match="1 value"):
        require_keys(prepared, dim.location_dimension(both, DAY), "location_key")
    require_keys(prepared, dim.location_dimension(both, DAY, unknown_member=True), "location_key")


def test_empty_dimension_is_refused(silver):
    dims = build_dimensions(silver, DAY)
    with pytest.raises(ValueError, match="dim_location"):
        build_facts(silver, {**dims, "dim_location": dims["dim_location"].limit(0)}, DAY)
    require_rows(**dims)


def test_star_query_is_not_multiplied_by_dimension_copies(silver):
    dims = build_dimensions(silver, DAY)
    stale = dims["dim_location"].withColumn("updated_date", F.lit(date(2025, 5, 1)))
    both = dims["dim_location"].unionByName(stale)
    rows = dicts(facts.star_rollup(facts.incident_fact(silver, DAY), both, dims["dim_date"], dims["dim_crime_type"]))
    assert rows == [{"community_area": 32, "year": 2025, "total": 4, "violent_crimes": 1}]


def test_star_write_is_idempotent(spark, silver, folder):
    for _ in range(2):
        dims = build_dimensions(silver, DAY)
        write_star(dims, build_facts(silver, dims, DAY), folder)
    assert spark.read.parquet(f"{folder}/fact_incidents").count() == 5
    assert spark.read.parquet(f"{folder}/dim_location").count() == 3
    assert spark.read.parquet(f"{folder}/dim_time_of_day").count() == 24


def test_small_side_is_size_checked(spark):
    big, small = spark.range(100), spark.range(10)
    hinted = small_side(small, 50)._jdf.queryExecution().logical().toString()
    plain = small_side(big, 50)._jdf.queryExecution().logical().toString()
    assert "ResolvedHint" in hinted or "UnresolvedHint" in hinted
    assert "Hint" not in plain and BROADCAST_ROWS > 0
