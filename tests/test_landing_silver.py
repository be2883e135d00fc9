"""Landing, dedupe and the silver job."""

from datetime import date, datetime

from helpers import by, dicts, landing_frame
from pyspark.sql import functions as F

from tallyward.operators.dedupe import dedupe_landing, keep_latest, keep_latest_ties
from tallyward.plans.silver import build_silver, write_silver
from tallyward.schema import SILVER_DDL, struct_of
from tallyward.sources.landing import day_slice, read_landing, write_landing

DAY = date(2025, 6, 1)


def test_landing_dedupe_cases(spark):
    df = landing_frame(spark, [
        {"id": "1", "updated_on": "2025-06-02", "block": "old"}, {"id": "1", "updated_on": "2025-06-05", "block": "new"},
        {"id": "2", "updated_on": "bad", "block": "bad"}, {"id": "2", "updated_on": "2025-06-01", "block": "good"},
        {"id": "3", "updated_on": None, "block": "none"},
    ])
    assert {k: v["block"] for k, v in by(dedupe_landing(df), "id").items()} == {"1": "new", "2": "good", "3": "none"}
    no_id = df.drop("id")
    assert dedupe_landing(no_id) is no_id


def test_silver_dedupe_compares_texts_and_breaks_ties(spark):
    rows = [
        {"id": "2", "updated_on": "bad", "case_number": "A", "date": "2025-06-01T01:00:00"},
        {"id": "2", "updated_on": "2025-06-01", "case_number": "B", "date": "2025-06-01T01:00:00"},
        {"id": "4", "updated_on": "x", "case_number": "A", "date": "2025-06-01T01:00:00"},
        {"id": "4", "updated_on": "x", "case_number": "C", "date": "2025-06-01T01:00:00"},
        {"id": "4", "updated_on": "x", "case_number": "B", "date": "2025-06-01T01:00:00"},
    ]
    silver = build_silver(landing_frame(spark, rows), DAY)
    assert {k: v["case_number"] for k, v in by(silver, "id").items()} == {2: "A", 4: "C"}


def test_silver_schema_and_bad_values(spark):
    rows = [{"id": "7", "date": "2025-06-01T10:30:00.000", "arrest": "true", "domestic": "maybe", "latitude": "41.9",
             "longitude": "n/a", "year": "2025", "primary_type": "theft", "updated_on": "2025-06-03T00:00:00.000"},
            {"id": "oops", "date": "never"}]
    silver = build_silver(landing_frame(spark, rows), DAY)
    assert [(f.name, f.dataType) for f in silver.schema] == [(f.name, f.dataType) for f in struct_of(SILVER_DDL)]
    assert len(silver.columns) == 39
    row = by(silver, "id")[7]
    assert row["date"] == datetime(2025, 6, 1, 10, 30) and row["arrest"] is True and row["domestic"] is None
    assert row["longitude"] is None and row["crime_category"] == "Property" and row["process_date"] == datetime(2025, 6, 1)
    assert by(silver, "id")[None]["date"] is None


def test_landing_without_optional_columns(spark):
    df = spark.createDataFrame([("1", "THEFT")], "ID string, PRIMARY_TYPE string")
    assert build_silver(df, DAY).first()["crime_category"] == "Property"


def test_landing_round_trip_and_rerun(spark, folder):
    rows = [{"id": str(i), "date": f"2025-06-0{1 + i % 3}T{i:02d}:00:00.000"} for i in range(9)]
    df = landing_frame(spark, rows)
    write_landing(df, folder)
    write_landing(df, folder)
    assert read_landing(spark, folder).count() == 9
    assert {r["id"] for r in dicts(read_landing(spark, folder, date(2025, 6, 2)))} == {"1", "4", "7"}
    assert read_landing(spark, folder, date(2025, 7, 1)) is None


def test_day_slice_is_half_open(spark):
    df = landing_frame(spark, [{"id": "a", "date": "2025-06-01T00:00:00.000"}, {"id": "b", "date": "2025-06-01T23:59:59.999"},
                               {"id": "c", "date": "2025-06-02T00:00:00.000"}, {"id": "d", "date": "2025-05-31T23:59:59.999"}])
    assert {r["id"] for r in dicts(day_slice(df, "date", DAY))} == {"a", "b"}
    typed = df.withColumn("date", F.to_timestamp("date"))
    assert {r["id"] for r in dicts(day_slice(typed, "date", DAY))} == {"a", "b"}


def test_silver_write_replaces_only_its_day(spark, folder):
    one = build_silver(landing_frame(spark, [{"id": "1"}, {"id": "2"}]), date(2025, 6, 1))
    two = build_silver(landing_frame(spark, [{"id": "3"}]), date(2025, 6, 2))
    for df in (one, two, one):
        write_silver(df, folder)
    assert {(r["id"], r["process_date"]) for r in dicts(spark.read.parquet(folder))} == {
        (1, date(2025, 6, 1)), (2, date(2025, 6, 1)), (3, date(2025, 6, 2))}


def test_hot_key_keeps_one_row_and_is_limited_before_the_shuffle(spark):
    df = spark.range(30_000).select(F.when(F.col("id") < 10_000, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    out = keep_latest(df, ["k"], [F.desc("v")])
    assert out.count() == 20_001 and out.filter("k = 0").first()["v"] == 9_999
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and "WindowGroupLimit" in plan
    ties = keep_latest_ties(df.withColumn("g", F.lit(1)), ["g"], [F.desc(F.col("k") >= 29_990)])
    assert ties.count() == 10
