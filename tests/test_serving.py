"""Snapshot and read queries."""

import random
from datetime import date, datetime, timedelta

import pytest
from helpers import by, dicts
from pyspark.sql import functions as F

from tallyward.functions.measures import safety_band, trend_direction
from tallyward.operators import serving
from tallyward.schema import SNAPSHOT_DDL, struct_of

P = date(2026, 3, 15)


def prediction_rows(spark, rows):
    """rows: (area_id, process_date, prediction_date, predicted, low, high, safety)"""
    data = [("community_area", a, p, d, d + timedelta(days=1), c, lo, hi, s, "m", "1", "r", datetime(2026, 3, 15))
            for a, p, d, c, lo, hi, s in rows]
    return spark.createDataFrame(data, "area_type string, area_id int, process_date date, prediction_date date, target_date date, "
                                       "predicted_count double, predicted_count_low double, predicted_count_high double, safety_score double, "
                                       "model_name string, model_version string, run_id string, created_at timestamp")


@pytest.fixture(scope="module")
def snap(spark):
    preds = prediction_rows(spark, [
        (1, P, P, 4.0, 1.0, 7.0, 80.0), (1, P, P + timedelta(days=1), 5.0, None, None, None), (2, P, P, 1.0, 0.0, 2.0, 70.0),
        (1, P - timedelta(days=1), P, 9.0, 0.0, 9.0, 10.0),
    ])
    ml = spark.createDataFrame(
        [(P - timedelta(days=b), a, c) for a, c, b, n in (
            (1, "Violent", 0, 3), (1, "Drug", 5, 2), (1, "Property", 90, 2), (1, "Other", 1, 1), (1, "Weapons", 91, 9),
            (2, "Drug", 0, 1), (2, "Violent", 0, 4), (0, "Drug", 0, 9)) for _ in range(n)],
        "process_date date, community_area int, crime_category string")
    feats = spark.createDataFrame([("community_area", 1, P, 7, 3), ("community_area", 1, P - timedelta(days=1), 99, 99)],
                                  "area_type string, area_id int, process_date date, count_7d int, violent_count_7d int")
    names = spark.createDataFrame([("1.0", "Uptown")], "area_num_1 string, name string")
    newer = serving.build_snapshot(preds, ml, feats, P, names)
    older = serving.build_snapshot(preds, ml, feats, P - timedelta(days=1))
    return newer.unionByName(older)


def test_snapshot_columns_and_defaults(snap):
    assert [(f.name, f.dataType) for f in snap.schema] == [(f.name, f.dataType) for f in struct_of(SNAPSHOT_DDL)]
    rows = {(r["area_id"], r["process_date"], r["prediction_date"]): r for r in snap.collect()}
    full, bare = rows[(1, P, P)], rows[(1, P, P + timedelta(days=1))]
    assert (full["top_crime_1"], full["top_crime_2"], full["top_crime_3"]) == ("Violent", "Drug", "Property")
    assert (full["count_7d"], full["violent_count_7d"], full["area_name"]) == (7, 3, "Uptown")
    assert (bare["predicted_count_low"], bare["predicted_count_high"], bare["safety_score"]) == (0.0, 5.0, 0.0)
    two = rows[(2, P, P)]
    assert (two["top_crime_1"], two["top_crime_2"], two["top_crime_3"]) == ("Violent", "Drug", None)
    assert two["count_7d"] is None and two["area_name"] is None


def test_all_batches_at_once_equal_one_by_one(spark):
    rng = random.Random(6)
    days = [P - timedelta(days=b) for b in range(0, 120, 7)]
    preds = prediction_rows(spark, [(a, d, d + timedelta(days=h), 1.0 + (a or 0), None, 2.0, 50.0) for a in (1, 2, 3, None) for d in days
                                    for h in (0, 1)])
    ml = spark.createDataFrame([(P - timedelta(days=rng.randrange(-3, 240)), rng.choice([0, 1, 2, 2, 2, None]),
                                 rng.choice(["Drug", "Violent", "Other", "Property", "Weapons", None])) for _ in range(400)],
                               "process_date date, community_area int, crime_category string")
    feats = spark.createDataFrame([("community_area", 1, d, 7, 3) for d in days[::2]],
                                  "area_type string, area_id int, process_date date, count_7d int, violent_count_7d int")
    want = [tuple(r) for d in days for r in serving.build_snapshot(preds, ml, feats, d).collect()]
    got = [tuple(r) for r in serving.build_snapshots(preds, ml, feats).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 4 * len(days) * 2


def test_list_areas(spark, snap):
    names = spark.createDataFrame([(2, "West Ridge")], "area_id int, area_name string")
    rows = dicts(serving.list_areas(snap, names=names))
    assert [(r["area_id"], r["name"], r["prediction_date"], r["safety_band"]) for r in rows] == [
        (1, "Uptown", P + timedelta(days=1), "low"), (2, "West Ridge", P, "high")]
    assert rows[1]["top_categories"] == [{"label": "Violent", "rank": 1}, {"label": "Drug", "rank": 2}]
    on_day = dicts(serving.list_areas(snap, P, P))
    assert [(r["area_id"], r["safety_score"]) for r in on_day] == [(1, 80.0), (2, 70.0)]


def test_city_queries(snap):
    assert dicts(serving.city_summary(snap)) == [{"process_date": P, "average_safety": 35.0, "total_areas": 2}]
    assert serving.city_summary(snap, date(2020, 1, 1)).count() == 0
    row = dicts(serving.city_compare(snap))[0]
    assert (row["average_safety_current"], row["average_safety_previous"], row["delta_average_safety"], row["direction"]) == (
        35.0, 10.0, 25.0, "up")
    same_day = dicts(serving.city_compare(snap, P, P))[0]
    assert same_day["total_areas_current"] == 2 and same_day["average_safety_current"] == 75.0
    one = snap.filter(F.col("process_date") == P)
    assert serving.city_compare(one, strict=False).count() == 0
    with pytest.raises(ValueError):
        serving.city_compare(one)
    assert [r[0] for r in serving.recent_batches(snap).collect()] == [P, P - timedelta(days=1)]


def test_bands_and_trend(spark):
    df = spark.createDataFrame([(70.0,), (69.99,), (40.0,), (39.99,), (None,)], "s double")
    assert [r[0] for r in df.select(safety_band(F.col("s"))).collect()] == ["high", "medium", "medium", "low", "no_data"]
    df = spark.createDataFrame([(0.5,), (0.0,), (-0.5,), (1e-7,)], "d double")
    assert [r[0] for r in df.select(trend_direction(F.col("d"))).collect()] == ["up", "flat", "down", "flat"]


def test_equal_counts_rank_by_name(spark):
    df = spark.createDataFrame([(P, 1, c) for c in ("b", "a", "c", "d")], "process_date date, community_area int, crime_category string")
    assert by(serving.top_categories(df, P, P), "area_id")[1] == {
        "area_id": 1, "top_crime_1": "a", "top_crime_2": "b", "top_crime_3": "c"}
