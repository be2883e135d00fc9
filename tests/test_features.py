"""Area-day features (B32-B34, B46, C6-C8, D1, E6, G3, G6) and horizon sets."""

import random
from datetime import date, timedelta

import pytest
from helpers import by
from pyspark.sql import functions as F

from tallyward.operators.features import area_daily_counts, area_features
from tallyward.operators.horizon import expand_horizons, split_rows, split_sizes, split_windows
from tallyward.plans.area_risk import write_features
from tallyward.schema import FEATURE_DDL, struct_of
from tallyward.sources.tables import replace_slices

D = date(2026, 3, 15)


def silver_frame(spark, rows):
    """rows: (area text or None, days before D, arrest, violent)"""
    data = [(a, (D - timedelta(days=back)).isoformat() + " 10:00:00", arrest, arrest, violent, 1 - violent, 0, 0)
            for a, back, arrest, violent in rows]
    df = spark.createDataFrame(data, "community_area string, d string, arrest boolean, domestic boolean, violent_crime_flag int, "
                                     "property_crime_flag int, drug_crime_flag int, weapon_crime_flag int")
    return df.withColumn("date", F.to_timestamp("d")).drop("d").withColumns(
        {c: F.lit("x") for c in ("crime_type_key", "crime_category")})


def features(spark, rows, **kw):
    return by(area_features(silver_frame(spark, rows), D, **kw), "area_id")


def test_gaps_and_window_edges(spark):
    got = features(spark, [
        ("8", 2, False, 0), ("8", 2, False, 0), ("8", 0, False, 0),
        ("1", 6, False, 0), ("1", 7, False, 0),
        ("2", 13, False, 0), ("2", 14, False, 0),
        ("3", 10, False, 0),
        ("4", 1, True, 1), ("4", 2, False, 0), ("4", 3, False, 0),
        ("5", -1, False, 1), ("5", -1, False, 0), ("5", -1, False, 0), ("5", -1, False, 0),
        ("6", 15, False, 0), ("7", -2, False, 0),
    ])
    pick = lambda a, *cols: tuple(got[a][c] for c in cols)
    assert pick(8, "count_1d", "count_3d", "count_7d", "count_14d") == (1, 3, 3, 3)
    assert pick(1, "count_7d", "count_14d") == (1, 2)
    assert pick(2, "count_14d") == (1,)
    assert pick(3, "count_7d", "arrest_rate_7d", "violent_count_7d") == (0, 0.0, 0)
    assert got[4]["arrest_rate_7d"] == pytest.approx(1 / 3) and got[4]["violent_count_7d"] == 1
    assert pick(5, "count_1d", "label_next_day_count", "label_next_day_violent_count") == (0, 4, 1)
    assert pick(8, "label_next_day_count") == (0,)
    assert set(got) == {8, 1, 2, 3, 4, 5}


def test_schema_and_calendar(spark):
    out = area_features(silver_frame(spark, [("8", 0, True, 1)]), D)
    assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in struct_of(FEATURE_DDL)]
    row = out.first()
    assert (row["day_of_week"], row["is_weekend"], row["month"], row["season"], row["date_key"]) == (1, 1, 3, 2, 20260315)


def test_null_area_is_one_zero_row(spark):
    got = features(spark, [(None, 0, True, 1), ("", 1, True, 1), ("8", 0, False, 0)])
    assert got[None]["count_1d"] == got[None]["count_7d"] == 0 and got[None]["arrest_rate_7d"] == 0.0
    assert area_features(silver_frame(spark, [(None, 0, True, 1), (None, 3, True, 1)]), D).count() == 1


def test_unknown_next_day_label(spark):
    rows = [("8", 0, False, 0), ("8", 1, False, 0)]
    assert features(spark, rows)[8]["label_next_day_count"] == 0
    assert features(spark, rows, label_fill="null")[8]["label_next_day_count"] is None
    assert features(spark, [*rows, ("9", -1, False, 0)], label_fill="null")[8]["label_next_day_count"] == 0


def test_roster_adds_quiet_areas(spark):
    roster = spark.createDataFrame([(8,), (77,)], "area_id int")
    got = features(spark, [("8", 0, True, 1)], roster=roster)
    assert set(got) == {8, 77} and got[77]["count_14d"] == 0 and got[8]["count_1d"] == 1


def test_backfill_equals_single_days_and_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["1", "2", "3", None]), rng.choice([*range(0, 8), *range(25, 45), 60]), rng.random() < .4, int(rng.random() < .5))
            for _ in range(60)]
    silver = silver_frame(spark, rows)
    start = D - timedelta(days=50)
    backfill = {(r["area_id"], r["date"]): r for r in area_features(silver, start, D).collect()}
    want = {}
    for back in range(51):
        day = D - timedelta(days=back)
        for area in {a for a, b, *_ in rows if back - 1 <= b <= back + 14}:
            mine = [] if area is None else [r for r in rows if r[0] == area]
            count = lambda lo, hi: sum(lo <= b - back <= hi for _, b, *_ in mine)
            want[(None if area is None else int(area), day)] = (count(0, 0), count(0, 2), count(0, 6), count(0, 13), count(-1, -1))
    got = {k: (r["count_1d"], r["count_3d"], r["count_7d"], r["count_14d"], r["label_next_day_count"]) for k, r in backfill.items()}
    assert got == want
    for back in (0, 9, 30):
        day = D - timedelta(days=back)
        single = {r["area_id"]: r for r in area_features(silver, day).collect()}
        assert single == {a: r for (a, d), r in backfill.items() if d == day}


def test_backfill_plan_has_one_exchange_per_step(spark):
    plan = area_features(silver_frame(spark, [("1", 0, True, 1)]), D - timedelta(days=300), D)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    assert "Join" not in plan and "Cartesian" not in plan


def test_feature_window_prunes_slices_and_is_pushed_down(spark, folder):
    silver = silver_frame(spark, [(str(i % 3 + 1), i, True, 1) for i in range(60)]).withColumn("process_date", F.to_date("date"))
    replace_slices(silver, folder, ["process_date"])
    stored = spark.read.parquet(folder)
    df = area_features(stored, D - timedelta(days=5), D - timedelta(days=3), by_slice=True)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date" in plan and "LessThan(date" in plan
    assert "PartitionFilters: [isnotnull(process_date" in plan
    assert "crime_type_key" not in plan[plan.index("ReadSchema"):]
    write_features(stored, f"{folder}-features", D - timedelta(days=5), D - timedelta(days=3))
    key = ["area_id", "date", "count_1d", "count_14d", "label_next_day_count"]
    got = sorted(map(tuple, spark.read.parquet(f"{folder}-features").select(key).collect()))
    assert got == sorted(map(tuple, area_features(silver, D - timedelta(days=5), D - timedelta(days=3)).select(key).collect()))


def test_bad_arguments(spark):
    df = silver_frame(spark, [("1", 0, True, 1)])
    with pytest.raises(ValueError):
        area_features(df, D, D - timedelta(days=1))
    with pytest.raises(ValueError):
        area_daily_counts(df, "beat")


def test_horizon_rows_match_a_join(spark):
    rng = random.Random(9)
    rows = [(rng.choice("123"), rng.randrange(0, 40), True, 1) for _ in range(50)]
    feats = area_features(silver_frame(spark, rows), D - timedelta(days=40), D).filter(F.col("area_id") != 3)
    start, end = D - timedelta(days=35), D - timedelta(days=12)
    got = {(r["area_id"], r["event_date"], r["horizon"], r["label_next_day_count"]) for r in expand_horizons(feats, start, end).collect()}
    counts = {(r["area_id"], r["date"]): r["count_1d"] for r in feats.collect()}
    want = {(a, d, h, counts[(a, d + timedelta(days=h))]) for (a, d) in counts if start <= d <= end
            for h in range(1, 11) if (a, d + timedelta(days=h)) in counts}
    assert got == want


def test_splits(spark):
    w = split_windows(date(2026, 12, 31))
    assert (w["train"][1] - w["train"][0]).days == 300 and (w["test"][1] - w["test"][0]).days == 30
    feats = area_features(silver_frame(spark, [("1", b, True, 1) for b in range(40)]), D - timedelta(days=39), D)
    expanded = expand_horizons(feats, D - timedelta(days=30), D)
    windows = {"train": (D - timedelta(days=30), D - timedelta(days=20)), "val": (D - timedelta(days=19), D - timedelta(days=10)),
               "test": (D - timedelta(days=9), D)}
    sizes = {r["split"]: r["row_count"] for r in split_sizes(expanded, windows).collect()}
    assert sizes == {"train": 110, "val": 100, "test": 45}
    assert split_rows(expanded, windows["train"], embargo=True).count() == 55
    assert split_rows(expanded, windows["train"]).count() == 110
