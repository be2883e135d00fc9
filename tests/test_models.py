"""Scoring arithmetic, metrics, drift, registry, training."""

import math
import random
from datetime import date, datetime, timedelta

import pytest
from helpers import by, dicts
from pyspark.sql import functions as F

from tallyward.functions.measures import poisson_high, poisson_low, safety_score
from tallyward.operators.horizon import split_windows
from tallyward.operators.monitoring import (
    actual_column, daily_moments, drift, evaluate, mean_shift, merged_moments, shifts_of_days,
)
from tallyward.operators.registry import has_production, promote, promotion, resolve_model
from tallyward.operators.scoring import finish_predictions, scoring_frame
from tallyward.operators.training import (
    build_pipeline, finite_only, load_model, model_complete, regression_metrics, run_parameters, save_model, train,
)
from tallyward.plans.area_risk import daily_scoring, score_batch
from tallyward.schema import PREDICTION_DDL, struct_of

D = date(2026, 3, 15)


def test_interval_and_safety(spark):
    df = spark.createDataFrame([(4.0,), (1.0,), (0.0,), (-1.0,), (None,)], "p double")
    rows = [tuple(r) for r in df.select(poisson_low(F.col("p")), poisson_high(F.col("p"))).collect()]
    assert rows == [(0.7, 7.3), (0.0, 2.7), (0.0, 0.0), (0.0, 0.0), (None, None)]
    df = spark.createDataFrame([(0.0,), (2.5,), (10.0,), (12.0,), (None,)], "p double")
    assert [r[0] for r in df.select(safety_score(F.col("p"), F.lit(10.0))).collect()] == [100.0, 75.0, 0.0, 0.0, 100.0]
    assert df.select(safety_score(F.col("p"), F.lit(0.0)).alias("s")).collect()[1]["s"] == 0.0


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 5.0)], "y double, p double")
    m = df.agg(*[c.alias(n) for n, c in regression_metrics(F.col("y"), F.col("p")).items()]).first()
    assert m["rmse"] == pytest.approx(math.sqrt(4 / 3)) and m["mae"] == pytest.approx(2 / 3) and m["r2"] == pytest.approx(-1)
    flat = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "y double, p double")
    assert flat.agg(regression_metrics(F.col("y"), F.col("p"))["r2"].alias("r")).first()["r"] == float("-inf")


def feature_rows(spark, days, areas=(1, 2)):
    rows = [("community_area", a, D - timedelta(days=b), a + b % 3, 3, 7, 14, 1, 0.5, 0.25, 0) for a in areas for b in days]
    df = spark.createDataFrame(rows, "area_type string, area_id int, date date, count_1d int, count_3d int, count_7d int, count_14d int, "
                                     "violent_count_7d int, arrest_rate_7d double, domestic_rate_7d double, violent_count_1d int")
    return df.withColumns({"day_of_week": F.dayofweek("date"), "is_weekend": F.lit(0), "month": F.month("date"),
                           "season": F.lit(2), "process_date": F.col("date")})


def test_scoring_frame(spark):
    frame = scoring_frame(feature_rows(spark, range(3)), D)
    assert frame.count() == 22
    rows = sorted(((r["horizon"], r["event_date"], r["day_of_week"], r["is_weekend"]) for r in frame.filter("area_id = 1").collect()))
    assert rows[0] == (0, D, 1, 1) and rows[10] == (10, D + timedelta(days=10), 4, 0)
    assert scoring_frame(feature_rows(spark, range(3))).count() == 66
    assert scoring_frame(feature_rows(spark, [0]), D - timedelta(days=9)).count() == 0


def test_predictions(spark):
    scored = scoring_frame(feature_rows(spark, [0, 1])).withColumn("prediction", F.col("horizon") + F.lit(0.0))
    out = finish_predictions(scored, "r", "m", "3")
    assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in struct_of(PREDICTION_DDL)]
    row = out.filter((F.col("process_date") == D) & (F.col("predicted_count") == 5)).first()
    assert row["safety_score"] == 50.0 and row["target_date"] == row["prediction_date"] + timedelta(days=1)
    same = finish_predictions(scored, "r", "m", "3", target_offset_days=0).first()
    assert same["target_date"] == same["prediction_date"]


def predictions(spark, rows):
    return spark.createDataFrame(rows, "run_id string, model_name string, model_version string, prediction_date date, target_date date, "
                                       "prediction_target string, area_type string, area_id int, predicted_count double, process_date date")


def test_evaluation(spark):
    feats = feature_rows(spark, range(5))
    preds = predictions(spark, [
        ("r", "m", v, D - timedelta(days=b + 1), D - timedelta(days=b), target, "community_area", a, p, D - timedelta(days=b + 1))
        for v, b, target, a, p in (("1", 1, "total_count", 1, 2.0), ("1", 2, "total_count", 1, 3.0), ("2", 1, "total_count", 2, 5.0),
                                   ("2", 1, "violent", 2, 9.0), ("1", 9, "total_count", 1, 9.0))])
    rows = dicts(evaluate(preds, feats, D - timedelta(days=7), D - timedelta(days=1), D))
    assert {(r["model_version"], r["row_count"]) for r in rows} == {("1", 3), ("2", 3)}
    assert {round(r["rmse"], 6) for r in rows} == {round(math.sqrt(4 / 3), 6)}
    per = by(evaluate(preds, feats, D - timedelta(days=7), D - timedelta(days=1), D, per_model=True), "model_version")
    assert per["1"]["rmse"] == 0 and per["2"]["rmse"] == 2
    old = evaluate(preds.drop("prediction_target"), feats, D - timedelta(days=7), D - timedelta(days=1), D, target="violent")
    assert old.first()["row_count"] == 4
    assert evaluate(None, feats, D, D, D) is None
    assert evaluate(preds, feats, date(2020, 1, 1), date(2020, 1, 2), D).count() == 0
    with pytest.raises(ValueError):
        actual_column("fraud")
    assert actual_column("drug") == "drug_count_1d"


def test_drift_of_all_days_equals_day_by_day(spark):
    rng = random.Random(2)
    days = [D - timedelta(days=b) for b in range(0, 80) if b % 7 != 3]
    rows = [(d, rng.choice([None, rng.random() * 10]), rng.randrange(5)) for d in days for _ in range(rng.randrange(1, 5))]
    df = spark.createDataFrame(rows, "date date, x double, k int")
    halves = [daily_moments(df.filter(c), "date", ["x", "k"]) for c in ("k < 2", "k >= 2")]
    states = merged_moments(halves[0].unionByName(halves[1]))
    got = {(r["eval_date"], r["field_name"]): r for r in shifts_of_days(states, "m").collect()}
    for d in days[::9]:
        for want in mean_shift(df, "date", ["x", "k"], d, 30, "m").collect():
            have = got[d, want["field_name"]]
            assert (have["_n_ref"], have["_n_cur"], have["ref_start"], have["ref_end"]) == (
                want["_n_ref"], want["_n_cur"], want["ref_start"], want["ref_end"])
            for c in ("ref_mean", "ref_std", "cur_mean", "drift_score"):
                assert have[c] == pytest.approx(want[c], rel=1e-9, nan_ok=True)


def test_drift(spark):
    df = spark.createDataFrame([(D - timedelta(days=2), 1.0), (D - timedelta(days=1), 3.0), (D, 5.0), (D - timedelta(days=40), 99.0)],
                               "date date, x double")
    row = mean_shift(df, "date", ["x"], D, 30, "m").first()
    assert (row["ref_mean"], row["ref_std"], row["cur_mean"]) == (2.0, 1.0, 5.0) and row["drift_score"] == pytest.approx(3)
    empty = mean_shift(df.filter(F.col("date") == D), "date", ["x"], D, 30, "m").first()
    assert math.isnan(empty["drift_score"]) and math.isnan(empty["ref_mean"])
    flat = spark.createDataFrame([(D - timedelta(days=1), 1.0), (D, 2.0)], "date date, x double")
    assert mean_shift(flat, "date", ["x"], D, 30, "m").first()["drift_score"] == pytest.approx(1e9)
    preds = predictions(spark, [("r", "m", "1", D, D, "total_count", "community_area", 1, 2.0, D)])
    feats = feature_rows(spark, range(5))
    assert drift(feats, preds, D, D).count() == 11
    both = preds.unionByName(preds.withColumn("prediction_date", F.lit(D - timedelta(days=3))))
    assert drift(feats, both, D, D).count() == 12 and drift(feats, None, D, D).count() == 11


def registry_frame(spark, rows):
    return spark.createDataFrame([("m", v, f"r{v}", path, metric, stage, datetime(2026, 1, v)) for v, metric, stage, path in rows],
                                 "model_name string, version int, run_id string, model_path string, metric double, stage string, created_at timestamp")


@pytest.mark.parametrize("rows, stages, decision", [
    ([(1, 1.0, "Production", None), (2, 1.0, "None", None)], {1: "Production", 2: "None"}, "not_promoted"),
    ([(1, 1.0, "Production", None), (2, 0.9, "None", None)], {1: "Archived", 2: "Production"}, "promoted"),
    ([(2, 5.0, "None", None)], {2: "Production"}, "promoted"),
    ([(2, None, "None", None)], {2: "None"}, "not_promoted"),
    ([(2, float("nan"), "None", None)], {2: "None"}, "not_promoted"),
    ([(1, None, "Production", None), (2, 9.0, "None", None)], {1: "Archived", 2: "Production"}, "promoted"),
])
def test_promotion(spark, rows, stages, decision):
    out = by(promotion(registry_frame(spark, rows)), "version")
    assert {v: r["stage"] for v, r in out.items()} == stages
    assert out[2]["decision"] == decision


def test_incomplete_model_is_not_promoted(spark, folder):
    with pytest.raises(RuntimeError):
        promote(registry_frame(spark, [(2, 1.0, "None", folder)]))


def test_resolve(spark):
    reg = registry_frame(spark, [(1, 1.0, "Production", "s3://b/x"), (2, 2.0, "Production", "s3a://b/y"), (3, 3.0, "None", None)])
    assert resolve_model(reg, "m", "Production").first()["version"] == 2
    assert resolve_model(reg, "m", "1").first()["model_path"] == "s3a://b/x"
    assert has_production(reg, "m") and not has_production(reg, "other")


def test_finite_only(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", float("nan")), ("c", float("inf")), ("d", None)], "metric string, value double")
    kept, dropped = finite_only(df)
    assert [r["metric"] for r in kept.collect()] == ["a"] and {r["metric"] for r in dropped.collect()} == {"b", "c", "d"}


def test_train_save_score(spark, folder):
    run = date(2026, 12, 31)
    first = split_windows(run)["train"][0]
    span = (run - first).days + 1
    feats = feature_rows(spark, range((D - run).days, (D - run).days + span, 3), areas=(1, 2, 3)).withColumn(
        "arrest_rate_7d", F.when(F.col("area_id") > 1, F.col("arrest_rate_7d")))
    model, metrics = train(feats, split_windows(run), params={"num_round": 2})
    assert {"train_row_count", "val_rmse", "test_rmse", "test_row_count"} <= set(metrics)
    assert not model_complete(spark, folder)
    save_model(model, folder)
    again = load_model(spark, folder)
    day = feats.agg(F.max("date")).first()[0]
    one, two = score_batch(feats, model, day, "m", "1"), score_batch(feats, again, day, "m", "1")
    key = ["area_id", "prediction_date", "predicted_count"]
    assert sorted(map(tuple, one.select(key).collect())) == sorted(map(tuple, two.select(key).collect())) and one.count() == 33
    reg = registry_frame(spark, [(1, 1.0, "Production", folder)])
    assert daily_scoring(feats, reg, "m", day, f"{folder}-predictions")
    assert spark.read.parquet(f"{folder}-predictions").count() == 33
    assert not daily_scoring(feats, reg.filter("version = 9"), "m", day, f"{folder}-none")


def test_training_needs_all_splits(spark):
    assert train(feature_rows(spark, range(5)), split_windows(D)) is None
    with pytest.raises(FileNotFoundError):
        load_model(spark, "/nonexistent")


def test_pipeline_and_provenance(spark):
    stages = build_pipeline().getStages()
    assert stages[0].getStrategy() == "median" and stages[2].getMaxDepth() == 5 and stages[2].getMaxIter() == 1000
    row = run_parameters(spark, "r1", "features", split_windows(D), tags={"owner": "me"}).first()
    assert row["params"]["max_depth"] == "5" and row["tags"]["model_role"] == "challenger" and row["tags"]["owner"] == "me"
    with pytest.raises(ValueError):
        build_pipeline(engine="forest")
