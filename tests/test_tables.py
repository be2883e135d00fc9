"""Table maintenance (A4, A9-A18, A20-A22, A24, A25) and quality suites."""

from datetime import date

import pytest
from helpers import dicts
from pyspark.sql import functions as F

from tallyward.operators import quality
from tallyward.schema import EVALUATION_DDL, OPTIONAL_COLUMNS, SILVER_DDL, enforce, evolve, struct_of
from tallyward.session import scratch_path, shuffle_partitions
from tallyward.sources import tables

D = date(2026, 3, 15)


def frame(spark, rows):
    return spark.createDataFrame(rows, "k int, v string, day date")


def content(spark, path):
    return {(r["k"], r["v"]) for r in spark.read.parquet(path).collect()}


def test_slice_replacement(spark, folder):
    e = date(2026, 3, 16)
    tables.replace_slices(frame(spark, [(1, "a", D), (2, "b", e)]), folder, ["day"])
    for _ in range(2):
        tables.replace_slices(frame(spark, [(3, "c", D)]), folder, ["day"])
    assert content(spark, folder) == {(3, "c"), (2, "b")}
    tables.replace_slices(frame(spark, []), folder, ["day"])
    assert content(spark, folder) == {(3, "c"), (2, "b")}
    tables.overwrite(frame(spark, [(9, "z", D)]), folder)
    assert content(spark, folder) == {(9, "z")}


def test_catalog_table_life(spark):
    spark.sql("DROP TABLE IF EXISTS eval_runs")
    assert tables.read_if_exists(spark, "eval_runs") is None
    assert tables.add_missing_columns(spark, "eval_runs", "x int") == []
    for _ in range(2):
        tables.create_if_absent(spark, "eval_runs", EVALUATION_DDL)
    rows = enforce(spark.createDataFrame([("m", "1", D)], "model_name string, model_version string, process_date date"), EVALUATION_DDL)
    for _ in range(2):
        tables.replace_table_slices(rows, "eval_runs")
    assert tables.read_table(spark, "eval_runs").count() == 1
    assert tables.add_missing_columns(spark, "eval_runs", "note string, rmse double") == ["note"]
    assert tables.read_if_exists(spark, "eval_runs").first()["note"] is None
    tables.replace_table_slices(evolve(rows, "note string").withColumn("note", F.lit("n")), "eval_runs")
    assert [r["note"] for r in spark.table("eval_runs").collect()] == ["n"]
    spark.sql("DROP TABLE eval_runs")


def test_silver_table_stores_its_batch_as_a_date(spark):
    spark.sql("DROP TABLE IF EXISTS silver_incidents")
    tables.create_if_absent(spark, "silver_incidents", SILVER_DDL)
    types = dict(spark.table("silver_incidents").dtypes)
    assert len(types) == 39 and types["process_date"] == "date"
    spark.sql("DROP TABLE silver_incidents")


def test_evolve_and_enforce(spark):
    df = evolve(spark.createDataFrame([(1,)], "id int"), OPTIONAL_COLUMNS["predictions"])
    assert dict(df.dtypes)["safety_score"] == "double" and df.first()["safety_score"] is None
    assert evolve(df, OPTIONAL_COLUMNS["predictions"]).columns == df.columns
    for ddl in OPTIONAL_COLUMNS.values():
        assert struct_of(ddl).fields
    bad = enforce(spark.createDataFrame([("x", "true")], "a string, b string"), "a int, b boolean, c date")
    assert tuple(bad.first()) == (None, True, None)


def test_upsert(spark):
    target = spark.createDataFrame([(1, "a"), (None, "n")], "k int, v string")
    updates = spark.createDataFrame([(1, "b", True), (2, "c", False), (None, "m", True)], "k int, v string, extra boolean")
    once = tables.upsert(target, updates, ["k"])
    assert {(r["k"], r["v"]) for r in once.collect()} == {(1, "b"), (2, "c"), (None, "m")}
    assert tables.upsert(once, updates, ["k"]).count() == 3
    only_old = tables.upsert(target, updates.filter("k = 2"), ["k"])
    assert {(r["k"], r["extra"]) for r in only_old.collect()} == {(1, None), (None, None), (2, False)}


def test_upsert_touches_only_its_slices(spark, folder):
    e = date(2026, 3, 16)
    tables.replace_slices(frame(spark, [(1, "a", D), (2, "b", D), (3, "c", e)]), folder, ["day"])
    untouched = {f for f in spark.read.parquet(folder).inputFiles() if "2026-03-16" in f}
    for _ in range(2):
        tables.upsert_slices(spark, folder, frame(spark, [(2, "B", D), (4, "d", D)]), ["k"], "day")
    assert content(spark, folder) == {(1, "a"), (2, "B"), (4, "d"), (3, "c")}
    assert untouched <= set(spark.read.parquet(folder).inputFiles())


def test_merge_from_staging(spark, tmp_path):
    staging, final = str(tmp_path / "s"), str(tmp_path / "f")
    tables.replace_slices(frame(spark, [(1, "a", D), (1, "a", D), (2, "b", date(2026, 3, 16))]), staging, ["day"])
    tables.merge_slices(spark, staging, final, ["k"], [D], "day")
    assert content(spark, final) == {(1, "a")} and spark.read.parquet(final).count() == 1
    tables.merge_slices(spark, staging, final, ["k"], partition_col="day")
    assert spark.read.parquet(final).count() == 2


def test_scratch_follows_the_session_setting(spark, tmp_path, monkeypatch):
    base = spark.conf.get("spark.checkpoint.dir", None)
    path = scratch_path(spark, "x")
    if base:
        assert path.startswith(base)
    assert path != scratch_path(spark, "x")


def test_shuffle_partitions_grow_with_the_input():
    assert shuffle_partitions(10 ** 7, 8) == 16
    assert shuffle_partitions(10 ** 12, 8) == 3726
    assert shuffle_partitions(10 ** 14, 4000) == 50_000


def test_quality_checks(spark):
    df = spark.createDataFrame([(1, "Violent", 5.0, D), (1, "Odd", 500.0, D), (None, None, None, D)],
                               "id int, crime_category string, latitude double, process_date date")
    rows = {r["check"]: r for r in quality.run_checks(df, [
        quality.row_count_at_least(3), quality.null_rate_at_most("id", 0.2), quality.accepted_values("crime_category", quality.CATEGORIES),
        quality.in_range("latitude", -90, 90), quality.freshness("process_date", date(2026, 3, 17)),
        quality.schema_check(df, ["id", "gone"])]).collect()}
    assert rows["row_count>=3"]["passed"]
    assert not rows["null_rate(id)"]["passed"] and rows["accepted_values(crime_category)"]["observed"] == 1
    assert rows["range(latitude)"]["observed"] == 1 and rows["freshness(process_date)"]["observed"] == 2
    assert rows["schema(2 columns)"]["observed"] == 1
    assert quality.unique_check(df, "id").first()["observed"] == 1


def test_suites_and_policy(spark, folder):
    df = spark.createDataFrame([("1", "c", "2026-03-15", "41.0")], "id string, case_number string, date string, latitude string")
    good = quality.run_suite("bronze_parquet", D, df)
    assert quality.fail_if(good, True) == 0
    bad = quality.run_suite("bronze_parquet", D, df.unionByName(df))
    assert quality.fail_if(bad, False) == 1
    with pytest.raises(ValueError, match="unique"):
        quality.fail_if(bad, True)
    for results in (bad, good):
        quality.persist_results(results, folder, D, "run-1")
    assert spark.read.parquet(folder).count() == good.count()
    for name, kwargs in (("nope", {}), ("silver_iceberg", {}), ("gold_bi", {"table": df})):
        with pytest.raises(ValueError):
            quality.run_suite(name, D, **kwargs)


def test_feature_and_prediction_suites(spark):
    feats = spark.createDataFrame([(1, 2, 3, 0.5, 0.0, D), (5, 2, 3, 1.5, 0.0, D)],
                                  "count_3d int, count_7d int, count_14d int, arrest_rate_7d double, domestic_rate_7d double, process_date date")
    failed = {r["check"] for r in dicts(quality.run_suite("gold_ml_features", D, feats)) if not r["passed"]}
    assert failed == {"windows_nested", "range(arrest_rate_7d)"}
    preds = spark.createDataFrame([(4.0, 0.7, 7.3, 60.0, D), (4.0, 8.0, 7.3, 160.0, D)],
                                  "predicted_count double, predicted_count_low double, predicted_count_high double, safety_score double, process_date date")
    failed = {r["check"] for r in dicts(quality.run_suite("ml_predictions", D, preds)) if not r["passed"]}
    assert failed == {"interval_ordered", "range(safety_score)"}
