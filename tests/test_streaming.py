"""Incremental jobs."""

import random
from datetime import date, datetime

from helpers import by, dicts, landing_frame
from pyspark.sql import functions as F

from tallyward.operators.dimensions import crime_type_dimension, location_dimension
from tallyward.operators.features import area_features
from tallyward.plans import fanout
from tallyward.sources.bucket_log import BucketLog
from tallyward.streaming.arrivals import due_days, id_index, landing_stream, merge_latest_silver, run_arrivals
from tallyward.streaming.daily_counts import close_days, counts_log, read_counts, released, windowed_counts, write_updates


def rec(i, day, updated, kind="THEFT", area="8"):
    return {"id": str(i), "case_number": f"C{i}", "date": f"2025-06-{day:02d}T10:00:00", "updated_on": f"2025-07-{updated:02d}T00:00:00",
            "primary_type": kind, "description": "x", "iucr": "1", "community_area": area, "block": "B", "location_description": "STREET",
            "beat": "1", "district": "1"}


def test_arrivals_keep_latest_and_feed_all_writers(spark, tmp_path):
    inbox, silver, state, out = (str(tmp_path / n) for n in ("inbox", "silver", "state", "out"))
    writers = [fanout.star_writer(f"{out}/star", buckets=4), fanout.ml_feature_writer(f"{out}/ml"),
               fanout.area_feature_writer(silver, f"{out}/area"), fanout.graph_writer(f"{out}/graph")]

    def deliver(rows):
        landing_frame(spark, rows).coalesce(1).write.mode("append").parquet(inbox)
        run_arrivals(landing_stream(spark, inbox, max_files=1), silver, state, writers, buckets=4).awaitTermination()

    deliver([rec(1, 1, 1), rec(1, 1, 3, "ROBBERY"), rec(2, 1, 1), rec(3, 4, 1)])
    deliver([rec(1, 1, 2, "ARSON"), rec(2, 1, 9, "BATTERY"), rec(4, 4, 1, area="9")])
    deliver([rec(3, 4, 1)])
    got = {k: v["primary_type"] for k, v in by(spark.read.parquet(silver), "id").items()}
    assert got == {1: "ROBBERY", 2: "BATTERY", 3: "THEFT", 4: "THEFT"}
    assert spark.read.parquet(silver).count() == 4
    assert spark.read.parquet(f"{out}/ml").count() == 4
    assert spark.read.parquet(f"{out}/star/fact_incidents").count() == 4
    stored = spark.read.parquet(silver)
    want = area_features(stored, date(2025, 6, 1), date(2025, 6, 4))
    key = ["area_id", "date", "count_1d", "count_7d", "label_next_day_count"]
    area = spark.read.parquet(f"{out}/area").filter(F.col("date") >= date(2025, 6, 1))
    assert sorted(map(tuple, area.select(key).collect())) == sorted(map(tuple, want.select(key).collect()))
    graph = fanout.read_graph(spark, f"{out}/graph")
    assert graph["Crime"].count() == 4 and graph["edges"].count() == 12 and graph["Date"].count() == 2
    assert by(graph["Crime"], "case_number")["C2"]["primary_type"] == "BATTERY"


def star_of(spark, base):
    return {n: spark.read.parquet(f"{base}/{n}") for n in ("fact_incidents", "dim_location", "dim_date", "daily_summary")}


def test_late_corrections_keep_every_table_whole(spark, tmp_path):
    """An id moves to another day, a day is delivered twice, a day becomes empty, and an old day arrives late."""
    inbox, silver, state, out = (str(tmp_path / n) for n in ("inbox", "silver", "state", "out"))
    writers = [fanout.star_writer(f"{out}/star", buckets=4), fanout.ml_feature_writer(f"{out}/ml"),
               fanout.area_feature_writer(silver, f"{out}/area"), fanout.graph_writer(f"{out}/graph")]

    def deliver(rows):
        landing_frame(spark, rows).coalesce(1).write.mode("append").parquet(inbox)
        run_arrivals(landing_stream(spark, inbox, max_files=1), silver, state, writers, buckets=4).awaitTermination()

    deliver([rec(1, 1, 1), rec(2, 2, 1) | {"block": "OTHER", "location_description": "HOTEL"}, rec(5, 3, 1), rec(6, 9, 1)])
    deliver([rec(1, 2, 2), rec(2, 2, 2) | {"block": "OTHER", "location_description": "HOTEL"}, rec(6, 3, 2)])
    deliver([rec(9, 1, 1) | {"date": "2001-03-01T10:00:00"}])
    stored = spark.read.parquet(silver)
    assert sorted((r["id"], str(r["process_date"])) for r in stored.collect()) == [
        (1, "2025-06-02"), (2, "2025-06-02"), (5, "2025-06-03"), (6, "2025-06-03"), (9, "2001-03-01")]
    star = star_of(spark, f"{out}/star")
    facts = star["fact_incidents"]
    assert facts.count() == 5 and spark.read.parquet(f"{out}/ml").count() == 5
    assert facts.join(star["dim_location"], "location_key", "left_anti").count() == 0
    assert facts.join(star["dim_date"], "date_key", "left_anti").count() == 0
    assert star["daily_summary"].agg(F.sum("total_incidents")).first()[0] == 5
    key = ["area_id", "date", "count_1d", "count_7d", "label_next_day_count"]
    want = sorted(map(tuple, area_features(stored, date(2001, 1, 1), date(2025, 6, 3)).select(key).collect()))
    got = sorted(map(tuple, spark.read.parquet(f"{out}/area").select(key).collect()))
    assert [r for r in got if r[2] or r[3]] == [r for r in want if r[2] or r[3]]
    graph = fanout.read_graph(spark, f"{out}/graph")
    assert graph["Crime"].count() == 5 and graph["edges"].count() == 15


def test_affected_days(spark):
    days = spark.createDataFrame([(date(2001, 1, 5),), (date(2025, 6, 1),), (date(2025, 6, 2),)], "process_date date")
    got = sorted(r[0] for r in fanout.affected_days(days).collect())
    assert got[0] == date(2001, 1, 4) and date(2025, 5, 31) in got and len(got) == len(set(got))
    window = {r[0] for r in fanout.affected_days(fanout.affected_days(days), 1, 14).collect()}
    assert set(got) <= window


def test_bucket_log(spark, folder):
    log = BucketLog(spark, folder, "k bigint, n bigint", "k", buckets=16)
    frame = lambda rows: spark.createDataFrame(rows, "k bigint, n bigint")
    assert log.parts() == [] and log.read().count() == 0 and not log.has(0)
    log.append(frame([(1, 1), (2, 5)]), 0)
    log.append(frame([(1, 2)]), 1)
    log.append(frame([(1, 3)]), 1)  # the same batch again
    log.append(frame([]), 2)
    total = lambda: sorted((r["k"], r["n"]) for r in log.read().groupBy("k").agg(F.sum("n").alias("n")).collect())
    assert total() == [(1, 4), (2, 5)] and log.has(2) and not log.has(3)
    near = log.touched(frame([(1, 0)]).select("k"))
    scan = log.read(near)
    assert {r["k"] for r in scan.collect()} == {1} and len(near) == 1
    merge = lambda rows: rows.groupBy("k").agg(F.sum("n").alias("n"))
    assert log.compact(merge, before=2, parts=1) and total() == [(1, 4), (2, 5)]
    assert [name for _, name in log.parts()] == ["part=1-b", "part=2-d"] and log.has(0)
    log.append(frame([(9, 9)]), 1)  # a replay of a folded batch changes nothing
    assert total() == [(1, 4), (2, 5)] and not log.compact(merge, before=3, parts=5)


def silver_frame(spark, rows):
    """Silver rows from landing-like dicts, as the arrival job makes them."""
    from tallyward.plans.silver import build_silver

    built = build_silver(landing_frame(spark, rows), F.to_date(F.col("date").try_cast("timestamp")))
    return built.withColumn("process_date", F.to_date("process_date"))


def test_merge_reads_the_buckets_of_its_ids_only(spark, folder):
    merge_latest_silver(spark, folder, silver_frame(spark, [rec(i, 1 + i % 9, 1) for i in range(300)]), 0)
    index = id_index(spark, folder)
    near = index.touched(spark.createDataFrame([(5,)], "id bigint"))
    plan = index.read(near)._jdf.queryExecution().executedPlan().toString()
    assert len(near) == 1 and "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    assert index.read(near).count() < 40
    touched = merge_latest_silver(spark, folder, silver_frame(spark, [rec(5, 20, 2)]), 1)
    assert {str(r["process_date"]) for r in touched.collect()} == {"2025-06-06", "2025-06-20"}
    rows = spark.read.parquet(folder)
    assert rows.count() == 300 and rows.filter("id = 5").first()["process_date"] == date(2025, 6, 20)


def test_merge_indexes_a_table_without_one_and_survives_replay(spark, folder):
    from tallyward.sources.tables import replace_slices

    replace_slices(silver_frame(spark, [rec(1, 1, 1), rec(2, 2, 1)]), folder, ["process_date"])
    for _ in range(2):  # the second run is a replay
        merge_latest_silver(spark, folder, silver_frame(spark, [rec(1, 3, 2), rec(3, 3, 1)]), 0)
        assert sorted((r["id"], r["process_date"].day) for r in spark.read.parquet(folder).collect()) == [(1, 3), (2, 2), (3, 3)]


def test_dimensions_follow_counts_through_random_corrections(spark, tmp_path):
    """Kept-up dimensions equal dimensions built from all of silver, also when a batch dies between its steps and runs again."""
    rng = random.Random(3)
    silver, base = str(tmp_path / "silver"), str(tmp_path / "star")
    write = fanout.star_writer(base, buckets=4)

    def run(batch_id, rows, stop_after=None):
        touched = merge_latest_silver(spark, silver, silver_frame(spark, rows), batch_id, 4)
        stored = spark.read.parquet(silver)
        changed = stored.join(touched.filter("not emptied"), "process_date", "left_semi").select(stored.columns)
        emptied = touched.filter("emptied").select("process_date")
        if stop_after:
            for name in fanout.MEMBERS:
                kept = fanout.MemberCounts(spark, base, name, "xxhash64", 4)
                kept.update(changed, emptied, batch_id)
                if stop_after == "counts":
                    return
        write(changed, emptied, batch_id)

    for batch_id in range(3):
        rows = [rec(rng.randrange(25), rng.randrange(1, 5), batch_id + 1, kind=rng.choice(["THEFT", "ARSON", "BATTERY"]),
                    area=str(rng.randrange(4))) | {"block": rng.choice("XYZ"), "ward": rng.choice(["1", "2", None])}
                for _ in range(12 if batch_id else 40)]
        if batch_id == 1:
            run(batch_id, rows, stop_after="counts")
        run(batch_id, rows)
        stored = spark.read.parquet(silver)
        want = {"dim_location": location_dimension(stored, date(2025, 1, 1), unknown_member=True),
                "dim_crime_type": crime_type_dimension(stored, date(2025, 1, 1))}
        for name, dim in want.items():
            skip = {"created_date", "updated_date", "bucket"}
            columns = [c for c in dim.columns if c not in skip]
            got = spark.read.parquet(f"{base}/{name}")
            assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, dim.select(columns).collect())), (batch_id, name)
        facts = spark.read.parquet(f"{base}/fact_incidents")
        assert facts.count() == stored.count()
        assert facts.join(spark.read.parquet(f"{base}/dim_date"), "date_key", "left_anti").count() == 0


def test_day_counts_over_several_batches(spark, tmp_path):
    inbox, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = [(datetime(2026, 1, 1 + i % 5, i % 24), i % 3) for i in range(60)]
    schema = "ts timestamp, user_id int"
    for part in (rows[:20], rows[20:40], rows[40:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(inbox)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(inbox)
    counts = windowed_counts(stream, "ts", "user_id", {"n": F.count(F.lit(1))})
    write_updates(counts, out, state).awaitTermination()
    want = {}
    for ts, user in rows:
        want[(user, ts.date())] = want.get((user, ts.date()), 0) + 1
    assert {(r["area_id"], r["event_date"]): r["n"] for r in dicts(read_counts(spark, out))} == want


def test_closed_days_keep_their_counts(spark, tmp_path):
    path = str(tmp_path / "counts")
    ddl = "area_id bigint, event_date date, n bigint"
    log = counts_log(spark, path, ddl, 4)
    day = lambda k: date(2026, 1, k)
    log.append(spark.createDataFrame([(1, day(1), 5), (1, day(2), 1), (2, day(1), 7)], ddl), 0)
    log.append(spark.createDataFrame([(1, day(2), 4), (1, day(3), 2)], ddl), 1)
    want = {(1, day(1), 5), (2, day(1), 7), (1, day(2), 4), (1, day(3), 2)}
    got = lambda: {tuple(r) for r in read_counts(spark, path, ddl, 4).select("area_id", "event_date", "n").collect()}
    assert got() == want
    for _ in range(2):
        close_days(spark, path, ddl, day(3), 4)
        assert got() == want
    assert {r["event_date"] for r in log.read().collect()} == {day(3)}
    log.append(spark.createDataFrame([(1, day(3), 9)], ddl), 2)
    assert got() == want - {(1, day(3), 2)} | {(1, day(3), 9)}
    assert {r["event_date"] for r in released(spark, path, ddl, day(12)).collect()} == {day(1), day(2)}
    assert {r["event_date"] for r in released(spark, path, ddl, day(11)).collect()} == {day(1)}
    assert released(spark, path, ddl, day(5)).count() == 0


def test_due_days():
    assert due_days(date(2026, 1, 1), date(2026, 1, 13)) == [date(2026, 1, 1), date(2026, 1, 2), date(2026, 1, 3)]
    assert due_days(date(2026, 1, 10), date(2026, 1, 13)) == []
