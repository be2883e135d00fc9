"""Structured Streaming jobs run to completion over the whole events table."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from tallyward.catalog import inputs
from tallyward.catalog.oracle_blocks import EVENT_KIND
from tallyward.plans.fanout import area_feature_writer, graph_writer, ml_feature_writer, read_graph, star_writer
from tallyward.session import scratch_path
from tallyward.streaming.arrivals import SOURCE_LAG_DAYS, landing_stream, run_arrivals
from tallyward.streaming.daily_counts import close_days, read_counts, released, windowed_counts, write_updates


#: Of the id index and the dimensions; enough for tables of this size.
BUCKETS = 8


COUNTS_DDL = "area_id bigint, event_date date, count_1d bigint, errors bigint, purchases bigint"


def _count_days(spark, sf):
    schema = inputs.table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    counts = windowed_counts(events, "ts", "user_id", {
        "count_1d": F.count(F.lit(1)),
        "errors": F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)),
        "purchases": F.sum(F.when(F.col("event_type") == "purchase", 1).otherwise(0)),
    })
    path = scratch_path(spark, "stream-daily")
    counts = counts.withColumn("area_id", F.col("area_id").cast("bigint"))
    write_updates(counts, path, scratch_path(spark, "stream-daily-state"), BUCKETS).awaitTermination()
    return path


def stream_daily(spark, sf):
    """Tumbling day counts per user with a ten-day watermark; equals the batch result."""
    return read_counts(spark, _count_days(spark, sf), COUNTS_DDL, BUCKETS)


def stream_due(spark, sf):
    """Days that the watermark has passed are closed, twice, and the days due by the newest event are released."""
    path = _count_days(spark, sf)
    newest = inputs.table(spark, sf, "events").agg(F.to_date(F.max("ts"))).first()[0]
    for _ in range(2):
        close_days(spark, path, COUNTS_DDL, newest - timedelta(days=SOURCE_LAG_DAYS - 1), BUCKETS)
    open_days = read_counts(spark, path, COUNTS_DDL, BUCKETS).groupBy("event_date").agg(F.sum("count_1d").alias("counted"))
    due = released(spark, path, COUNTS_DDL, newest).groupBy("event_date").agg(
        F.count(F.lit(1)).alias("areas"), F.sum("count_1d").alias("events"))
    return open_days.join(due, "event_date", "left")


STREAM_DAILY = """SELECT user_id AS area_id, CAST(ts AS DATE) AS event_date, count(*) AS count_1d,
  CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors,
  CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS purchases FROM events GROUP BY 1, 2"""


STREAM_DUE = f"""SELECT event_date, counted, CASE WHEN due THEN areas END AS areas, CASE WHEN due THEN counted END AS events FROM (
  SELECT CAST(ts AS DATE) AS event_date, CAST(count(*) AS BIGINT) AS counted, count(DISTINCT user_id) AS areas,
    CAST(ts AS DATE) <= (SELECT CAST(max(ts) AS DATE) - {SOURCE_LAG_DAYS} FROM events) AS due FROM events GROUP BY 1)"""


def _run_stream(spark, sf):
    """Two deliveries as separate micro-batches; the second corrects the even ids."""
    inbox, silver = scratch_path(spark, "inbox"), scratch_path(spark, "stream-silver")
    features, state = scratch_path(spark, "stream-ml"), scratch_path(spark, "stream-silver-state")
    for delivery in (1, 2):
        inputs.event_landing(spark, sf, delivery).write.mode("append").parquet(inbox)
        run_arrivals(landing_stream(spark, inbox), silver, state, [ml_feature_writer(features)],
                     key_method="md5", buckets=BUCKETS).awaitTermination()
    return silver, features


def stream_silver(spark, sf):
    """L1, L4: the silver table after both deliveries."""
    silver, _ = _run_stream(spark, sf)
    return spark.read.parquet(silver).select(
        "id", "case_number", "primary_type", "crime_category", "community_area", "arrest",
        F.col("date").cast("timestamp_ntz").alias("date"), F.col("updated_on").cast("timestamp_ntz").alias("updated_on"),
        "process_date")


STREAM_SILVER = f"""SELECT event_id AS id, 'EV' || event_id AS case_number,
  CASE WHEN event_id % 2 = 0 THEN 'ARSON' ELSE {EVENT_KIND} END AS primary_type,
  CASE WHEN event_id % 2 = 0 THEN 'Property' ELSE CASE event_type WHEN 'click' THEN 'Property' WHEN 'error' THEN 'Violent'
    WHEN 'purchase' THEN 'Drug' WHEN 'signup' THEN 'Weapons' WHEN 'view' THEN 'Public order' END END AS crime_category,
  CAST(user_id % 77 + 1 AS VARCHAR) AS community_area, value > 50 AS arrest, date_trunc('second', ts) AS "date",
  CASE WHEN event_id % 2 = 0 THEN TIMESTAMP '2025-01-01' + to_seconds(event_id % 60)
    ELSE date_trunc('day', ts) + INTERVAL 23 HOUR END AS updated_on,
  CAST(ts AS DATE) AS process_date FROM events"""


def stream_features(spark, sf):
    """L3: what the follow-up writer left behind, counted per day, area and category."""
    _, features = _run_stream(spark, sf)
    return spark.read.parquet(features).groupBy("process_date", "community_area", "crime_category").agg(
        F.count(F.lit(1)).alias("incidents"))


STREAM_FEATURES = f"""SELECT process_date, CAST(community_area AS INTEGER) AS community_area, crime_category, count(*) AS incidents
FROM ({STREAM_SILVER}) GROUP BY 1, 2, 3"""

def _run_moved(spark, sf, follow_ups):
    """All events, then corrections that move every fourth incident to another day."""
    inbox, silver, out = (scratch_path(spark, n) for n in ("inbox", "stream-moved", "stream-follow-ups"))
    state = scratch_path(spark, "stream-moved-state")
    writers = [star_writer(f"{out}/star", "md5", BUCKETS), area_feature_writer(silver, f"{out}/area"),
               graph_writer(f"{out}/graph", "md5")] if follow_ups else []
    for delivery in (1, 3):
        inputs.event_landing(spark, sf, delivery).write.mode("append").parquet(inbox)
        run_arrivals(landing_stream(spark, inbox), silver, state, writers, key_method="md5", buckets=BUCKETS).awaitTermination()
    return silver, out


def stream_moved_day(spark, sf):
    """L4: an incident that a correction moves to another day is stored once, on that day."""
    silver, _ = _run_moved(spark, sf, False)
    return spark.read.parquet(silver).select("id", "process_date", F.col("date").cast("timestamp_ntz").alias("date"))


_MOVED = """SELECT event_id AS id, user_id % 77 + 1 AS area, CASE WHEN event_id % 4 = 1 THEN date_trunc('second', ts) + INTERVAL 1 DAY
  ELSE date_trunc('second', ts) END AS "date" FROM events"""
STREAM_MOVED_DAY = f"""SELECT id, CAST("date" AS DATE) AS process_date, "date" FROM ({_MOVED})"""


def stream_follow_ups(spark, sf):
    """L3: incidents per day in the tables of the writers, and fact rows whose dimension row is missing."""
    _, out = _run_moved(spark, sf, True)
    fact = spark.read.parquet(f"{out}/star/fact_incidents")
    place, day = spark.read.parquet(f"{out}/star/dim_location"), spark.read.parquet(f"{out}/star/dim_date")

    def rows(name, df, day_col, n):
        return df.groupBy(F.col(day_col).cast("date").alias("day")).agg(n.cast("long").alias("incidents")) \
            .select(F.lit(name).alias("part"), "day", "incidents")

    one = F.count(F.lit(1))
    graph = read_graph(spark, f"{out}/graph")
    on_day = graph["edges"].filter("type = 'OCCURRED_ON'")
    area = spark.read.parquet(f"{out}/area").filter("count_1d > 0")
    parts = [rows("fact", fact, "process_date", one), rows("area", area, "process_date", F.sum("count_1d")),
             rows("edge", on_day, "dst", one),
             rows("no place", fact.join(place, "location_key", "left_anti"), "process_date", one),
             rows("no date", fact.join(day, "date_key", "left_anti"), "process_date", one)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


STREAM_FOLLOW_UPS = f"""SELECT part, CAST("date" AS DATE) AS day, count(*) AS incidents
FROM ({_MOVED}) CROSS JOIN (VALUES ('fact'), ('area'), ('edge')) p(part) GROUP BY 1, 2"""

QUERIES = {
    "stream_moved_day": (stream_moved_day, STREAM_MOVED_DAY),
    "stream_follow_ups": (stream_follow_ups, STREAM_FOLLOW_UPS),
    "stream_due": (stream_due, STREAM_DUE),
    "stream_daily": (stream_daily, STREAM_DAILY),
    "stream_silver": (stream_silver, STREAM_SILVER),
    "stream_features": (stream_features, STREAM_FEATURES),
}
