"""Serving snapshot and its read queries."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from tallyward.catalog import inputs
from tallyward.catalog.area_queries import RUN, prediction_ctes, run_date, stand_in_predictions, with_features
from tallyward.catalog.oracle_blocks import with_silver
from tallyward.operators import serving
from tallyward.operators.features import area_features
from tallyward.operators.layout import stage
from tallyward.session import scratch_path
from tallyward.sources.tables import replace_slices


def ml_features(silver):
    """Incident-level rows the snapshot counts categories from."""
    return silver.select(
        F.to_date("process_date").alias("process_date"), F.col("community_area").try_cast("int").alias("community_area"),
        "crime_category")


def names(spark, sf):
    """An area name table whose columns have to be found."""
    return inputs.table(spark, sf, "nation").select(
        (F.col("n_nationkey") + 1).cast("string").alias("area_numbe"), F.col("n_name").alias("community"))


def _stored(spark, sf):
    """What features and snapshots read of silver, as a stored table."""
    return stage(inputs.silver(spark, sf).select(
        "date", "process_date", "community_area", "crime_category", "arrest", "domestic", "violent_crime_flag",
        "property_crime_flag", "drug_crime_flag", "weapon_crime_flag"), "silver")


def snapshot_rows(spark, sf):
    """The snapshot of every batch of the whole history."""
    first, last = inputs.first_last_day(spark, sf)
    silver = _stored(spark, sf)
    features = stage(area_features(silver, first, last), "features")
    return serving.build_snapshots(stand_in_predictions(features), ml_features(silver), features, names(spark, sf))


def snapshot_table(spark, sf):
    """The same, stored by batch as it is served."""
    path = scratch_path(spark, "snapshot")
    replace_slices(snapshot_rows(spark, sf), path, ["process_date"])
    return spark.read.parquet(path)


def snapshot(spark, sf):
    """All snapshot rows, reported per batch and area: the day-independent columns, and what the predicted days sum up to."""
    return snapshot_rows(spark, sf).groupBy(
        "process_date", "area_type", "area_id", "area_name", "top_crime_1", "top_crime_2", "top_crime_3", "count_7d",
        "violent_count_7d", "model_name", "model_version", "run_id").agg(
        F.count(F.lit(1)).alias("predicted_days"), F.min("prediction_date").alias("first_prediction"),
        F.max("target_date").alias("last_target"), F.round(F.sum("predicted_count"), 3).alias("predicted_count"),
        F.round(F.sum("predicted_count_low"), 3).alias("predicted_count_low"),
        F.round(F.sum("predicted_count_high"), 3).alias("predicted_count_high"),
        F.round(F.sum("safety_score"), 3).alias("safety_score"))


SNAPSHOT_CTES = [
    """daily_categories AS (SELECT CAST(process_date AS DATE) AS d, TRY_CAST(community_area AS INTEGER) AS area_id, crime_category,
  count(*) AS n FROM silver WHERE TRY_CAST(community_area AS INTEGER) > 0 GROUP BY 1, 2, 3)""",
    """counted AS (SELECT d + CAST(k AS INTEGER) AS pd, area_id, crime_category, sum(n) AS cnt
  FROM daily_categories, range(0, 91) r(k) GROUP BY 1, 2, 3)""",
    """ranked AS (SELECT *, row_number() OVER (PARTITION BY pd, area_id ORDER BY cnt DESC, crime_category NULLS LAST) AS rn FROM counted)""",
    """tops AS (SELECT pd, area_id, max(CASE WHEN rn = 1 THEN crime_category END) AS top_crime_1,
  max(CASE WHEN rn = 2 THEN crime_category END) AS top_crime_2, max(CASE WHEN rn = 3 THEN crime_category END) AS top_crime_3
  FROM ranked WHERE rn <= 3 GROUP BY 1, 2)""",
    """snapshot AS (SELECT p.area_type, p.area_id, n.n_name AS area_name, p.predicted_count, p.predicted_count_low,
  p.predicted_count_high, p.safety_score, t.top_crime_1, t.top_crime_2, t.top_crime_3, f.count_7d, f.violent_count_7d,
  p.prediction_date, p.target_date, p.process_date, p.model_name, p.model_version, p.run_id
  FROM scored_1 p LEFT JOIN tops t ON t.pd = p.process_date AND t.area_id = p.area_id
  LEFT JOIN features f ON f.process_date = p.process_date AND f.area_id = p.area_id
  LEFT JOIN nation n ON n.n_nationkey + 1 = p.area_id)""",
]


def with_snapshot(body: str, extra: list[str] | None = None) -> str:
    return with_features(body, [*prediction_ctes(""), *SNAPSHOT_CTES, *(extra or [])])


SNAPSHOT = with_snapshot("""SELECT process_date, area_type, area_id, area_name, top_crime_1, top_crime_2, top_crime_3, count_7d,
  violent_count_7d, model_name, model_version, run_id, count(*) AS predicted_days, min(prediction_date) AS first_prediction,
  max(target_date) AS last_target, round(sum(predicted_count), 3) AS predicted_count,
  round(sum(predicted_count_low), 3) AS predicted_count_low, round(sum(predicted_count_high), 3) AS predicted_count_high,
  round(sum(safety_score), 3) AS safety_score FROM snapshot GROUP BY ALL""")


def snapshot_defaults(spark, sf):
    """The batch of the run date with predictions that lack bounds and scores for some areas."""
    run = run_date(spark, sf)
    silver = _stored(spark, sf)
    features = stage(area_features(silver, run), "features")
    lacks = lambda k, c: F.when(F.col("area_id") % 3 != k, F.col(c)).alias(c)
    odd = {"predicted_count_low": 0, "predicted_count_high": 1, "safety_score": 2}
    predictions = stand_in_predictions(features)
    predictions = predictions.select(*[lacks(odd[c], c) if c in odd else F.col(c) for c in predictions.columns])
    return serving.build_snapshot(predictions, ml_features(silver), features, run, names(spark, sf)).drop(
        "source_prediction_ts")


SNAPSHOT_DEFAULTS = with_snapshot(f"""SELECT * REPLACE (
  CASE WHEN area_id % 3 <> 0 THEN predicted_count_low ELSE 0 END AS predicted_count_low,
  CASE WHEN area_id % 3 <> 1 THEN predicted_count_high ELSE predicted_count END AS predicted_count_high,
  CASE WHEN area_id % 3 <> 2 THEN safety_score ELSE 0 END AS safety_score) FROM snapshot WHERE process_date = {RUN}""")


def top3_categories(spark, sf):
    """D6, D7, E7 over the whole history."""
    first, last = inputs.first_last_day(spark, sf)
    return serving.top_categories(ml_features(inputs.silver(spark, sf)), first, last)


TOP3 = with_silver("""SELECT area_id, max(CASE WHEN rn = 1 THEN c END) AS top_crime_1, max(CASE WHEN rn = 2 THEN c END) AS top_crime_2,
  max(CASE WHEN rn = 3 THEN c END) AS top_crime_3 FROM (
  SELECT area_id, c, row_number() OVER (PARTITION BY area_id ORDER BY n DESC, c) AS rn FROM (
    SELECT TRY_CAST(community_area AS INTEGER) AS area_id, crime_category AS c, count(*) AS n FROM silver
    WHERE TRY_CAST(community_area AS INTEGER) > 0 GROUP BY 1, 2)) WHERE rn <= 3 GROUP BY 1""")


def _flat(areas):
    """Category lists as text, so that both engines print them alike."""
    text = F.array_join(F.transform("top_categories", lambda x: F.concat(x["rank"].cast("string"), F.lit(":"), x["label"])), "|")
    return areas.withColumn("top_categories", text)


def _fallback(spark, sf):
    """Names for areas the snapshot could not name."""
    return inputs.table(spark, sf, "supplier").filter(F.col("s_suppkey") > 0).select(
        F.col("s_suppkey").cast("int").alias("area_id"), F.col("s_name").alias("area_name"))


def areas_latest(spark, sf):
    return _flat(serving.list_areas(snapshot_table(spark, sf), names=_fallback(spark, sf)))


def areas_on_date(spark, sf):
    run = run_date(spark, sf)
    older = run - timedelta(days=1)
    return _flat(serving.list_areas(snapshot_table(spark, sf), older, older + timedelta(days=4)))


def _areas_sql(rows: str, name: str, join: str = "") -> str:
    tops = " || ".join(f"CASE WHEN s.top_crime_{k} IS NULL THEN '' ELSE '|{k}:' || s.top_crime_{k} END" for k in (1, 2, 3))
    return with_snapshot(f"""SELECT s.area_id, {name} AS name, s.safety_score,
  CASE WHEN s.safety_score >= 70 THEN 'high' WHEN s.safety_score >= 40 THEN 'medium' ELSE 'low' END AS safety_band,
  s.predicted_count, ltrim({tops}, '|') AS top_categories, s.predicted_count_low, s.predicted_count_high,
  s.prediction_date, s.target_date, s.process_date, s.model_name, s.model_version FROM {rows} {join}""")


AREAS_LATEST = _areas_sql(
    """(SELECT s.* FROM snapshot s JOIN (SELECT area_id, max(prediction_date) AS pd FROM snapshot
    WHERE process_date = (SELECT max(process_date) FROM snapshot) GROUP BY 1) l ON s.area_id = l.area_id AND s.prediction_date = l.pd
    WHERE s.process_date = (SELECT max(process_date) FROM snapshot)) s""",
    "coalesce(nullif(s.area_name, ''), r.s_name)", "LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey > 0) r ON r.s_suppkey = s.area_id")
AREAS_ON_DATE = _areas_sql(f"""(SELECT * FROM snapshot WHERE process_date = {RUN} - 1 AND prediction_date = {RUN} + 3) s""",
                           "nullif(s.area_name, '')")


def city_summary(spark, sf):
    return serving.city_summary(snapshot_table(spark, sf)).withColumn("average_safety", F.round("average_safety", 6))


_CITY = """SELECT s.process_date, avg(safety_score) AS a, count(*) AS n FROM snapshot s
  JOIN (SELECT process_date, area_id, max(prediction_date) AS pd FROM snapshot GROUP BY 1, 2) l
  ON s.process_date = l.process_date AND s.area_id = l.area_id AND s.prediction_date = l.pd GROUP BY 1"""
CITY_SUMMARY = with_snapshot(f"""SELECT process_date, round(a, 6) AS average_safety, n AS total_areas FROM ({_CITY})
  ORDER BY process_date DESC LIMIT 1""")


def city_compare(spark, sf):
    rows = serving.city_compare(snapshot_table(spark, sf), strict=False)
    return rows.withColumns({c: F.round(c, 6) for c in (
        "average_safety_current", "average_safety_previous", "delta_average_safety")})


CITY_COMPARE = with_snapshot(f"""SELECT c.process_date AS process_date_current, p.process_date AS process_date_previous,
  round(c.a, 6) AS average_safety_current, round(p.a, 6) AS average_safety_previous, round(c.a - p.a, 6) AS delta_average_safety,
  CASE WHEN c.a - p.a > 1e-6 THEN 'up' WHEN c.a - p.a < -1e-6 THEN 'down' ELSE 'flat' END AS direction,
  c.n AS total_areas_current, p.n AS total_areas_previous
FROM city c JOIN city p ON p.process_date = (SELECT max(process_date) FROM city WHERE process_date < c.process_date)
WHERE c.process_date = (SELECT max(process_date) FROM city)""", [f"city AS ({_CITY})"])


def recent_batches(spark, sf):
    """the two newest distinct incident days, each with its incident count."""
    silver = inputs.silver(spark, sf)
    newest = serving.recent_batches(silver.select(F.to_date("process_date").alias("process_date")))
    counts = silver.groupBy(F.to_date("process_date").alias("process_date")).agg(F.count(F.lit(1)).alias("incidents"))
    return counts.join(newest, "process_date")


RECENT_BATCHES = with_silver("""SELECT CAST(process_date AS DATE) AS process_date, count(*) AS incidents FROM silver
GROUP BY 1 ORDER BY 1 DESC LIMIT 2""")

QUERIES = {
    "top3_categories": (top3_categories, TOP3),
    "snapshot": (snapshot, SNAPSHOT),
    "snapshot_defaults": (snapshot_defaults, SNAPSHOT_DEFAULTS),
    "areas_latest": (areas_latest, AREAS_LATEST),
    "areas_on_date": (areas_on_date, AREAS_ON_DATE),
    "city_summary": (city_summary, CITY_SUMMARY),
    "city_compare": (city_compare, CITY_COMPARE),
    "recent_batches": (recent_batches, RECENT_BATCHES),
}
