"""Area-day features, horizon training sets, scoring arithmetic, evaluation and drift."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from tallyward.catalog import inputs
from tallyward.catalog.oracle_blocks import FIRST_DAY, LAST_DAY, with_silver
from tallyward.operators.features import COUNTS, area_daily_counts, area_features
from tallyward.operators.horizon import LABEL_COLUMN, expand_horizons, split_sizes, split_windows
from tallyward.operators.layout import stage
from tallyward.operators.monitoring import DRIFT_FEATURES, daily_moments, drift, drift_history, evaluate
from tallyward.operators.scoring import finish_predictions, scoring_frame

RUN_LAG = 30  # the run date lies this many days before the newest incident day
BATCH_DAYS = 40  # scored batches before the run date: covers the drift reference and the evaluation window


def run_date(spark, sf) -> date:
    return inputs.first_last_day(spark, sf)[1] - timedelta(days=RUN_LAG)


RUN = f"({LAST_DAY} - {RUN_LAG})"


def area_daily(spark, sf):
    return area_daily_counts(inputs.silver(spark, sf))


_FLAGGED = ", ".join(
    f"CAST(sum(CASE WHEN {test} THEN 1 ELSE 0 END) AS BIGINT) AS {name}" for name, test in (
        ("violent_count_1d", "violent_crime_flag = 1"), ("property_count_1d", "property_crime_flag = 1"),
        ("drug_count_1d", "drug_crime_flag = 1"), ("weapon_count_1d", "weapon_crime_flag = 1"),
        ("arrest_count_1d", "arrest"), ("domestic_count_1d", "domestic")))
DAILY_CTE = f"""daily AS (SELECT 'community_area' AS area_type, TRY_CAST(community_area AS INTEGER) AS area_id,
  CAST("date" AS DATE) AS event_date, count(*) AS count_1d, {_FLAGGED},
  CAST(strftime("date", '%Y%m%d') AS INTEGER) AS date_key FROM silver GROUP BY ALL)"""
AREA_DAILY = with_silver("SELECT * FROM daily", extra=[DAILY_CTE])

# Dense calendar of all areas and days, ROWS frames, then the days without an incident in the
# 16-day window dropped: the textbook form of what the engine computes without the dense grid.
_ROLL = ", ".join(f"sum({c}) OVER (PARTITION BY a ORDER BY d ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS {name}"
                  for name, c, n in (("c3", "count_1d", 3), ("c7", "count_1d", 7), ("c14", "count_1d", 14),
                                     ("v7", "violent_count_1d", 7), ("p7", "property_count_1d", 7),
                                     ("g7", "drug_count_1d", 7), ("w7", "weapon_count_1d", 7),
                                     ("ar7", "arrest_count_1d", 7), ("do7", "domestic_count_1d", 7)))
_NEXT = ", ".join(f"lead({c}) OVER (PARTITION BY a ORDER BY d) AS n_{c}" for c in COUNTS[:5])
FEATURE_CTES = [
    DAILY_CTE,
    f"""dense AS (SELECT a.area_id AS a, CAST(c.d AS DATE) AS d, (p.event_date IS NOT NULL) AS present,
  {", ".join(f"coalesce(m.{c}, 0) AS {c}" for c in COUNTS)}
  FROM (SELECT DISTINCT area_id FROM daily) a
  CROSS JOIN (SELECT unnest(generate_series({FIRST_DAY} - 14, {LAST_DAY} + 1, INTERVAL 1 DAY)) AS d) c
  LEFT JOIN daily m ON m.area_id = a.area_id AND m.event_date = CAST(c.d AS DATE)
  LEFT JOIN daily p ON p.area_id IS NOT DISTINCT FROM a.area_id AND p.event_date = CAST(c.d AS DATE))""",
    f"""rolled AS (SELECT *, {_ROLL}, {_NEXT},
  sum(CAST(present AS INTEGER)) OVER (PARTITION BY a ORDER BY d ROWS BETWEEN 14 PRECEDING AND 1 FOLLOWING) AS alive FROM dense)""",
    f"""features AS (SELECT 'community_area' AS area_type, a AS area_id, d AS "date",
  CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_key,
  {", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in COUNTS)},
  CAST(c3 AS INTEGER) AS count_3d, CAST(c7 AS INTEGER) AS count_7d, CAST(c14 AS INTEGER) AS count_14d,
  CAST(v7 AS INTEGER) AS violent_count_7d, CAST(p7 AS INTEGER) AS property_count_7d,
  CAST(g7 AS INTEGER) AS drug_count_7d, CAST(w7 AS INTEGER) AS weapon_count_7d,
  CASE WHEN c7 > 0 THEN CAST(ar7 AS DOUBLE) / CAST(c7 AS DOUBLE) ELSE 0.0::DOUBLE END AS arrest_rate_7d,
  CASE WHEN c7 > 0 THEN CAST(do7 AS DOUBLE) / CAST(c7 AS DOUBLE) ELSE 0.0::DOUBLE END AS domestic_rate_7d,
  CAST(dayofweek(d) + 1 AS INTEGER) AS day_of_week, CASE WHEN dayofweek(d) IN (0, 6) THEN 1 ELSE 0 END AS is_weekend,
  CAST(month(d) AS INTEGER) AS "month",
  CASE WHEN month(d) IN (12, 1, 2) THEN 1 WHEN month(d) <= 5 THEN 2 WHEN month(d) <= 8 THEN 3 ELSE 4 END AS season,
  {", ".join(f"CAST(coalesce(n_{c}, 0) AS INTEGER) AS {lab}" for c, lab in zip(COUNTS[:5], (
      "label_next_day_count", "label_next_day_violent_count", "label_next_day_property_count",
      "label_next_day_drug_count", "label_next_day_weapon_count")))},
  d AS feature_as_of_date, d AS process_date
  FROM rolled WHERE alive > 0 AND d BETWEEN {FIRST_DAY} AND {LAST_DAY})""",
]


def with_features(body: str, extra: list[str] | None = None) -> str:
    return with_silver(body, extra=[*FEATURE_CTES, *(extra or [])])


def all_features(spark, sf):
    first, last = inputs.first_last_day(spark, sf)
    return area_features(inputs.silver(spark, sf), first, last)


def area_features_day(spark, sf):
    """The daily run: one process date, its 16-day window read by a range on the incident time."""
    return area_features(inputs.silver(spark, sf), run_date(spark, sf))


def horizon_expand(spark, sf):
    """C9, C10 over the whole history, summed per event date and horizon."""
    first, last = inputs.first_last_day(spark, sf)
    rows = expand_horizons(all_features(spark, sf), first, last)
    return rows.groupBy("event_date", "horizon").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum(LABEL_COLUMN).alias("label_sum"),
        F.sum("count_7d").alias("count_7d_sum"), F.max("area_id").alias("max_area"))


_EXPANDED = """expanded AS (SELECT f."date" AS event_date, h.h AS horizon, f.area_id, f.count_7d, l.count_1d AS label
  FROM features f CROSS JOIN range(1, 11) h(h)
  JOIN features l ON l.area_type = f.area_type AND l.area_id = f.area_id AND l."date" = f."date" + CAST(h.h AS INTEGER))"""
HORIZON_EXPAND = with_features("""SELECT event_date, CAST(horizon AS INTEGER) AS horizon, count(*) AS row_count,
  CAST(sum(label) AS BIGINT) AS label_sum, CAST(sum(count_7d) AS BIGINT) AS count_7d_sum, max(area_id) AS max_area
FROM expanded GROUP BY 1, 2""", [_EXPANDED])


def split_counts(spark, sf):
    """Sizes of the three training windows of the run date."""
    windows = split_windows(run_date(spark, sf))
    return split_sizes(expand_horizons(all_features(spark, sf), windows["train"][0], windows["test"][1]), windows)


SPLIT_COUNTS = with_features(f"""SELECT s.split, count(e.event_date) AS row_count FROM (VALUES ('train', 392, 92), ('val', 91, 61),
  ('test', 60, 30)) s(split, a, b) LEFT JOIN expanded e ON e.event_date BETWEEN {RUN} - s.a AND {RUN} - s.b GROUP BY 1""",
                             [_EXPANDED])

# A linear stand-in for a model, so that scoring arithmetic can be compared across engines.
STAND_INS = {
    "1": "count_7d * 0.1D + count_14d * 0.02D + is_weekend * 0.05D + horizon * 0.01D",
    "2": "count_7d * 0.12D + count_1d * 0.03D + violent_count_7d * 0.01D",
}


def stand_in_predictions(features, version: str = "1", process_date: date | None = None):
    frame = scoring_frame(features, process_date).withColumn("prediction", F.expr(STAND_INS[version]))
    return finish_predictions(frame, f"run-{version}", "area_risk", version)


def _recent_features(spark, sf):
    """Stored features of the last batches; scoring and monitoring read them several times."""
    run = run_date(spark, sf)
    return stage(area_features(inputs.silver(spark, sf), run - timedelta(days=BATCH_DAYS), run), "features")


def recent_predictions(features):
    """Both stand-in models over the given batches."""
    return stand_in_predictions(features, "1").unionByName(stand_in_predictions(features, "2"))


def score_batch(spark, sf):
    return recent_predictions(_recent_features(spark, sf)).drop("created_at")


def score_history(spark, sf):
    """Every batch of the whole history scored by both models, reported per model and batch."""
    first, last = inputs.first_last_day(spark, sf)
    features = stage(area_features(inputs.silver(spark, sf), first, last), "features")
    return recent_predictions(features).groupBy("model_version", "process_date").agg(
        F.count(F.lit(1)).alias("predictions"), F.round(F.sum("predicted_count"), 3).alias("predicted"),
        F.round(F.sum("predicted_count_high"), 3).alias("predicted_high"), F.round(F.sum("safety_score"), 3).alias("safety"),
        F.max("target_date").alias("last_target"))


def _prediction_sql(version: str, where: str = "") -> str:
    formula = STAND_INS[version].replace("D", "::DOUBLE")
    return f"""pred_{version} AS (SELECT 'run-{version}' AS run_id, 'area_risk' AS model_name, '{version}' AS model_version,
  prediction_date, prediction_date + 1 AS target_date, 'total_count' AS prediction_target, area_type, area_id,
  predicted_count, process_date FROM (SELECT *, {formula} AS predicted_count FROM (
    SELECT f.area_type, f.area_id, f.process_date, f.count_1d, f.count_7d, f.count_14d, f.violent_count_7d,
      f.process_date + CAST(h.h AS INTEGER) AS prediction_date, h.h AS horizon,
      CASE WHEN dayofweek(f.process_date + CAST(h.h AS INTEGER)) IN (0, 6) THEN 1 ELSE 0 END AS is_weekend
    FROM features f CROSS JOIN range(0, 11) h(h) {where})))"""


def prediction_ctes(where: str) -> list[str]:
    return [
        _prediction_sql("1", where), _prediction_sql("2", where),
        *[f"""scored_{v} AS (SELECT p.*, round(greatest(0.0::DOUBLE, predicted_count - 1.65::DOUBLE * sqrt(predicted_count)), 1) AS predicted_count_low,
      round(predicted_count + 1.65::DOUBLE * sqrt(predicted_count), 1) AS predicted_count_high,
      round(100.0::DOUBLE * (1.0::DOUBLE - least(predicted_count / q.p99, 1.0::DOUBLE)), 2) AS safety_score
      FROM pred_{v} p JOIN (SELECT process_date, CASE WHEN quantile_disc(predicted_count, 0.99) > 0
        THEN quantile_disc(predicted_count, 0.99) ELSE 1.0 END AS p99 FROM pred_{v} GROUP BY 1) q USING (process_date))"""
          for v in ("1", "2")],
        "predictions AS (SELECT * FROM scored_1 UNION ALL SELECT * FROM scored_2)",
    ]


PREDICTION_CTES = prediction_ctes(f"WHERE f.process_date BETWEEN {RUN} - {BATCH_DAYS} AND {RUN}")


def with_predictions(body: str, extra: list[str] | None = None) -> str:
    return with_features(body, [*PREDICTION_CTES, *(extra or [])])


SCORE_BATCH = with_predictions("SELECT * FROM predictions")
SCORE_HISTORY = with_features("""SELECT model_version, process_date, count(*) AS predictions,
  round(sum(predicted_count), 3) AS predicted, round(sum(predicted_count_high), 3) AS predicted_high,
  round(sum(safety_score), 3) AS safety, max(target_date) AS last_target FROM predictions GROUP BY 1, 2""", prediction_ctes(""))


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def evaluate_window(spark, sf, per_model=False):
    run = run_date(spark, sf)
    features = _recent_features(spark, sf)
    rows = evaluate(stage(recent_predictions(features), "predictions"), features, run - timedelta(days=7),
                    run - timedelta(days=1), run, per_model=per_model)
    return _rounded(rows.drop("created_at"), "rmse", "mae", "r2")


def evaluate_per_model(spark, sf):
    return evaluate_window(spark, sf, per_model=True)


_PAIRS = f"""pairs AS (SELECT p.model_name, p.model_version, p.predicted_count AS p, CAST(f.count_1d AS DOUBLE) AS y
  FROM predictions p JOIN features f ON p.area_type = f.area_type AND p.area_id = f.area_id AND p.target_date = f."date"
  WHERE p.target_date BETWEEN {RUN} - 7 AND {RUN} - 1)"""
_METRICS = """round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(avg(abs(y - p)), 6) AS mae,
  round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2, count(*) AS row_count"""
_STAMP = f"{RUN} - 7 AS eval_window_start, {RUN} - 1 AS eval_window_end, {RUN} AS process_date"
EVALUATE = with_predictions(f"""SELECT m.*, g.*, {_STAMP} FROM (SELECT DISTINCT model_name, model_version FROM pairs) m
  CROSS JOIN (SELECT {_METRICS} FROM pairs) g""", [_PAIRS])
EVALUATE_PER_MODEL = with_predictions(f"""SELECT model_name, model_version, {_METRICS}, {_STAMP} FROM pairs GROUP BY 1, 2""",
                                      [_PAIRS])


def predicted_counts(features):
    """What drift reads of both stand-in models' predictions: day and count, without intervals and scores."""
    frame = scoring_frame(features)
    parts = [frame.select(F.col("event_date").alias("prediction_date"), F.expr(e).cast("double").alias("predicted_count"))
             for e in STAND_INS.values()]
    return parts[0].unionByName(parts[1])


def drift_days(spark, sf):
    """D10, D11 for every day of the whole history, from day states of features and predictions."""
    first, last = inputs.first_last_day(spark, sf)
    features = stage(area_features(inputs.silver(spark, sf), first, last), "features")
    states = stage(daily_moments(features, "date", DRIFT_FEATURES), "moments")
    predicted = stage(daily_moments(predicted_counts(features), "prediction_date", ["predicted_count"]), "moments")
    rows = drift_history(states, predicted).drop("created_at")
    # means of short decimals lie on half a digit at times: both engines are moved off it
    return rows.withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in ("ref_mean", "ref_std", "cur_mean", "drift_score")})


def _drift_days_sql() -> str:
    def states(column: str, source: str, day: str) -> str:
        v = f"CAST({column} AS DOUBLE)"
        return f"""SELECT '{column.strip('"')}' AS field_name, {day} AS d, count({v}) AS n, sum({v}) AS s, sum({v} * {v}) AS q FROM {source} GROUP BY 2"""

    fields = [*DRIFT_FEATURES[:9], '"month"', *DRIFT_FEATURES[10:]]
    return with_features(f"""SELECT metric_name, field_name, d - 30 AS ref_start, d - 1 AS ref_end, d AS eval_date,
  round(rm + 1e-9, 6) AS ref_mean, round(rs + 1e-9, 6) AS ref_std, round(cm + 1e-9, 6) AS cur_mean,
  round(abs(cm - rm) / (rs + 1e-9) + 1e-9, 6) AS drift_score, d + 1 AS process_date
FROM (SELECT c.field_name, c.d, c.s / c.n AS cm, coalesce(sum(r.s) / sum(r.n), 'nan'::DOUBLE) AS rm,
    CASE WHEN sum(r.n) > 0 THEN sqrt(greatest(sum(r.q) / sum(r.n) - (sum(r.s) / sum(r.n)) ** 2, 0)) ELSE 'nan'::DOUBLE END AS rs,
    sum(r.n) AS rn,
    CASE WHEN c.field_name = 'predicted_count' THEN 'prediction_mean_z' ELSE 'feature_mean_z' END AS metric_name
  FROM states c LEFT JOIN states r ON r.field_name = c.field_name AND r.d BETWEEN c.d - 30 AND c.d - 1 GROUP BY c.field_name, c.d, c.s, c.n)
WHERE metric_name = 'feature_mean_z' OR (rn > 0 AND d IN (SELECT d FROM states WHERE field_name = 'count_1d'))""", [
        *prediction_ctes("")[:2],
        "states AS (" + "\nUNION ALL ".join([
            *[states(c, "features", '"date"') for c in fields],
            states("predicted_count", "(SELECT * FROM pred_1 UNION ALL SELECT * FROM pred_2)", "prediction_date")]) + ")"])


def drift_metrics(spark, sf):
    run = run_date(spark, sf)
    features = _recent_features(spark, sf)
    rows = drift(features, predicted_counts(features), run - timedelta(days=1), run)
    return _rounded(rows.drop("created_at"), "ref_mean", "ref_std", "cur_mean", "drift_score")


def _drift_sql(metric: str, column: str, source: str, day: str) -> str:
    ref = f"{day} BETWEEN {RUN} - 31 AND {RUN} - 2"
    return f"""SELECT '{metric}' AS metric_name, '{column}' AS field_name, {RUN} - 31 AS ref_start, {RUN} - 2 AS ref_end,
  {RUN} - 1 AS eval_date, round(rm, 6) AS ref_mean, round(rs, 6) AS ref_std, round(cm, 6) AS cur_mean,
  round(abs(cm - rm) / (rs + 1e-9), 6) AS drift_score, {RUN} AS process_date
FROM (SELECT avg({column}) FILTER ({ref}) AS rm, stddev_pop({column}) FILTER ({ref}) AS rs,
  avg({column}) FILTER ({day} = {RUN} - 1) AS cm FROM {source})"""


DRIFT = with_predictions("\nUNION ALL ".join([
    *[_drift_sql("feature_mean_z", c, "features", '"date"') for c in (
        "count_1d", "count_3d", "count_7d", "count_14d", "violent_count_7d", "arrest_rate_7d", "domestic_rate_7d",
        "day_of_week", "is_weekend", '"month"', "season")],
    _drift_sql("prediction_mean_z", "predicted_count", "predictions", "prediction_date"),
])).replace("'\"month\"'", "'month'")

QUERIES = {
    "area_daily": (area_daily, AREA_DAILY),
    "area_features_day": (area_features_day, with_features(f'SELECT * FROM features WHERE "date" = {RUN}')),
    "area_features_backfill": (all_features, with_features("SELECT * FROM features")),
    "horizon_expand": (horizon_expand, HORIZON_EXPAND),
    "split_sizes": (split_counts, SPLIT_COUNTS),
    "score_batch": (score_batch, SCORE_BATCH),
    "score_history": (score_history, SCORE_HISTORY),
    "evaluate": (evaluate_window, EVALUATE),
    "evaluate_per_model": (evaluate_per_model, EVALUATE_PER_MODEL),
    "drift": (drift_metrics, DRIFT),
    "drift_days": (drift_days, _drift_days_sql()),
}
