"""Evaluation and drift."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyward.operators.training import regression_metrics
from tallyward.schema import DRIFT_DDL, EVALUATION_DDL, enforce

# Accepted target names per actual column, monitored features, guard against zero spread.
TARGET_ALIASES = {
    "count_1d": ["total", "total_count", "count_1d"],
    "violent_count_1d": ["violent", "violent_count", "violent_count_1d"],
    "property_count_1d": ["property", "property_count", "property_count_1d"],
    "drug_count_1d": ["drug", "drug_count", "drug_count_1d"],
    "weapon_count_1d": ["weapon", "weapon_count", "weapon_count_1d"],
}
DRIFT_FEATURES = ["count_1d", "count_3d", "count_7d", "count_14d", "violent_count_7d", "arrest_rate_7d",
                  "domestic_rate_7d", "day_of_week", "is_weekend", "month", "season"]
SPREAD_EPS = 1e-9
REFERENCE_DAYS = 30


def actual_column(target: str) -> str:
    """The observed column behind a target name."""
    for column, names in TARGET_ALIASES.items():
        if target in names:
            return column
    raise ValueError(f"unsupported prediction target {target!r}")


def pair_with_actuals(predictions: DataFrame, features: DataFrame, start: date, end: date,
                      target: str = "total_count") -> DataFrame:
    """Predictions whose target date lies in the window, with the observed count.

    Predictions without a ``prediction_target`` column predate targets and count as totals.
    """
    preds = predictions.filter(F.to_date("target_date").between(F.lit(start), F.lit(end)))
    if "prediction_target" in preds.columns:
        preds = preds.filter(F.col("prediction_target") == target)
        column = actual_column(target)
    else:
        column = "count_1d"
    observed = features.select(
        "area_type", F.col("area_id").cast("int").alias("area_id"), F.to_date("date").alias("target_date"),
        F.col(column).cast("double").alias("actual_count"),
    ).filter(F.col("target_date").between(F.lit(start), F.lit(end)) & F.col("actual_count").isNotNull())
    chosen = preds.select(
        "run_id", "model_name", "model_version", F.to_date("target_date").alias("target_date"), "area_type",
        F.col("area_id").cast("int").alias("area_id"),
        F.col("predicted_count").cast("double").alias("predicted_count"),
    )
    return chosen.join(observed, ["area_type", "area_id", "target_date"], "inner")


def evaluate(predictions: DataFrame | None, features: DataFrame, start: date, end: date, process_date: date,
             target: str = "total_count", per_model: bool = False) -> DataFrame | None:
    """One row per (model, version).

    By default all rows carry the metrics over every model together; ``per_model=True`` measures
    each on its own. None when there is no predictions table yet (A25).
    """
    if predictions is None:
        return None
    pairs = pair_with_actuals(predictions, features, start, end, target)
    measures = regression_metrics(F.col("actual_count"), F.col("predicted_count"))
    columns = [*[c.alias(n) for n, c in measures.items()], F.count(F.lit(1)).alias("row_count")]
    keys = ["model_name", "model_version"]
    if per_model:
        rows = pairs.groupBy(*keys).agg(*columns)
    else:
        overall = pairs.agg(*columns).select(F.struct("rmse", "mae", "r2", "row_count").alias("m"))
        rows = pairs.select(*keys).distinct().withColumn("_m", overall.scalar()).select(*keys, "_m.*")
    return enforce(rows.withColumns({
        "eval_window_start": F.lit(start), "eval_window_end": F.lit(end), "process_date": F.lit(process_date),
        "created_at": F.current_timestamp(),
    }), EVALUATION_DDL)


def mean_shift(df: DataFrame, day_col: str, columns: Sequence[str], eval_date: date, reference_days: int,
               metric_name: str) -> DataFrame:
    """Per column |mean_current - mean_reference| / (std_reference + eps), in one pass.

    The reference is the preceding ``reference_days`` days; an empty side gives NaN.
    """
    ref_start, ref_end = eval_date - timedelta(days=reference_days), eval_date - timedelta(days=1)
    day = F.to_date(day_col)
    in_ref, in_cur = day.between(F.lit(ref_start), F.lit(ref_end)), day == F.lit(eval_date)
    nan = F.lit(float("nan"))

    def stats(c: str) -> Column:
        value = F.col(c).cast("double")
        return F.struct(
            F.lit(c).alias("field_name"),
            F.coalesce(F.avg(F.when(in_ref, value)), nan).alias("ref_mean"),
            F.coalesce(F.stddev_pop(F.when(in_ref, value)), nan).alias("ref_std"),
            F.coalesce(F.avg(F.when(in_cur, value)), nan).alias("cur_mean"),
        )

    one = (df.filter(day.between(F.lit(ref_start), F.lit(eval_date)))
           .agg(F.array(*[stats(c) for c in columns]).alias("s"),
                F.count(F.when(in_ref, 1)).alias("_n_ref"), F.count(F.when(in_cur, 1)).alias("_n_cur")))
    rows = one.select(F.explode("s").alias("s"), "_n_ref", "_n_cur").select("s.*", "_n_ref", "_n_cur")
    score = F.when(F.isnan("ref_std"), nan).otherwise(
        F.abs(F.col("cur_mean") - F.col("ref_mean")) / (F.col("ref_std") + SPREAD_EPS))
    return rows.withColumns({
        "metric_name": F.lit(metric_name), "ref_start": F.lit(ref_start), "ref_end": F.lit(ref_end),
        "eval_date": F.lit(eval_date), "drift_score": score,
    })


def drift(features: DataFrame, predictions: DataFrame | None, eval_date: date, process_date: date,
          reference_days: int = REFERENCE_DAYS, columns: Sequence[str] = tuple(DRIFT_FEATURES),
          target: str = "total_count") -> DataFrame:
    """Feature drift rows, plus one prediction drift row when both windows have rows."""
    out = mean_shift(features, "date", columns, eval_date, reference_days, "feature_mean_z")
    if predictions is not None:
        preds = predictions
        if "prediction_target" in preds.columns and target and target != "total_count":
            preds = preds.filter(F.col("prediction_target") == target)
        shift = mean_shift(preds, "prediction_date", ["predicted_count"], eval_date, reference_days,
                           "prediction_mean_z")
        out = out.unionByName(shift.filter((F.col("_n_ref") > 0) & (F.col("_n_cur") > 0)))
    return enforce(out.withColumns({
        "process_date": F.lit(process_date), "created_at": F.current_timestamp(),
    }), DRIFT_DDL)


def daily_moments(df: DataFrame, day_col: str, columns: Sequence[str]) -> DataFrame:
    """Mergeable state per day and column: day, field_name, row_count, n (not null), total, squares.

    Stored by day, it lets any window be read as a sum of day states, without the rows behind them; states of one day
    from several loads add up (``merged_moments``).
    """
    def state(c: str) -> Column:
        value = F.col(c).cast("double")
        return F.struct(F.lit(c).alias("field_name"), F.count(value).alias("n"), F.coalesce(F.sum(value), F.lit(0.0)).alias("total"),
                        F.coalesce(F.sum(value * value), F.lit(0.0)).alias("squares"))

    days = df.groupBy(F.to_date(day_col).alias("day")).agg(
        F.count(F.lit(1)).alias("row_count"), F.array(*[state(c) for c in columns]).alias("s"))
    return days.filter("day is not null").select("day", F.explode("s").alias("s"), "row_count").select("day", "s.field_name", "row_count", "s.n",
                                                                              "s.total", "s.squares")


def merged_moments(moments: DataFrame) -> DataFrame:
    return moments.groupBy("day", "field_name").agg(*[F.sum(c).alias(c) for c in ("row_count", "n", "total", "squares")])


def shifts_of_days(moments: DataFrame, metric_name: str, reference_days: int = REFERENCE_DAYS) -> DataFrame:
    """``mean_shift`` for every day of ``moments`` in one plan; the reference of a day is a RANGE frame over day states."""
    frame = W.partitionBy("field_name").orderBy(F.datediff("day", F.lit(date(1970, 1, 1)))).rangeBetween(-reference_days, -1)
    sums = moments.withColumns({f"_{c}": F.sum(c).over(frame) for c in ("row_count", "n", "total", "squares")})
    nan = F.lit(float("nan"))
    mean = F.when(F.col("_n") > 0, F.col("_total") / F.col("_n")).otherwise(nan)
    spread = F.greatest(F.col("_squares") / F.col("_n") - F.col("ref_mean") * F.col("ref_mean"), F.lit(0.0))
    rows = sums.withColumn("ref_mean", mean).withColumns({
        "ref_std": F.when(F.col("_n") > 0, F.sqrt(spread)).otherwise(nan),
        "cur_mean": F.when(F.col("n") > 0, F.col("total") / F.col("n")).otherwise(nan)})
    score = F.when(F.isnan("ref_std"), nan).otherwise(
        F.abs(F.col("cur_mean") - F.col("ref_mean")) / (F.col("ref_std") + SPREAD_EPS))
    return rows.select(
        F.lit(metric_name).alias("metric_name"), "field_name", F.date_sub("day", reference_days).alias("ref_start"),
        F.date_sub("day", 1).alias("ref_end"), F.col("day").alias("eval_date"), "ref_mean", "ref_std", "cur_mean",
        score.alias("drift_score"), F.coalesce("_row_count", F.lit(0)).alias("_n_ref"), F.col("row_count").alias("_n_cur"))


def drift_history(feature_moments: DataFrame, prediction_moments: DataFrame | None,
                  reference_days: int = REFERENCE_DAYS) -> DataFrame:
    """D10, D11 for every day that has features, from stored day states; the process date is the day after."""
    out = shifts_of_days(feature_moments, "feature_mean_z", reference_days)
    if prediction_moments is not None:
        shift = shifts_of_days(prediction_moments, "prediction_mean_z", reference_days).filter("_n_ref > 0 and _n_cur > 0")
        days = feature_moments.select(F.col("day").alias("eval_date")).distinct()
        out = out.unionByName(shift.join(days, "eval_date", "left_semi").select(out.columns))
    return enforce(out.withColumns({"process_date": F.date_add("eval_date", 1), "created_at": F.current_timestamp()}), DRIFT_DDL)
