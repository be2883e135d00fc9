"""Serving snapshot and its read queries."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyward.functions.measures import ranked_labels, safety_band, trend_direction
from tallyward.operators.dedupe import keep_latest_ties, keep_top
from tallyward.operators.features import active_grid
from tallyward.schema import SNAPSHOT_DDL, enforce, evolve
from tallyward.sources.boundaries import area_names

# Fixed values.
LOOKBACK_DAYS = 90
TOP_N = 3
AREA_TYPE = "community_area"
TOP_COLUMNS = ["top_crime_1", "top_crime_2", "top_crime_3"]


def _area_categories(incidents: DataFrame, area_col: str, category_col: str, *more: str) -> DataFrame:
    """Incident counts per area above zero and category (and more columns)."""
    rows = incidents.withColumn("area_id", F.col(area_col).try_cast("int")).filter(F.col("area_id") > 0)
    return rows.groupBy(*more, "area_id", F.col(category_col).alias("category")).agg(F.count(F.lit(1)).alias("cnt"))


def _ranked_columns(counts: DataFrame, keys: list[str], n: int) -> DataFrame:
    """top_crime_1.. per key; equal counts rank by name."""
    ranked = keep_top(counts, keys, [F.desc("cnt"), F.asc_nulls_last("category")], n)
    return ranked.groupBy(*keys).agg(
        *[F.max(F.when(F.col("rn") == k, F.col("category"))).alias(f"top_crime_{k}") for k in range(1, n + 1)])


def top_categories(incidents: DataFrame, start: date, end: date, area_col: str = "community_area",
                   category_col: str = "crime_category", day_col: str = "process_date", n: int = TOP_N) -> DataFrame:
    """The most frequent categories per area, one row per area.

    Only areas above zero count. Equal counts rank by name.
    """
    window = incidents.filter(F.col(day_col).between(F.lit(start), F.lit(end)))
    return _ranked_columns(_area_categories(window, area_col, category_col), ["area_id"], n)


def sliding_top_categories(incidents: DataFrame, lookback_days: int = LOOKBACK_DAYS, area_col: str = "community_area",
                           category_col: str = "crime_category", day_col: str = "process_date",
                           n: int = TOP_N) -> DataFrame:
    """``top_categories`` of the window [day - lookback, day] for every day in one plan: process_date, area_id, top_crime_1..

    Incidents are combined per day first. A category stays in an area's list until ``lookback_days`` after its last incident; its
    count on each of these days is a RANGE frame over the day number. What is ranked so grows with days, areas and
    categories, not with incidents.
    """
    keys = ["area_id", "category"]
    daily = _area_categories(incidents, area_col, category_col, day_col).withColumnRenamed(day_col, "process_date")
    grid = active_grid(daily, keys, "process_date", ("cnt",), back=lookback_days)
    frame = W.partitionBy(*keys).orderBy("_day_no").rangeBetween(-lookback_days, 0)
    counts = grid.withColumn("_day_no", F.datediff("process_date", F.lit(date(1970, 1, 1)))) \
        .withColumn("cnt", F.sum("cnt").over(frame)).filter("cnt > 0")
    return _ranked_columns(counts, ["process_date", "area_id"], n)


def _served(predictions: DataFrame, top: DataFrame, area_features: DataFrame, names: DataFrame | None,
            keys: list[str]) -> DataFrame:
    """The snapshot columns of the predictions; the other sides have one row per key, and which of them to broadcast is
    left to adaptive execution, which knows their real size."""
    week = area_features.filter(F.col("area_type") == AREA_TYPE).select(*keys, "count_7d", "violent_count_7d")
    joined = predictions.join(top, keys, "left").join(week, keys, "left")
    if names is not None:
        joined = joined.join(area_names(names), "area_id", "left")
    else:
        joined = joined.withColumn("area_name", F.lit(None).cast("string"))
    return enforce(joined.withColumns({
        "predicted_count_low": F.coalesce("predicted_count_low", F.lit(0.0)),
        "predicted_count_high": F.coalesce("predicted_count_high", "predicted_count"),
        "safety_score": F.coalesce("safety_score", F.lit(0.0)),
        "source_prediction_ts": F.col("created_at"),
    }), SNAPSHOT_DDL)


def _area_predictions(predictions: DataFrame) -> DataFrame:
    pred = evolve(predictions, "safety_score double, predicted_count_low double, predicted_count_high double")
    return pred.filter(F.col("area_type") == AREA_TYPE)


def build_snapshot(predictions: DataFrame, ml_features: DataFrame, area_features: DataFrame, process_date: date,
                   names: DataFrame | None = None, lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """K1: 19 columns per predicted area and day of one batch."""
    pred = _area_predictions(predictions).filter(F.col("process_date") == F.lit(process_date))
    top = top_categories(ml_features, process_date - timedelta(days=lookback_days), process_date)
    return _served(pred, top, area_features.filter(F.col("process_date") == F.lit(process_date)), names, ["area_id"])


def build_snapshots(predictions: DataFrame, ml_features: DataFrame, area_features: DataFrame,
                    names: DataFrame | None = None, lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """K1 for all batches of ``predictions`` in one plan: what ``build_snapshot`` gives for each of them."""
    top = sliding_top_categories(ml_features, lookback_days)
    return _served(_area_predictions(predictions), top, area_features, names, ["process_date", "area_id"])


def latest_batch(snapshot: DataFrame, before: Column | None = None) -> Column:
    """Newest process date (before the given one) as a scalar subquery.

    The value is known before the outer scan starts, so the scan reads one partition only.
    """
    rows = snapshot if before is None else snapshot.filter(F.col("process_date") < before)
    return rows.agg(F.max("process_date").alias("d")).scalar()


def _batch(snapshot: DataFrame, process_date: date | Column | None, prediction_date: date | None) -> DataFrame:
    wanted = latest_batch(snapshot) if process_date is None else process_date
    wanted = wanted if isinstance(wanted, Column) else F.lit(wanted)
    rows = snapshot.filter(F.col("process_date") == wanted)
    if prediction_date is not None:
        return rows.filter(F.col("prediction_date") == F.lit(prediction_date))
    return keep_latest_ties(rows.filter(F.col("area_id").isNotNull() & F.col("prediction_date").isNotNull()),
                            ["area_id"], [F.desc("prediction_date")])


def list_areas(snapshot: DataFrame, process_date: date | None = None, prediction_date: date | None = None,
               names: DataFrame | None = None) -> DataFrame:
    """One batch, ordered by area.

    Without ``prediction_date`` each area shows its latest one. A missing name is taken from
    ``names`` (area_id, area_name).
    """
    rows = _batch(snapshot, process_date, prediction_date)
    name = F.nullif(F.col("area_name"), F.lit(""))
    if names is not None:
        ref = names.select("area_id", F.col("area_name").alias("_ref_name"))
        rows = rows.join(ref, "area_id", "left")
        name = F.coalesce(name, F.col("_ref_name"))
    return rows.select(
        "area_id", name.alias("name"), "safety_score", safety_band(F.col("safety_score")).alias("safety_band"),
        "predicted_count", ranked_labels(TOP_COLUMNS).alias("top_categories"), "predicted_count_low",
        "predicted_count_high", "prediction_date", "target_date", "process_date", "model_name", "model_version",
    ).orderBy("area_id")


def city_summary(snapshot: DataFrame, process_date: date | Column | None = None,
                 prediction_date: date | None = None) -> DataFrame:
    """Average safety and area count of a batch; no row for an empty batch."""
    rows = _batch(snapshot, process_date, prediction_date)
    return rows.groupBy("process_date").agg(
        F.coalesce(F.avg("safety_score"), F.lit(0.0)).alias("average_safety"),
        F.count(F.lit(1)).alias("total_areas"))


def recent_batches(snapshot: DataFrame, n: int = 2) -> DataFrame:
    """the newest distinct batches."""
    return snapshot.select("process_date").distinct().orderBy(F.desc("process_date")).limit(n)


def city_compare(snapshot: DataFrame, process_date: date | None = None, prediction_date: date | None = None,
                 strict: bool = True) -> DataFrame:
    """Newer batch against the one before it.

    ``strict`` raises when there is no earlier batch; otherwise the result is then empty.
    """
    newer = F.lit(process_date) if process_date is not None else latest_batch(snapshot)
    older = latest_batch(snapshot, before=newer)
    current = city_summary(snapshot, newer, prediction_date).select(
        F.col("process_date").alias("process_date_current"),
        F.col("average_safety").alias("average_safety_current"), F.col("total_areas").alias("total_areas_current"))
    previous = city_summary(snapshot, older, prediction_date).select(
        F.struct(F.col("process_date").alias("process_date_previous"),
                 F.col("average_safety").alias("average_safety_previous"),
                 F.col("total_areas").alias("total_areas_previous")).alias("p"))
    out = current.withColumn("_p", previous.scalar()).filter(F.col("_p").isNotNull())
    out = out.select(*current.columns, "_p.*")
    delta = F.col("average_safety_current") - F.col("average_safety_previous")
    out = out.withColumns({"delta_average_safety": delta, "direction": trend_direction(delta)})
    if strict and out.isEmpty():
        raise ValueError("comparison needs two non-empty batches")
    return out
