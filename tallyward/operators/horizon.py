"""Training sets over forecast horizons."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Model inputs, label name, furthest horizon, and the split windows in days before the run.
FEATURE_COLUMNS = ["count_1d", "count_3d", "count_7d", "count_14d", "violent_count_7d", "arrest_rate_7d",
                   "domestic_rate_7d", "day_of_week", "is_weekend", "month", "season", "horizon"]
LABEL_COLUMN = "label_next_day_count"
MAX_HORIZON = 10
SPLIT_OFFSETS = {"train": (392, 92), "val": (91, 61), "test": (60, 30)}

Windows = dict[str, tuple[date, date]]


def split_windows(run_date: date) -> Windows:
    """The three event-date windows of a run."""
    return {name: (run_date - timedelta(days=first), run_date - timedelta(days=last))
            for name, (first, last) in SPLIT_OFFSETS.items()}


def expand_horizons(features: DataFrame, start: date, end: date, max_horizon: int = MAX_HORIZON,
                    feature_columns: Sequence[str] = tuple(FEATURE_COLUMNS),
                    label_col: str = LABEL_COLUMN) -> DataFrame:
    """One row per area-day in [start, end] and horizon h whose label, the count at day + h, exists.

    Each row gathers the at most ``max_horizon`` later counts of its own area by a RANGE frame and
    unfolds them afterwards, so area-days are shuffled once and not ``max_horizon`` times. Rows
    without an area have no label, as with an equality join.
    """
    inputs = [c for c in feature_columns if c != "horizon"]
    day = F.to_date("date")
    base = (
        features.filter(day.between(F.lit(start), F.lit(end + timedelta(days=max_horizon))))
        .filter(F.col("area_type").isNotNull() & F.col("area_id").isNotNull())
        .select(day.alias("event_date"), "area_type", "area_id", *inputs,
                F.datediff(day, F.lit(date(1970, 1, 1))).alias("_day_no"))
    )
    later = (W.partitionBy("area_type", "area_id").orderBy("_day_no").rangeBetween(1, max_horizon))
    upcoming = F.collect_list(F.struct(F.col("_day_no").alias("at"), F.col("count_1d").cast("int").alias("n")))
    unfolded = (base.withColumn("_later", upcoming.over(later))
                .filter(F.col("event_date") <= F.lit(end))
                .withColumn("_at", F.explode("_later")))
    return unfolded.select(
        "event_date", "area_type", "area_id", *inputs,
        (F.col("_at.at") - F.col("_day_no")).alias("horizon"),
        F.col("_at.n").alias(label_col),
    )


def split_rows(expanded: DataFrame, window: tuple[date, date], embargo: bool = False) -> DataFrame:
    """Rows whose event date lies in the window.

    Without ``embargo`` rows at the end of a window carry labels from the days after it; with it,
    labels must lie in the window as well.
    """
    first, last = window
    rows = expanded.filter(F.col("event_date").between(F.lit(first), F.lit(last)))
    if embargo:
        rows = rows.filter(F.date_add("event_date", F.col("horizon").cast("int")) <= F.lit(last))
    return rows


def split_sizes(expanded: DataFrame, windows: Windows) -> DataFrame:
    """All split sizes in one pass: (split, row_count)."""
    counts = [F.count(F.when(F.col("event_date").between(F.lit(a), F.lit(b)), 1)).alias(name)
              for name, (a, b) in windows.items()]
    return expanded.agg(*counts).unpivot([], list(windows), "split", "row_count")
