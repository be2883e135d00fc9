"""Area-day features.

The calendar grid is built from the daily counts themselves. A row for (area, day d) exists when
the area has an incident in [d-14, d+1]; so each active day generates exactly the days it keeps
alive and nothing else. Rolling sums use RANGE frames over the day number, which are right on any
set of days. After the daily aggregate there is a single exchange, on the area: grid, rolling sums
and next-day labels all run on it, for one day or for a whole backfill.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyward.functions.calendar import calendar_features
from tallyward.functions.keys import date_key
from tallyward.functions.measures import bool_flag, fill_zero, fraction
from tallyward.schema import FEATURE_DDL, enforce

# Look-back and look-ahead of one feature row, in days.
LOOKBACK_DAYS, LOOKAHEAD_DAYS = 14, 1

COUNTS = ["count_1d", "violent_count_1d", "property_count_1d", "drug_count_1d", "weapon_count_1d",
          "arrest_count_1d", "domestic_count_1d"]
ROLLING = [
    ("count_3d", "count_1d", 3), ("count_7d", "count_1d", 7), ("count_14d", "count_1d", 14),
    ("violent_count_7d", "violent_count_1d", 7), ("property_count_7d", "property_count_1d", 7),
    ("drug_count_7d", "drug_count_1d", 7), ("weapon_count_7d", "weapon_count_1d", 7),
    ("arrest_count_7d", "arrest_count_1d", 7), ("domestic_count_7d", "domestic_count_1d", 7),
]
LABELS = [
    ("label_next_day_count", "count_1d"),
    ("label_next_day_violent_count", "violent_count_1d"),
    ("label_next_day_property_count", "property_count_1d"),
    ("label_next_day_drug_count", "drug_count_1d"),
    ("label_next_day_weapon_count", "weapon_count_1d"),
]


def source_window(silver: DataFrame, start: date, end: date, by_slice: bool = False) -> DataFrame:
    """Silver rows that features for [start, end] can see, as a range on the raw time column.

    A plain comparison reaches the scan; wrapping the column in a date function would not.
    ``by_slice`` adds the same range on the slice date ``process_date``, so that only those folders are
    listed and read. It needs a table whose slice date is the incident day.
    """
    low = start - timedelta(days=LOOKBACK_DAYS)
    high = end + timedelta(days=LOOKAHEAD_DAYS + 1)
    kinds = dict(silver.dtypes)

    def within(column: str) -> Column:
        lower, upper = F.lit(low.isoformat()), F.lit(high.isoformat())
        return (F.col(column) >= lower.cast(kinds[column])) & (F.col(column) < upper.cast(kinds[column]))

    rows = silver.filter(within("date"))
    return rows.filter(within("process_date")) if by_slice else rows


def area_daily_counts(silver: DataFrame, area_type: str = "community_area") -> DataFrame:
    """Counts per area and day. A hot area is combined map-side, per day."""
    if area_type != "community_area":
        raise ValueError(f"unsupported area_type {area_type!r}")

    def flagged(name: str):
        return F.sum(F.when(F.col(name) == 1, 1).otherwise(0))

    return silver.groupBy(
        F.lit(area_type).alias("area_type"),
        F.col(area_type).try_cast("int").alias("area_id"),
        F.to_date("date").alias("event_date"),
    ).agg(
        F.count(F.lit(1)).alias("count_1d"),
        flagged("violent_crime_flag").alias("violent_count_1d"),
        flagged("property_crime_flag").alias("property_count_1d"),
        flagged("drug_crime_flag").alias("drug_count_1d"),
        flagged("weapon_crime_flag").alias("weapon_count_1d"),
        F.sum(bool_flag(F.col("arrest"))).alias("arrest_count_1d"),
        F.sum(bool_flag(F.col("domestic"))).alias("domestic_count_1d"),
    ).withColumn("date_key", date_key(F.col("event_date")))


def active_grid(daily: DataFrame, keys: Sequence[str] = ("area_type", "area_id"), day: str = "event_date",
                counts: Sequence[str] = tuple(COUNTS), back: int = LOOKBACK_DAYS,
                ahead: int = LOOKAHEAD_DAYS) -> DataFrame:
    """Daily counts plus zero rows for the days on which a key is still (or about to be) active.

    An active day t is followed by zero rows up to t+back, and the day before the next active day is
    added when it lies beyond that; so is the day before the first one. Equal to crossing every key
    with the calendar and dropping the days without an incident in [d-back, d+ahead] (ahead is 1).
    """
    if ahead != 1:
        raise ValueError("ahead is 1: labels are next-day labels")
    window = W.partitionBy(*keys).orderBy(day)
    d, following, previous = F.col(day), F.lead(day).over(window), F.lag(day).over(window)
    placed = daily.withColumns({"_next": following, "_first": previous.isNull()})
    own = F.array(d)
    head = F.when(F.col("_first"), F.array(F.date_sub(d, 1))).otherwise(F.array().cast("array<date>"))
    last = F.when(F.col("_next").isNull(), F.date_add(d, back)).otherwise(
        F.least(F.date_add(d, back), F.date_sub(F.col("_next"), 1)))
    tail = F.when(last > d, F.sequence(F.date_add(d, 1), last)).otherwise(F.array().cast("array<date>"))
    before_next = F.when(F.date_sub(F.col("_next"), 1) > F.date_add(d, back),
                         F.array(F.date_sub(F.col("_next"), 1))).otherwise(F.array().cast("array<date>"))
    exploded = placed.withColumn("_day", F.explode(F.concat(own, head, tail, before_next)))
    on_day = F.col("_day") == d
    return exploded.select(
        *keys, F.col("_day").alias(day),
        *[F.when(on_day, F.col(c)).otherwise(F.lit(0)).cast("bigint").alias(c) for c in counts],
    )


def area_features(silver: DataFrame, start: date, end: date | None = None,
                  area_type: str = "community_area", label_fill: str = "zero",
                  roster: DataFrame | None = None, by_slice: bool = False) -> DataFrame:
    """Feature rows for every process date in [start, end] in one job.

    Incidents without an area form one null-area row per day whose counts are all zero.
    ``label_fill="null"`` leaves labels null for days after the last silver day of the window, where
    "no incident" cannot be told from "not loaded yet". ``roster`` (column area_id) adds zero rows for
    areas without any incident in the window. ``by_slice`` prunes the slices of a stored table (see
    ``source_window``).
    """
    end = end or start
    if start > end:
        raise ValueError(f"start {start} is after end {end}")
    source = source_window(silver, start, end, by_slice)
    daily = area_daily_counts(source, area_type)
    known = F.col("area_id").isNotNull()
    daily = daily.withColumns({c: F.when(known, F.col(c)).otherwise(0) for c in COUNTS})
    grid = active_grid(daily)
    if roster is not None:
        grid = _with_roster(grid, roster, area_type, start, end)

    day_no = F.datediff("event_date", F.lit(date(1970, 1, 1)))
    grid = grid.withColumn("_day_no", day_no)
    order = W.partitionBy("area_type", "area_id").orderBy("_day_no")
    rolling = {name: F.sum(c).over(order.rangeBetween(1 - n, 0)) for name, c, n in ROLLING}
    labels = {name: F.sum(c).over(order.rangeBetween(1, 1)) for name, c in LABELS}
    rows = grid.withColumns({**rolling, **labels}).filter(F.col("event_date").between(F.lit(start), F.lit(end)))

    if label_fill == "null":
        # One day past the window is read, so the newest loaded day decides what is known.
        newest = daily.agg(F.max("event_date").alias("m"))
        known_next = F.date_add("event_date", 1) <= newest.scalar()
        rows = rows.withColumns({name: F.when(known_next, F.coalesce(F.col(name), F.lit(0))) for name, _ in LABELS})
    else:
        rows = rows.withColumns(fill_zero([name for name, _ in LABELS]))
    total = F.col("count_7d")
    rows = rows.withColumns({
        "arrest_rate_7d": fraction(F.col("arrest_count_7d"), total),
        "domestic_rate_7d": fraction(F.col("domestic_count_7d"), total),
        "date": F.col("event_date"),
        "date_key": date_key(F.col("event_date")),
        "feature_as_of_date": F.col("event_date"),
        "process_date": F.col("event_date"),
        **calendar_features(F.col("event_date")),
    })
    return enforce(rows, FEATURE_DDL)


def _with_roster(grid: DataFrame, roster: DataFrame, area_type: str, start: date, end: date) -> DataFrame:
    zeros = roster.select(
        F.lit(area_type).alias("area_type"), F.col("area_id").cast("int").alias("area_id"),
        F.explode(F.sequence(F.lit(start), F.lit(end))).alias("event_date"),
        *[F.lit(0).cast("bigint").alias(c) for c in COUNTS],
    )
    return grid.unionByName(zeros).groupBy("area_type", "area_id", "event_date").agg(
        *[F.sum(c).alias(c) for c in COUNTS])
