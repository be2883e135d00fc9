"""Landing zone: one folder per incident day (A1-A3)."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.schema import LANDING_COLUMNS, landing_schema
from tallyward.sources.tables import replace_slices

PARTITIONS = ["landing_year", "landing_month", "landing_day"]


def day_slice(df: DataFrame, ts_col: str, day: date) -> DataFrame:
    """A1: the records of one day as a half-open range on the raw column, so that it can be pushed
    to the scan. Works for ISO text, date and timestamp columns. There is no row cap."""
    low, high = day.isoformat(), (day + timedelta(days=1)).isoformat()
    if dict(df.dtypes)[ts_col] == "string":
        return df.filter((F.col(ts_col) >= low) & (F.col(ts_col) < high))
    kind = dict(df.dtypes)[ts_col]
    return df.filter((F.col(ts_col) >= F.lit(low).cast(kind)) & (F.col(ts_col) < F.lit(high).cast(kind)))


def write_landing(df: DataFrame, path: str, ts_col: str = "date") -> None:
    """A2: overwrite the day folders present in ``df``; days without rows get no folder.

    ``df`` may span any number of days.
    """
    day = F.col(ts_col).cast("string")
    parts = df.withColumns({
        "landing_year": F.substring(day, 1, 4),
        "landing_month": F.substring(day, 6, 2),
        "landing_day": F.substring(day, 9, 2),
    })
    replace_slices(parts, path, PARTITIONS)


def read_landing(spark: SparkSession, path: str, day: date | None = None) -> DataFrame | None:
    """A3: landing records with an explicit all-text schema, or None when there are none.

    A given day prunes to its folder.
    """
    df = spark.read.schema(f"{landing_schema().toDDL()}, {', '.join(f'{c} string' for c in PARTITIONS)}").parquet(path)
    if day is not None:
        wanted = (f"{day:%Y}", f"{day:%m}", f"{day:%d}")
        for column, value in zip(PARTITIONS, wanted):
            df = df.filter(F.col(column) == value)
    df = df.select(*LANDING_COLUMNS)
    return None if df.isEmpty() else df
