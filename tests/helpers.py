"""Small builders for hand-written frames."""

from tallyward.schema import LANDING_COLUMNS, landing_schema


def landing_frame(spark, rows):
    """Landing records from dicts; absent columns are null."""
    return spark.createDataFrame([tuple(r.get(c) for c in LANDING_COLUMNS) for r in rows], landing_schema())


def dicts(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def by(df, key):
    return {r[key]: r.asDict(recursive=True) for r in df.collect()}
