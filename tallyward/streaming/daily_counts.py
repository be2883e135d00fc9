"""Streaming counts per area and day."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyward.operators.dedupe import keep_latest
from tallyward.sources.bucket_log import BUCKETS, BucketLog, folders, slice_values
from tallyward.sources.tables import replace_slices
from tallyward.streaming.arrivals import SOURCE_LAG_DAYS, due_days

KEYS = ["area_id", "event_date"]


def windowed_counts(stream: DataFrame, ts_col: str, area_col: str, measures: dict[str, Column],
                    lag_days: int = SOURCE_LAG_DAYS) -> DataFrame:
    """Tumbling one-day counts. State of a day is dropped once the watermark passes it.

    Windows are cut at midnight UTC; shifting the event time by the session's zone offset cuts them at
    midnight of the session's zone instead.
    """
    zone = F.current_timezone()
    return (stream.withColumn(ts_col, F.from_utc_timestamp(F.col(ts_col).cast("timestamp"), zone))
            .withWatermark(ts_col, f"{lag_days} days")
            .groupBy(F.window(ts_col, "1 day").alias("w"), F.col(area_col).alias("area_id"))
            .agg(*[c.alias(n) for n, c in measures.items()])
            .select("area_id", F.to_date(F.to_utc_timestamp("w.start", zone)).alias("event_date"), *measures))


def counts_log(spark: SparkSession, path: str, schema: str, buckets: int = BUCKETS) -> BucketLog:
    """The updates of open days, by batch; a later batch replaces an earlier one's row of the same area and day."""
    return BucketLog(spark, f"{path.rstrip('/')}/open", schema, "area_id", buckets)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _newest(rows: DataFrame) -> DataFrame:
    return keep_latest(rows, KEYS, [F.desc("batch")])


def write_updates(counts: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Log every changed (area, day) of a micro-batch. A replayed batch writes its own folder again, so failures do not
    duplicate rows."""
    ddl = _ddl(counts)

    def save(batch: DataFrame, batch_id: int) -> None:
        log = counts_log(batch.sparkSession, path, ddl, buckets)
        log.compact(_newest, before=batch_id)
        log.append(batch, batch_id)

    return (counts.writeStream.outputMode("update").foreachBatch(save)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def close_days(spark: SparkSession, path: str, schema: str, day: date, buckets: int = BUCKETS) -> None:
    """Move the counts of the days before ``day``, which the watermark has passed, to slices of their own, and fold the log to the
    newest rows of the days still open. The slices are complete before the log loses their rows; readers prefer slices, so
    a failure in between changes nothing, and neither does a second run."""
    log = counts_log(spark, path, schema, buckets)
    rows = _newest(log.read()).filter(F.col("event_date") < F.lit(day)).drop("bucket", "batch")
    done = slice_values(spark, f"{path.rstrip('/')}/closed", "event_date")
    replace_slices(rows.filter(~F.col("event_date").cast("string").isin(done)), f"{path.rstrip('/')}/closed", ["event_date"])
    parts = log.parts()
    if parts:
        log.compact(lambda r: _newest(r).filter(F.col("event_date") >= F.lit(day)), before=parts[-1][0] + 1, parts=0)


def read_counts(spark: SparkSession, path: str, schema: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The current counts: closed days as stored, open days by their newest rows. ``schema`` is that of the counts; without it, it is
    read from the files."""
    root = path.rstrip("/")
    if schema is None:
        first = next(name for name in folders(spark, f"{root}/open") if name.startswith("part="))
        schema = _ddl(spark.read.parquet(f"{root}/open/{first}").drop("bucket"))
    done = slice_values(spark, f"{root}/closed", "event_date")
    rows = _newest(counts_log(spark, path, schema, buckets).read()).drop("bucket", "batch")
    if not done:
        return rows
    closed = spark.read.schema(schema).parquet(f"{root}/closed")
    return rows.filter(~F.col("event_date").cast("string").isin(done)).unionByName(closed)


def released(spark: SparkSession, path: str, schema: str, today: date, lag_days: int = SOURCE_LAG_DAYS) -> DataFrame:
    """L2: the counts of the days that are due by ``today`` and closed; only their slices are read."""
    days = list(map(date.fromisoformat, slice_values(spark, f"{path.rstrip('/')}/closed", "event_date")))
    due = [d.isoformat() for d in due_days(min(days), today, lag_days)] if days else []
    rows = spark.read.schema(schema).parquet(f"{path.rstrip('/')}/closed") if days else spark.createDataFrame([], schema)
    return rows.filter(F.col("event_date").between(due[0], due[-1])) if due else rows.limit(0)
