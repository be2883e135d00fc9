"""Arrival-driven processing (L1-L4).

A file source watches the landing folder; every micro-batch is deduplicated, merged into the silver
table and handed to the follow-up writers. ``availableNow`` processes what is there and stops, so a
scheduler can run it as an ordinary job.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyward.operators.dedupe import keep_latest
from tallyward.operators.layout import stage
from tallyward.plans.silver import build_silver
from tallyward.schema import SILVER_DDL, landing_schema, struct_of
from tallyward.sources.bucket_log import BUCKETS, BucketLog
from tallyward.sources.tables import clear_slices, replace_slices

# Fixed value: days between an incident and its publication.
SOURCE_LAG_DAYS = 10

#: Gets the complete rows of the changed day slices, the days (``process_date``) left without rows, and the batch number.
Writer = Callable[[DataFrame, DataFrame, int], None]


def landing_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """L1: the landing folder as a stream of text records, with an explicit schema."""
    reader = spark.readStream.schema(landing_schema())
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def due_days(first: date, today: date, lag_days: int = SOURCE_LAG_DAYS) -> list[date]:
    """L2: the days that should have been published by ``today``."""
    last = today - timedelta(days=lag_days)
    return [first + timedelta(days=i) for i in range((last - first).days + 1)]


def id_index(spark: SparkSession, silver_path: str, buckets: int = BUCKETS) -> BucketLog:
    """Which day slices an id was ever stored in, beside the silver table. An entry may outlive the row it speaks of, but no stored
    row is without one: entries are logged before the slices are written."""
    return BucketLog(spark, f"{silver_path.rstrip('/')}_ids", "id bigint, process_date date", "id", buckets)


def merge_latest_silver(spark: SparkSession, path: str, batch: DataFrame, batch_id: int | None = None,
                        buckets: int = BUCKETS) -> DataFrame:
    """L4: keep-latest against what is stored. Returns the touched days: process_date, emptied.

    Streaming ``dropDuplicates`` keeps the first record seen; here the latest ``updated_on`` per id must win, wherever
    it is stored: a correction may move an incident to another day. The days that hold an arriving id come from the id index,
    of which only the buckets of the arriving ids are read; their slices are rewritten together with the
    arriving days, and slices that lose their last row are removed. A table stored without an index gets one from a scan of two
    columns, once. The merged rows pass through the shared scratch folder before they replace the slices. A
    replay after a failure in between finds the same rows again.
    """
    index = id_index(spark, path, buckets)
    days = batch.select("process_date").distinct()
    known = index.parts()
    if batch_id is None:
        batch_id = known[-1][0] + 1 if known else 0
    if _exists(spark, path):
        stored = spark.read.schema(_stored_schema()).parquet(path)
        if not known:
            index.append(stored.select("id", "process_date").filter("id is not null").distinct(), -1)
        index.compact(lambda rows: rows.drop("batch").distinct(), before=batch_id)
        ids = batch.select("id").filter("id is not null").distinct()
        homes = index.read(index.touched(ids)).join(ids, "id", "left_semi")
        days = stage(days.union(homes.select("process_date")).distinct(), "touched-days")
        rows = stored.join(days, "process_date", "left_semi").select(stored.columns).unionByName(batch)
    else:
        days, rows = stage(days, "touched-days"), batch
    index.append(batch.select("id", "process_date").filter("id is not null").distinct(), batch_id)
    order = [F.desc_nulls_last(c) for c in ("updated_on", "date", "case_number")]
    order += [F.asc_nulls_last(c) for c in rows.columns if c not in ("updated_on", "date", "case_number", "id")]
    merged = stage(keep_latest(rows, ["id"], order), "silver-merge")
    filled = merged.select("process_date").distinct().withColumn("_filled", F.lit(True))
    touched = stage(days.join(filled, "process_date", "left").select(
        "process_date", F.col("_filled").isNull().alias("emptied")), "touched-days")
    replace_slices(merged, path, ["process_date"])
    clear_slices(spark, path, "process_date", touched.filter("emptied").select("process_date"))
    return touched


def _stored_schema():
    return struct_of(SILVER_DDL.replace("process_date timestamp", "process_date date"))


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def run_arrivals(stream: DataFrame, silver_path: str, checkpoint: str, writers: Sequence[Writer] = (),
                 layers: dict[str, DataFrame] | None = None, key_method: str = "xxhash64",
                 buckets: int = BUCKETS) -> StreamingQuery:
    """L1, L3, L4: start the job; the caller awaits it.

    The process date of a record is its incident day. Every micro-batch may be replayed after a
    failure: the merge and the slice replacement give the same table again. The follow-up writers
    receive the complete day slices that changed, read back from the table, and the days that became empty.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        day = F.to_date(F.col("date").try_cast("timestamp"))
        silver = build_silver(batch, day, layers, key_method).withColumn("process_date", F.to_date("process_date"))
        arrived = stage(silver.filter(F.col("process_date").isNotNull()), "arrivals")
        if arrived.isEmpty():
            return
        touched = merge_latest_silver(spark, silver_path, arrived, batch_id, buckets)
        stored = spark.read.schema(_stored_schema()).parquet(silver_path)
        changed = stored.join(touched.filter("not emptied"), "process_date", "left_semi").select(stored.columns)
        for write in writers:
            write(changed, touched.filter("emptied").select("process_date"), batch_id)

    return (stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
