"""Physical layout helpers: input parallelism and staged intermediate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallyward.session import scratch_path

# More partitions than any table has.
MOST_TASKS = 1_000_000


def spread(scan: DataFrame) -> DataFrame:
    """Widen a scan that has fewer input splits than there are cores, before costly per-row work.

    A table in one small file gives one task. Large tables have more splits than cores and are
    returned as they are, so nothing is shuffled at scale. ``scan`` must be a plain scan: the split
    count is read from its plan without running a job.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def apart(df: DataFrame) -> DataFrame:
    """The same rows in the same tasks. Many wide expressions in a row make one generated method, which the JVM leaves uncompiled
    beyond 8,000 bytes; a merge of partitions, here one that merges nothing, ends the method."""
    return df.coalesce(MOST_TASKS)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a frame that several consumers read to the shared scratch folder, and read it back.

    Unlike a cache it survives the loss of executors, and it cuts the lineage.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
