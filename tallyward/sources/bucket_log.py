"""Keyed state of incremental jobs: rows logged per batch, in folders of hash buckets.

A batch writes one folder, ``part=<batch>-d``, which counts once its success marker is there. So a batch that is run again writes
the same folder again, and a reader never sees half of one. Readers name the buckets they need; the other folders
are not opened. ``compact`` folds the parts before a batch into one folder ``part=<last>-b`` beside them; they are
removed only when it is complete.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: To be chosen for the keys a table will hold (a bucket is read whole) and kept for its life.
BUCKETS = 64


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies directly in ``path``; none without the folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def slice_values(spark: SparkSession, path: str, column: str) -> list[str]:
    """The values a table is sliced by, from its folder names: no file is read."""
    return [name.removeprefix(f"{column}=") for name in folders(spark, path) if name.startswith(f"{column}=")]


class BucketLog:
    """``schema`` is the DDL of the rows, ``key`` the column whose hash picks the bucket."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets

    def bucket(self, key: Column | None = None) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key) if key is None else key), F.lit(self.buckets)).cast("int")

    def parts(self) -> list[tuple[int, str]]:
        """(batch, folder) of the parts that count: the last complete base and the complete batches after it."""
        found = []
        for name in folders(self.spark, self.path):
            number, _, kind = name.removeprefix("part=").rpartition("-")
            if name.startswith("part=") and "_SUCCESS" in folders(self.spark, f"{self.path}/{name}"):
                found.append((int(number), kind == "b", name))
        base = max((number for number, is_base, _ in found if is_base), default=None)
        return sorted((number, name) for number, is_base, name in found
                      if (is_base and number == base) or (not is_base and (base is None or number > base)))

    def has(self, batch: int) -> bool:
        """Whether the batch is logged, on its own or in a base."""
        return any(number == batch or (name.endswith("-b") and number >= batch) for number, name in self.parts())

    def append(self, rows: DataFrame, batch: int) -> None:
        """Log the rows of a batch; a second run of the batch replaces the first."""
        if any(name.endswith("-b") and number >= batch for number, name in self.parts()):
            return
        self._write(rows, f"part={batch}-d")

    def _write(self, rows: DataFrame, name: str) -> None:
        (rows.withColumn("bucket", self.bucket()).repartition("bucket").write.mode("overwrite")
             .option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(f"{self.path}/{name}"))

    def touched(self, keys: DataFrame) -> list[int]:
        """The buckets of the keys in the one column of ``keys``: at most ``buckets`` numbers."""
        return sorted(r[0] for r in keys.select(self.bucket(F.col(keys.columns[0]))).distinct().collect())

    def read(self, buckets: Iterable[int] | None = None, only: int | None = None) -> DataFrame:
        """The logged rows of the given buckets with their ``batch`` (that of the base for folded ones); ``only`` names one batch."""
        names = [name for number, name in self.parts() if only is None or name == f"part={only}-d"]
        if not names:
            return self.spark.createDataFrame([], f"{self.schema}, bucket int, batch long")
        rows = (self.spark.read.schema(f"{self.schema}, part string, bucket int").option("basePath", self.path)
                .parquet(*[f"{self.path}/{name}" for name in names]))
        if buckets is not None:
            rows = rows.filter(F.col("bucket").isin(list(buckets)))
        return _with_batch(rows)

    def compact(self, merge: Callable[[DataFrame], DataFrame], before: int, parts: int = 64) -> bool:
        """Fold all parts before a batch into a base once there are more than ``parts`` of them. ``merge`` gets their rows with their
        ``batch`` and gives the rows that say the same, in the columns of the schema."""
        old = [(number, name) for number, name in self.parts() if number < before]
        if len(old) <= parts:
            return False
        rows = (self.spark.read.schema(f"{self.schema}, part string, bucket int").option("basePath", self.path)
                .parquet(*[f"{self.path}/{name}" for _, name in old]).drop("bucket"))
        base = f"part={old[-1][0]}-b"
        self._write(merge(_with_batch(rows)).drop("batch"), base)
        for _, name in old:
            if name != base:
                self._remove(name)
        return True

    def _remove(self, name: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def _with_batch(rows: DataFrame) -> DataFrame:
    return rows.withColumn("batch", F.regexp_extract("part", r"^(-?\d+)-", 1).cast("long")).drop("part")
