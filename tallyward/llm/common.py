"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.session import scratch_path

#: Rows of an Arrow batch at most: batches lie in memory on both sides, whole.
BATCH_ROWS = 1_000
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Texts are handed to a Python function in blocks of about this many characters, so that its
#: working set does not depend on the number of rows in an Arrow batch.
BLOCK_CHARS = 2_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def blocks(batches: Iterable[pa.RecordBatch], text_at: int, chars: int = BLOCK_CHARS) -> Iterator[list[list]]:
    """Columns of the batches as lists, cut so that the texts of a block stay near ``chars``."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(text_at)).to_pylist()
        start = size = 0
        for i, n in enumerate(lengths):
            size += n or 0
            if size >= chars:
                yield [c.to_pylist() for c in batch.slice(start, i + 1 - start).columns]
                start, size = i + 1, 0
        if start < batch.num_rows:
            yield [c.to_pylist() for c in batch.slice(start).columns]


def small_batches(spark: SparkSession) -> None:
    """Lower the session's rows per Arrow batch to ``BATCH_ROWS``: the default of 10,000 rows of long texts takes hundreds of MB in
    an executor and its workers."""
    if not 0 < int(spark.conf.get(BATCH_CONF)) <= BATCH_ROWS:
        spark.conf.set(BATCH_CONF, BATCH_ROWS)


def map_texts(df: DataFrame, fn: Callable[[Iterator[list[list]]], Iterator[dict]], schema: str,
              text_at: int = 1) -> DataFrame:
    """``mapInArrow`` over blocks: ``fn`` gets lists of columns and yields dicts of columns."""
    spark = df.sparkSession
    small_batches(spark)
    fields = spark.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in fn(blocks(batches, text_at)):
            if len(next(iter(out.values()))):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)
        # workers live on between tasks and stages: what a task freed goes back
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns the text operators read; a null text becomes the empty one."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"),
                       F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def most_frequent(counts: DataFrame, size: int, count_col: str = "n") -> tuple[DataFrame, int]:
    """The rows whose count reaches a cut, and the cut: the smallest one that leaves at most ``size`` rows. Found from the
    number of rows per count (there are at most about the root of twice the total as many different counts), so that
    no task hands the driver more than the final rows. ``counts`` is read twice."""
    left, cut = size, None
    sizes = counts.groupBy(F.col(count_col).alias("c")).agg(F.count(F.lit(1)).alias("rows")).collect()
    for r in sorted(sizes, key=lambda r: -r["c"]):
        left -= r["rows"]
        if left < 0:
            break
        cut = r["c"]
    return counts.filter(F.lit(False) if cut is None else F.col(count_col) >= cut), cut or 0


def likely_rows(rows: DataFrame, id_col: str, wanted: DataFrame, slots: int = 1 << 20) -> DataFrame:
    """The rows whose id is in the one column of ``wanted``, and some others: a semi-join on a hash slot of the id, whose
    broadcast side has at most ``slots`` rows. Put before an exact join, it keeps most other rows out of the shuffle."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(slots)).cast("int")
    taken = wanted.select(slot(F.col(wanted.columns[0])).alias("slot")).distinct()
    return rows.join(F.broadcast(taken), slot(F.col(id_col)) == F.col("slot"), "left_semi")
