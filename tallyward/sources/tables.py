"""Table scans and idempotent writes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.operators.dedupe import keep_one
from tallyward.schema import evolve, struct_of
from tallyward.session import scratch_path


def read_table(spark: SparkSession, name: str, fmt: str | None = None, **options: str) -> DataFrame:
    """A4, A5: a catalog table, or any connector named by ``fmt``."""
    if fmt is None:
        return spark.table(name)
    return spark.read.format(fmt).options(**options).load(name)


def read_if_exists(spark: SparkSession, name: str) -> DataFrame | None:
    """None for a table that does not exist yet."""
    return spark.table(name) if spark.catalog.tableExists(name) else None


def create_if_absent(spark: SparkSession, name: str, ddl: str, partition_col: str = "process_date",
                     fmt: str = "parquet", location: str | None = None) -> None:
    """Create a table partitioned by its batch date.

    Partitions are by value, so a timestamp batch column is stored as a date.
    """
    fields = struct_of(ddl).fields
    columns = ", ".join(
        f"{f.name} {'date' if f.name == partition_col else f.dataType.simpleString()}" for f in fields)
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING {fmt} PARTITIONED BY ({partition_col}){where}")


def add_missing_columns(spark: SparkSession, name: str, optional: str) -> list[str]:
    """A14-A18 on a catalog table: add the absent columns in one statement; no-op without the table."""
    if not spark.catalog.tableExists(name):
        return []
    have = set(spark.table(name).columns)
    missing = [f for f in struct_of(optional).fields if f.name not in have]
    if missing:
        body = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in missing)
        spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({body})")
    return [f.name for f in missing]


def replace_slices(df: DataFrame, path: str, partition_cols: Sequence[str], fmt: str = "parquet",
                   gather: bool = True) -> None:
    """Overwrite only the partitions present in ``df``; a rerun changes nothing.

    An empty frame leaves the table as it is. ``gather`` brings the rows of a slice together first, so
    that a slice does not end up as one small file per task; a slice that outgrows a partition is
    split by adaptive execution, so a day holding a third of all rows is still written in parallel.
    """
    rows = df.hint("rebalance", *partition_cols) if gather else df
    (rows.write.format(fmt).mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(*partition_cols).save(path))


def clear_slices(spark: SparkSession, path: str, partition_col: str, values: DataFrame) -> None:
    """Remove the slices of the values in the one column of ``values``: those a rewrite has left without rows."""
    for row in values.toLocalIterator():
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{partition_col}={row[0]}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def replace_table_slices(df: DataFrame, name: str) -> None:
    """A10 on a catalog table: columns are matched by name."""
    spark = df.sparkSession
    previous = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        df.select(*spark.table(name).columns).write.insertInto(name, overwrite=True)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", previous)


def overwrite(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Replace a whole (small, generated) table."""
    df.write.format(fmt).mode("overwrite").option("partitionOverwriteMode", "static").save(path)


def upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Updates win per key; rows of ``target`` with other keys stay. Missing columns become null.

    Null keys compare equal, so a rerun does not add a second null-key row.
    """
    updates = keep_one(updates, keys)
    fresh = updates.select(*[F.col(k).alias(f"_u_{k}") for k in keys])
    same = [target[k].eqNullSafe(fresh[f"_u_{k}"]) for k in keys]
    return target.join(fresh, same, "left_anti").unionByName(updates, allowMissingColumns=True)


def upsert_slices(spark: SparkSession, path: str, updates: DataFrame, keys: Sequence[str],
                  partition_col: str) -> None:
    """A21 in place for a partitioned table whose rows never change partition.

    Only the touched partitions are read and rewritten. The merged rows are first written to the
    shared scratch folder, because a path cannot be overwritten while it is being read.
    """
    slices = scratch_path(spark, "slices")
    updates.select(F.col(partition_col).alias("_slice")).distinct().write.parquet(slices)
    touched = spark.read.parquet(slices)  # stored, so that its size is known when the join is planned
    stored = evolve(spark.read.parquet(path), updates.schema)
    current = stored.join(touched, stored[partition_col] == F.col("_slice"), "left_semi")
    staged = scratch_path(spark, "upsert")
    upsert(current, updates, keys).write.parquet(staged)
    replace_slices(spark.read.parquet(staged), path, [partition_col])


def upsert_edges(edges: DataFrame, updates: DataFrame) -> DataFrame:
    """Set union over (src, type, dst)."""
    return edges.unionByName(updates).dropDuplicates(["src", "type", "dst"])


def merge_slices(spark: SparkSession, staging_path: str, final_path: str, keys: Sequence[str],
                 batches: Sequence | None = None, partition_col: str = "process_date") -> None:
    """Promote the given batches (default: all that are staged) in one job.

    Rows are deduplicated by key within their batch, then each staged slice replaces its final one.
    """
    rows = spark.read.parquet(staging_path)
    if batches is not None:
        rows = rows.filter(F.col(partition_col).isin(list(batches)))
    replace_slices(keep_one(rows, [partition_col, *keys]), final_path, [partition_col])


def replace_batch_jdbc(df: DataFrame, url: str, table: str, batch, properties: dict[str, str],
                       batch_col: str = "process_date", batch_size: int = 500) -> None:
    """Delete one batch in a database table, then append it.

    Needs the database's driver on the class path; connections follow ``properties``.
    """
    jvm = df.sparkSession._jvm
    jvm.java.lang.Class.forName(properties["driver"])
    settings = jvm.java.util.Properties()
    for key, value in properties.items():
        settings.setProperty(key, value)
    connection = jvm.java.sql.DriverManager.getConnection(url, settings)
    try:
        statement = connection.prepareStatement(f"DELETE FROM {table} WHERE {batch_col} = ?")
        statement.setDate(1, jvm.java.sql.Date.valueOf(batch.isoformat()))
        statement.executeUpdate()
        statement.close()
    finally:
        connection.close()
    df.write.jdbc(url, table, mode="append", properties={**properties, "batchsize": str(batch_size)})
