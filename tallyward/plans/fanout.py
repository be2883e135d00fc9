"""Follow-up writers for changed silver days (L3): star, model features, area features, graph."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.functions.keys import location_key
from tallyward.functions.taxonomy import TAXONOMY_COLUMNS
from tallyward.operators import graph
from tallyward.operators.dedupe import keep_latest
from tallyward.operators.dimensions import (
    DAYS_AHEAD, DAYS_BACK, crime_type_dimension, date_dimension, location_dimension, time_of_day_dimension,
)
from tallyward.operators.features import LOOKAHEAD_DAYS, LOOKBACK_DAYS, area_features
from tallyward.operators.layout import stage
from tallyward.operators.quality import NODE_KEYS
from tallyward.plans.star import FACT_TABLES, build_facts
from tallyward.schema import SILVER_DDL, struct_of
from tallyward.sources.bucket_log import BUCKETS, BucketLog, folders, slice_values
from tallyward.sources.tables import clear_slices, overwrite, replace_slices

#: The silver columns whose distinct values make up a dimension.
MEMBERS = {
    "dim_location": ["beat", "district", "ward", "community_area", "location_description", "block", "district_name"],
    "dim_crime_type": ["primary_type", "description", "iucr", *TAXONOMY_COLUMNS],
}


class MemberCounts:
    """How many incidents stand behind each member of a dimension, kept up from the changed days alone.

    ``<dimension>_days`` holds the members of each stored day with their counts, ``<dimension>_refs`` logs what each batch
    changed, bucketed by the dimension's key. A batch logs the difference between the new and the stored days first and replaces the
    days afterwards, so a batch that runs again after a failure finds its difference logged.
    """

    def __init__(self, spark: SparkSession, base: str, name: str, key_method: str, buckets: int):
        self.spark, self.base, self.name, self.members, self.key_method = spark, base, name, MEMBERS[name], key_method
        self.key = "location_key" if name == "dim_location" else "crime_type_key"
        kinds = {f.name: f.dataType.simpleString() for f in struct_of(SILVER_DDL)}
        columns = ", ".join(f"{c} {kinds[c]}" for c in self.members)
        keyed = "" if self.key in self.members else f", {self.key} bigint"
        self.log = BucketLog(spark, f"{base}/{name}_refs", f"{columns}{keyed}, n bigint", self.key, buckets)

    def of_days(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("process_date", *self.members).agg(F.count(F.lit(1)).alias("n"))

    def keyed(self, rows: DataFrame) -> DataFrame:
        return rows if self.key in rows.columns else rows.withColumn(self.key, location_key(self.key_method))

    def update(self, changed: DataFrame, emptied: DataFrame, batch_id: int) -> None:
        days_path = f"{self.base}/{self.name}_days"
        after = stage(self.of_days(changed), "members")
        if not self.log.has(batch_id):
            delta = after.select(*self.members, "n")
            if folders(self.spark, days_path):
                days = stage(after.select("process_date").union(emptied).distinct(), "touched-days")
                stored = self.spark.read.schema(after.schema).parquet(days_path)
                before = stored.join(days, "process_date", "left_semi")
                delta = delta.unionByName(before.select(*self.members, (-F.col("n")).alias("n")))
            delta = delta.groupBy(*self.members).agg(F.sum("n").alias("n")).filter("n <> 0")
            self.log.append(self.keyed(delta), batch_id)
        self.log.compact(lambda rows: rows.groupBy(*[c for c in rows.columns if c not in ("n", "batch")]).agg(F.sum("n").alias("n"))
                         .filter("n <> 0"), before=batch_id)
        replace_slices(after, days_path, ["process_date"])
        clear_slices(self.spark, days_path, "process_date", emptied)

    def totals(self, batch_id: int) -> tuple[DataFrame, list[int]]:
        """Members of the buckets that a batch changed, with their counts before and after it; and these buckets."""
        buckets = self.log.touched(self.log.read(only=batch_id).select(self.key))
        older = F.when(F.col("batch") != batch_id, F.col("n")).otherwise(0)
        sums = self.log.read(buckets).groupBy(*self.members).agg(F.sum(older).alias("before"), F.sum("n").alias("after"))
        return stage(sums, "members"), buckets

    def dimension(self, members: DataFrame, stamp: date) -> DataFrame:
        rows = location_dimension(members, stamp, self.key_method, unknown_member=True) if self.name == "dim_location" \
            else crime_type_dimension(members, stamp, self.key_method)
        return rows.withColumn("bucket", self.log.bucket())

    def write(self, members: DataFrame, buckets: list[int], stamp: date) -> None:
        """The dimension rows of the buckets, from members that are all theirs."""
        rows = stage(self.dimension(members, stamp), "dimension")
        replace_slices(rows, f"{self.base}/{self.name}", ["bucket"])
        left = rows.select("bucket").distinct().collect()
        empty = sorted(set(buckets) - {r["bucket"] for r in left})
        if empty:
            clear_slices(self.spark, f"{self.base}/{self.name}", "bucket", self.spark.createDataFrame([(b,) for b in empty], "bucket int"))


def star_writer(base: str, key_method: str = "xxhash64", buckets: int = BUCKETS):
    """Facts of the changed days and the dimension rows whose members came or went with them; silver is not read again.

    Dimensions are stored in buckets of their key and only the buckets of changed members are replaced, first with the members of
    before and after, then, when the facts are in place, without those that no incident has any more. So a
    reader finds a row for every fact at any time, also after a failure in between. The date dimension is stored in years; a batch adds
    the years it needs, the hours of the day are written once.
    """

    def write(changed: DataFrame, emptied: DataFrame, batch_id: int) -> None:
        spark = changed.sparkSession
        span = changed.agg(F.min("process_date").alias("first"), F.max("process_date").alias("last")).first()
        stamp = span["last"] or emptied.agg(F.max("process_date")).first()[0]
        counts = {name: MemberCounts(spark, base, name, key_method, buckets) for name in MEMBERS}
        gone = {}
        for name, kept in counts.items():
            kept.update(changed, emptied, batch_id)
            members, moved = kept.totals(batch_id)
            if moved:
                kept.write(members.filter("before > 0 or after > 0").select(*kept.members), moved, stamp)
            if not members.filter("after <= 0").isEmpty():
                gone[name] = members.filter("after > 0").select(*kept.members), moved
        if span["last"] is not None:
            _add_years(spark, f"{base}/dim_date", span["first"], span["last"])
            if not folders(spark, f"{base}/dim_time_of_day"):
                overwrite(time_of_day_dimension(spark, stamp), f"{base}/dim_time_of_day")
            dims = {name: spark.read.parquet(f"{base}/{name}") for name in ("dim_date", "dim_time_of_day", "dim_crime_type")}
            place = counts["dim_location"].log
            near = place.touched(changed.select(location_key(key_method)))
            dims["dim_location"] = spark.read.parquet(f"{base}/dim_location").filter(F.col("bucket").isin(near))
            for name, rows in build_facts(changed, dims, F.col("date"), key_method).items():
                replace_slices(rows.withColumn("process_date", F.col("process_date").cast("date")), f"{base}/{name}",
                               ["process_date"])
        for name in FACT_TABLES:
            clear_slices(spark, f"{base}/{name}", "process_date", emptied)
        for name, (members, moved) in gone.items():
            counts[name].write(members, moved, stamp)

    return write


def _add_years(spark: SparkSession, path: str, first: date, last: date) -> None:
    """The years around the given days that the stored date dimension lacks."""
    low, high = first - timedelta(days=DAYS_BACK), last + timedelta(days=DAYS_AHEAD)
    missing = sorted(set(range(low.year, high.year + 1)) - set(map(int, slice_values(spark, path, "year_slice"))))
    if not missing:
        return
    anchor, end = date(missing[0], 1, 1), date(missing[-1], 12, 31)
    rows = date_dimension(spark.range(1).select(F.lit(anchor).alias("anchor")), 0, (end - anchor).days)
    rows = rows.withColumn("year_slice", F.col("year")).filter(F.col("year").isin(missing))
    stamp = F.lit(last).cast("date")
    replace_slices(rows.withColumns({"created_date": stamp, "updated_date": stamp}), path, ["year_slice"])


def ml_feature_writer(path: str):
    """Incident-level model features: process_date, numeric community_area and crime_category."""

    def write(changed: DataFrame, emptied: DataFrame, batch_id: int) -> None:
        rows = changed.select(
            F.to_date("process_date").alias("process_date"),
            F.col("community_area").try_cast("int").alias("community_area"), "crime_category")
        replace_slices(rows, path, ["process_date"])
        clear_slices(changed.sparkSession, path, "process_date", emptied)

    return write


def affected_days(days: DataFrame, back: int = LOOKBACK_DAYS, ahead: int = LOOKAHEAD_DAYS) -> DataFrame:
    """The days (``process_date``) whose feature window holds one of ``days``; with the two numbers exchanged, the days their windows
    hold."""
    reach = F.sequence(F.date_sub("process_date", ahead), F.date_add("process_date", back))
    return days.select(F.explode(reach).alias("process_date")).distinct()


def area_feature_writer(silver_path: str, path: str):
    """Features of every day whose window holds a changed or emptied day, in one job however the days are scattered. Only the
    slices in the windows of these days are read."""

    def write(changed: DataFrame, emptied: DataFrame, batch_id: int) -> None:
        spark = changed.sparkSession
        stored = slice_values(spark, silver_path, "process_date")
        due = stage(affected_days(changed.select("process_date").union(emptied).distinct()), "affected-days")
        span = due.agg(F.min("process_date").alias("first"), F.max("process_date").alias("last")).first()
        newest = max(map(date.fromisoformat, stored), default=None)
        left = due
        if newest is not None and span["first"] <= newest:
            last = min(span["last"], newest)
            window = stage(affected_days(due, LOOKAHEAD_DAYS, LOOKBACK_DAYS), "window-days")
            silver = spark.read.parquet(silver_path).join(window, "process_date", "left_semi")
            rows = area_features(silver, span["first"], last, by_slice=True).join(due, "process_date", "left_semi")
            rows = stage(rows, "area-features")
            replace_slices(rows, path, ["process_date"])
            left = due.join(rows.select("process_date").distinct(), "process_date", "left_anti")
        clear_slices(spark, path, "process_date", left)

    return write


def graph_writer(base: str, key_method: str = "xxhash64"):
    """Node and edge rows of the changed days, one slice per incident day and table.

    ``read_graph`` gives the current graph: the newest slice wins per node key.
    """

    def write(changed: DataFrame, emptied: DataFrame, batch_id: int) -> None:
        source = graph.graph_source(changed, key_method).withColumn("batch_date", F.to_date("date"))
        source = source.filter(F.col("batch_date").isNotNull())
        rows = graph.incidents(source)
        tables = {
            "Crime": graph.crime_nodes(rows, "batch_date"),
            "Date": graph.date_nodes(rows).withColumn("batch_date", F.col("full_date")),
            "Location": _per_day(source, graph.location_nodes, "location_text_key"),
            "CrimeType": _per_day(source, graph.crime_type_nodes, "crime_type_key"),
            "edges": graph.edges(rows, "batch_date"),
        }
        for name, df in tables.items():
            replace_slices(df, f"{base}/{name}", ["batch_date"])
            clear_slices(changed.sparkSession, f"{base}/{name}", "batch_date", emptied)

    return write


def _per_day(source: DataFrame, build, key: str) -> DataFrame:
    """Nodes of every key, attached to each day on which the key occurs."""
    return build(source).join(source.select(key, "batch_date").distinct(), key)


def read_graph(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """The stored graph: latest slice per node key, distinct edges of the latest slice per incident."""
    out = {}
    for name, key in NODE_KEYS.items():
        stored = spark.read.parquet(f"{base}/{name}")
        rest = [c for c in stored.columns if c not in (key, "batch_date")]
        order = [F.desc("batch_date"), *[F.asc_nulls_last(c) for c in rest]]
        out[name] = keep_latest(stored, [key], order).drop("batch_date")
    stored = spark.read.parquet(f"{base}/edges")
    out["edges"] = keep_latest(stored, ["src", "type"], [F.desc("batch_date"), F.asc("dst")]).drop("batch_date")
    return out
