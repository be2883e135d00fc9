"""Property graph as node and edge tables.

Nodes: one table per label. Edges: one table (src, type, dst) with text keys.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.functions.keys import location_text_key
from tallyward.functions.taxonomy import ensure_taxonomy
from tallyward.operators.dedupe import keep_latest_repeated, keep_one
from tallyward.schema import OPTIONAL_COLUMNS, evolve

# Relationship types, retention, and the span of dates that can be asked for.
OCCURRED_ON, OCCURRED_AT, IS_OF_TYPE = "OCCURRED_ON", "OCCURRED_AT", "IS_OF_TYPE"
RETENTION_DAYS = 365
COVERAGE_START = date(2025, 3, 1)
COVERAGE_LAG_DAYS = 10
PLACE_IDS = {"beat": "beat_id", "district": "district_id", "ward": "ward_id", "community_area": "community_area_id"}


def graph_source(silver: DataFrame, key_method: str = "xxhash64") -> DataFrame:
    """Silver with the optional columns, the taxonomy and the two text keys in place."""
    df = ensure_taxonomy(evolve(silver, OPTIONAL_COLUMNS["graph"]), key_method=key_method)
    return df.withColumns({
        "location_text_key": location_text_key(),
        "date_label": F.to_date("date").cast("string"),
    })


def _place_columns():
    return [F.col(c).alias(a) for c, a in PLACE_IDS.items()]


def incidents(source: DataFrame) -> DataFrame:
    """One row per case number, the newest incident; every crime node and edge comes from this row."""
    lead = [F.desc_nulls_last("date"), F.desc_nulls_last("id")]
    rest = [F.asc_nulls_last(c) for c in ("location_text_key", "crime_type_key", "updated_on")]
    return keep_latest_repeated(source.filter(F.col("case_number").isNotNull()), ["case_number"], [*lead, *rest])


def crime_nodes(rows: DataFrame, *extra: str) -> DataFrame:
    """14 properties, and any ``extra`` columns."""
    return rows.select(*extra, "case_number", "primary_type", "description", "crime_category", "crime_offense_group",
                       "crime_offense_subtype", "arrest", "domestic", *_place_columns(), "district_name",
                       "community_area_name")


def date_nodes(rows: DataFrame) -> DataFrame:
    """One node per incident day in the batch."""
    day = F.col("full_date")
    return rows.select(F.to_date("date").alias("full_date")).filter(day.isNotNull()).distinct().select(
        day.cast("string").alias("date_label"), F.date_format(day, "yyyyMMdd").alias("yyyymmdd_key"), "full_date",
        F.weekday(day).alias("day_of_week"), F.month(day).alias("month"), F.year(day).alias("year"))


def location_nodes(source: DataFrame) -> DataFrame:
    """One node per text key."""
    rows = source.select("location_text_key", "latitude", "longitude", "location_description", "block",
                         *_place_columns(), "district_name", "community_area_name")
    return keep_one(rows, ["location_text_key"])


def crime_type_nodes(source: DataFrame) -> DataFrame:
    """One node per offense key."""
    rows = source.select("crime_type_key", "crime_offense_label", "crime_category", "crime_offense_group",
                         "crime_offense_subtype", "violent_crime_flag", "property_crime_flag", "drug_crime_flag",
                         "weapon_crime_flag")
    return keep_one(rows, ["crime_type_key"])


def edges(rows: DataFrame, *extra: str) -> DataFrame:
    """Three edges per incident row, unfolded in place. Rows are unique per case number already."""
    links = F.array(
        F.struct(F.lit(OCCURRED_ON).alias("type"), F.col("date_label").alias("dst")),
        F.struct(F.lit(OCCURRED_AT).alias("type"), F.col("location_text_key").alias("dst")),
        F.struct(F.lit(IS_OF_TYPE).alias("type"), F.col("crime_type_key").cast("string").alias("dst")),
    )
    out = rows.select(*extra, F.col("case_number").alias("src"), F.explode(links).alias("e")).select(
        *extra, "src", "e.type", "e.dst")
    return out.filter(F.col("dst").isNotNull())


def build_graph(silver: DataFrame, key_method: str = "xxhash64") -> dict[str, DataFrame]:
    """All node and edge tables of a batch."""
    source = graph_source(silver, key_method)
    rows = incidents(source)
    return {
        "Crime": crime_nodes(rows), "Date": date_nodes(rows), "Location": location_nodes(source),
        "CrimeType": crime_type_nodes(source), "edges": edges(rows),
    }


def expired_dates(graph: dict[str, DataFrame], today: date, retention_days: int = RETENTION_DAYS,
                  max_dates: int | None = None) -> DataFrame:
    """Date labels strictly older than the cutoff that have incidents; optionally only the oldest ones.

    Dates without incidents are not returned: they survive a prune.
    """
    cutoff = (today - timedelta(days=retention_days)).isoformat()
    old = graph["edges"].filter((F.col("type") == OCCURRED_ON) & (F.col("dst") < cutoff))
    labels = old.select(F.col("dst").alias("date_label")).distinct()
    return labels if max_dates is None else labels.orderBy("date_label").limit(max_dates)


def prune(graph: dict[str, DataFrame], today: date, retention_days: int = RETENTION_DAYS,
          max_dates: int | None = None) -> dict[str, DataFrame]:
    """Remove expired dates, their incidents and every edge of those incidents.

    A batch limit is only for working a backlog off in several runs; by default all go at once.
    """
    labels = expired_dates(graph, today, retention_days, max_dates)
    on = graph["edges"].filter(F.col("type") == OCCURRED_ON)
    gone = on.join(labels, on["dst"] == labels["date_label"], "left_semi").select(F.col("src").alias("_gone")).distinct()
    keep_edges = graph["edges"].join(gone, graph["edges"]["src"] == gone["_gone"], "left_anti")
    keep_crimes = graph["Crime"].join(gone, graph["Crime"]["case_number"] == gone["_gone"], "left_anti")
    keep_dates = graph["Date"].join(labels, "date_label", "left_anti")
    return {**graph, "edges": keep_edges, "Crime": keep_crimes, "Date": keep_dates}


def dangling(graph: dict[str, DataFrame]) -> DataFrame:
    """(label, key) of Location and CrimeType nodes without an edge."""
    targets = graph["edges"].filter(F.col("type").isin(OCCURRED_AT, IS_OF_TYPE)).select("type", "dst").distinct()

    def unlinked(label: str, key: str, edge_type: str) -> DataFrame:
        nodes = graph[label].select(F.lit(label).alias("label"), F.col(key).cast("string").alias("key"))
        linked = targets.filter(F.col("type") == edge_type).select("dst")
        return nodes.join(linked, nodes["key"] == linked["dst"], "left_anti")

    return (unlinked("Location", "location_text_key", OCCURRED_AT)
            .unionByName(unlinked("CrimeType", "crime_type_key", IS_OF_TYPE)))


def drop_dangling(graph: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """The graph without dangling nodes, and the deleted count per label."""
    lost = dangling(graph)

    def without(label: str, key: str) -> DataFrame:
        keys = lost.filter(F.col("label") == label).select("key")
        nodes = graph[label]
        return nodes.join(keys, nodes[key].cast("string") == keys["key"], "left_anti")

    cleaned = {**graph, "Location": without("Location", "location_text_key"),
               "CrimeType": without("CrimeType", "crime_type_key")}
    return cleaned, lost.groupBy("label").agg(F.count(F.lit(1)).alias("deleted_nodes"))


def dated_graph(silver: DataFrame, key_method: str = "xxhash64") -> dict[str, DataFrame]:
    """``build_graph`` with the incident day (``batch_date``) on Crime nodes and edges, the column their tables are sliced by."""
    source = graph_source(silver, key_method).withColumn("batch_date", F.to_date("date"))
    rows = incidents(source)
    return {
        "Crime": crime_nodes(rows, "batch_date"), "Date": date_nodes(rows), "Location": location_nodes(source),
        "CrimeType": crime_type_nodes(source), "edges": edges(rows, "batch_date"),
    }


LINKED = {OCCURRED_AT: ("Location", "location_text_key"), IS_OF_TYPE: ("CrimeType", "crime_type_key")}


def _linked_counts(edge_rows: DataFrame) -> DataFrame:
    """(label, key, n): how many of the edges end in each Location and CrimeType node; combined map-side, so a node with a third of
    all edges is one row per task."""
    label = F.create_map(*[F.lit(x) for kind, (name, _) in LINKED.items() for x in (kind, name)])[F.col("type")]
    return (edge_rows.filter(F.col("type").isin(*LINKED)).groupBy(label.alias("label"), F.col("dst").alias("key"))
            .agg(F.count(F.lit(1)).alias("n")))


def node_degrees(graph: dict[str, DataFrame]) -> DataFrame:
    """(label, key, degree) of every Location and CrimeType node, 0 without an edge: the table kept beside the edges."""
    nodes = [graph[name].select(F.lit(name).alias("label"), F.col(key).cast("string").alias("key")) for name, key in LINKED.values()]
    return nodes[0].unionByName(nodes[1]).join(_linked_counts(graph["edges"]), ["label", "key"], "left").select(
        "label", "key", F.coalesce("n", F.lit(0)).alias("degree"))


def changed_degrees(degrees: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """The degree table after edges came and went; only these edges are read. Nodes the table lacks come in with their first edge."""
    changes = [_linked_counts(rows).withColumn("n", F.col("n") * sign) for rows, sign in ((added, 1), (removed, -1)) if rows is not None]
    total = degrees.withColumnRenamed("degree", "n")
    for change in changes:
        total = total.unionByName(change)
    return total.groupBy("label", "key").agg(F.sum("n").alias("degree"))


def prune_days(graph: dict[str, DataFrame], degrees: DataFrame, today: date,
               retention_days: int = RETENTION_DAYS) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """J6, J7, C19 on a ``dated_graph`` with its degree table: (graph, degrees, deleted). What ``prune`` and ``drop_dangling`` leave, but
    the days of incidents and edges are compared with the cutoff, so only slices before it are read to see what goes, and
    dangling nodes are those whose degree reaches zero. ``deleted`` has the (label, key) of the nodes dropped."""
    cutoff = F.lit(today - timedelta(days=retention_days))
    stays = F.coalesce(F.col("batch_date") >= cutoff, F.lit(True))
    removed = graph["edges"].filter(F.col("batch_date") < cutoff)
    labels = removed.filter(F.col("type") == OCCURRED_ON).select(F.col("dst").alias("date_label")).distinct()
    left = changed_degrees(degrees, removed=removed)
    deleted = left.filter("degree <= 0").select("label", "key")
    kept = {**graph, "edges": graph["edges"].filter(stays), "Crime": graph["Crime"].filter(stays),
            "Date": graph["Date"].join(labels, "date_label", "left_anti")}
    for name, key in LINKED.values():
        gone = deleted.filter(F.col("label") == name).select(F.col("key").alias("_gone"))
        kept[name] = graph[name].join(gone, F.col(key).cast("string") == F.col("_gone"), "left_anti")
    return kept, left.filter("degree > 0"), deleted


def clamp_coverage(df: DataFrame, day_col: str, today: date, start: date = COVERAGE_START,
                   lag_days: int = COVERAGE_LAG_DAYS) -> DataFrame:
    """Only the days that may be asked for."""
    return df.filter(F.col(day_col).between(F.lit(start), F.lit(today - timedelta(days=lag_days))))


def text_contains(column: str, needle: str):
    """Case-insensitive containment."""
    return F.lower(F.col(column)).contains(needle.lower())


def violent_between(graph: dict[str, DataFrame], first: str, last: str) -> DataFrame:
    """Number of violent incidents with a date label in [first, last].

    Types are matched on per-type counts, so a frequent type is one row per task at the join.
    """
    e = graph["edges"]
    on = e.filter((F.col("type") == OCCURRED_ON) & F.col("dst").between(first, last)).select("src")
    typed = e.filter(F.col("type") == IS_OF_TYPE).select("src", F.col("dst").alias("type_key"))
    per_type = on.join(typed, "src").groupBy("type_key").agg(F.count(F.lit(1)).alias("n"))
    violent = graph["CrimeType"].filter(F.col("violent_crime_flag") == 1).select(
        F.col("crime_type_key").cast("string").alias("type_key"))
    return per_type.join(violent, "type_key").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def group_in_area(graph: dict[str, DataFrame], area_name: str, offense_group: str) -> DataFrame:
    """Incidents of an offense group in areas whose name contains the text."""
    e = graph["edges"].filter(F.col("type") == OCCURRED_AT)
    chosen = graph["Crime"].filter(text_contains("community_area_name", area_name)
                                   & (F.col("crime_offense_group") == offense_group))
    return (e.join(chosen, e["src"] == chosen["case_number"], "left_semi")
            .agg(F.count(F.lit(1)).alias("n")))


def month_trend(graph: dict[str, DataFrame], first: str) -> DataFrame:
    """Incidents per month from a date label on. Counted per day before the date join."""
    per_day = (graph["edges"].filter((F.col("type") == OCCURRED_ON) & (F.col("dst") >= first))
               .groupBy(F.col("dst").alias("date_label")).agg(F.count(F.lit(1)).alias("n")))
    return (per_day.join(graph["Date"].select("date_label", "year", "month"), "date_label")
            .groupBy("year", "month").agg(F.sum("n").alias("incidents")).orderBy("year", "month"))
