"""One key, cell, area or thread owning a third of all rows: results stay whole."""

from datetime import date

from pyspark.sql import functions as F

from tallyward.operators.facts import star_rollup
from tallyward.operators.features import area_features
from tallyward.operators.messages import citations
from tallyward.operators.spatial import locate
from tallyward.sources.boundaries import boundary_layer

N = 9_000
DAY = date(2026, 3, 15)


def rows(spark):
    """A third of the ids share one value, the rest are spread."""
    return spark.range(N).withColumn("hot", F.col("id") % 3 == 0)


def test_hot_cell_is_salted(spark, monkeypatch):
    layer = boundary_layer(spark.createDataFrame(
        [("1", "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))"), ("2", "POLYGON ((3 3, 9 3, 9 9, 3 9, 3 3))")], "ward string, geometry string"), "ward")
    points = rows(spark).select(
        "id", "hot", F.when(F.col("hot"), 3.5).otherwise(F.col("id") % 97 / 10.0).alias("longitude"),
        F.when(F.col("hot"), 3.5).otherwise(F.col("id") % 89 / 10.0).alias("latitude"))
    bounded = locate(points, layer, on_overlap="all")
    monkeypatch.setattr("tallyward.operators.spatial.POINTS_PER_SALT", 500)
    large = locate(points, layer, on_overlap="all", max_broadcast_cells=0)
    unnamed = locate(points, layer, on_overlap="all", point_id=None, max_broadcast_cells=0)
    count = lambda df: {(r["poly_id"], r["n"]) for r in df.groupBy("poly_id").agg(F.count("*").alias("n")).collect()}
    assert count(bounded) == count(large) == count(unnamed)
    assert bounded.filter("hot").count() == 2 * (N // 3)
    plan = large._jdf.queryExecution().executedPlan().toString()
    assert "_salt" in plan


def test_hot_area_is_counted_whole(spark):
    silver = rows(spark).select(
        F.when(F.col("hot"), "8").otherwise((F.col("id") % 77 + 1).cast("string")).alias("community_area"),
        F.lit("2026-03-15 10:00:00").cast("timestamp").alias("date"), (F.col("id") % 2 == 0).alias("arrest"), F.lit(True).alias("domestic"),
        *[F.lit(1).alias(c) for c in ("violent_crime_flag", "property_crime_flag", "drug_crime_flag", "weapon_crime_flag")])
    out = area_features(silver, DAY)
    assert out.agg(F.sum("count_1d")).first()[0] == N
    hot = out.filter("area_id = 8").first()
    assert hot["count_1d"] >= N // 3 and hot["violent_count_7d"] == hot["count_7d"]


def test_hot_location_in_the_star_query(spark):
    fact = rows(spark).select(
        F.col("id").cast("string").alias("incident_id"), F.when(F.col("hot"), 0).otherwise(F.col("id")).alias("location_key"),
        F.lit(1).cast("bigint").alias("crime_type_key"), F.lit(20260315).alias("date_key"))
    places = rows(spark).select(F.col("id").alias("location_key"), F.lit(5).alias("community_area"), F.lit(DAY).alias("updated_date"))
    types = spark.createDataFrame([(1, 1, DAY)], "crime_type_key bigint, violent_crime_flag int, updated_date date")
    days = spark.createDataFrame([(20260315, 2026)], "date_key int, year int")
    row = star_rollup(fact, places, days, types).first()
    assert (row["total"], row["violent_crimes"]) == (N, N)


def test_hot_thread_keeps_every_distinct_citation(spark):
    url = F.when(F.col("hot"), "same").otherwise(F.concat(F.lit("u"), F.col("id").cast("string")))
    log = rows(spark).select(
        F.lit("t").alias("thread_id"), F.col("id").alias("position"), F.lit("tool").alias("role"), F.lit("web_search").alias("tool_name"),
        F.concat(F.lit("["), F.to_json(F.struct(url.alias("url"))), F.lit("]")).alias("content"))
    assert citations(log).count() == N - N // 3 + 1
