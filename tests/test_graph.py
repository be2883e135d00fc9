"""Graph build and maintenance."""

from datetime import date, timedelta

import pytest
from helpers import by, dicts, landing_frame
from pyspark.sql import functions as F

from tallyward.operators import graph as g
from tallyward.operators.quality import NODE_KEYS, duplicate_keys
from tallyward.plans.silver import build_silver
from tallyward.sources.tables import upsert, upsert_edges

TODAY = date(2026, 6, 1)
CUTOFF = TODAY - timedelta(days=365)


def rec(i, day, case=None, kind="THEFT", block="B1"):
    return {"id": str(i), "case_number": case or f"C{i}", "date": f"{day.isoformat()}T10:00:00", "primary_type": kind,
            "description": "x", "iucr": "1", "block": block, "location_description": "STREET"}


@pytest.fixture
def graph(spark):
    rows = [rec(1, CUTOFF), rec(2, CUTOFF - timedelta(days=1), block="OLD"), rec(3, CUTOFF - timedelta(days=400), kind="ROBBERY"),
            rec(4, TODAY, kind="BATTERY"), rec(5, TODAY, case="C4", kind="ROBBERY"), rec(6, TODAY)]
    rows[5]["case_number"] = None
    silver = build_silver(landing_frame(spark, rows), TODAY).withColumn("community_area_name", F.lit("Lincoln Park"))
    return g.build_graph(silver, "md5")


def test_nodes_are_unique_and_deterministic(graph):
    for label, key in NODE_KEYS.items():
        assert duplicate_keys(graph[label], key).count() == 0
    assert len(graph["Crime"].columns) == 14
    assert {r["case_number"] for r in graph["Crime"].collect()} == {"C1", "C2", "C3", "C4"}
    assert by(graph["Crime"], "case_number")["C4"]["primary_type"] == "ROBBERY"
    day = by(graph["Date"], "date_label")[TODAY.isoformat()]
    assert (day["day_of_week"], day["yyyymmdd_key"]) == (0, "20260601")
    assert graph["edges"].count() == 12


def test_rerun_changes_nothing(graph):
    assert upsert_edges(graph["edges"], graph["edges"]).count() == graph["edges"].count()
    for label, key in NODE_KEYS.items():
        assert upsert(graph[label], graph[label], [key]).count() == graph[label].count()


def test_prune_is_strict_and_cleans_dangling(graph):
    lonely = graph["Date"].limit(1).withColumn("date_label", F.lit("2001-01-01"))
    after = g.prune({**graph, "Date": graph["Date"].unionByName(lonely)}, TODAY)
    assert {r["case_number"] for r in after["Crime"].collect()} == {"C1", "C4"}
    assert {r["date_label"] for r in after["Date"].collect()} == {CUTOFF.isoformat(), TODAY.isoformat(), "2001-01-01"}
    assert after["edges"].count() == 6
    cleaned, deleted = g.drop_dangling(after)
    counts = {r["label"]: r["deleted_nodes"] for r in deleted.collect()}
    assert counts["Location"] == 1
    assert not any("OLD" in r["location_text_key"] for r in cleaned["Location"].collect())
    assert g.dangling(cleaned).count() == 0


def test_prune_by_days_and_degrees_leaves_the_same(spark):
    rows = [rec(1, CUTOFF), rec(2, CUTOFF - timedelta(days=1), block="OLD"), rec(3, CUTOFF - timedelta(days=400), kind="ROBBERY"),
            rec(4, TODAY, kind="BATTERY"), rec(5, TODAY, case="C4", kind="ROBBERY"), rec(6, CUTOFF - timedelta(days=9), block="OLD")]
    rows.append(rec(7, TODAY, kind="ARSON") | {"date": None})
    silver = build_silver(landing_frame(spark, rows), TODAY)
    plain, dated = g.build_graph(silver, "md5"), g.dated_graph(silver, "md5")
    degrees = g.node_degrees(dated)
    assert {r["degree"] for r in degrees.filter("key like '%OLD%'").collect()} == {2}
    want, _ = g.drop_dangling(g.prune(plain, TODAY))
    got, left, deleted = g.prune_days(dated, degrees, TODAY)
    for name, df in want.items():
        assert sorted(map(str, got[name].select(df.columns).collect())) == sorted(map(str, df.collect())), name
    lost = g.dangling(g.prune(plain, TODAY))
    assert sorted(map(tuple, deleted.collect())) == sorted(map(tuple, lost.collect())) and deleted.count() > 0
    assert sorted(map(tuple, left.collect())) == sorted(map(tuple, g.node_degrees(got).collect()))
    back = g.changed_degrees(left, added=dated["edges"].join(got["edges"], ["src", "type", "dst"], "left_anti"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, degrees.filter("degree > 0").collect()))


def test_prune_in_steps_reaches_the_same_end(graph):
    step = graph
    for _ in range(2):
        step = g.prune(step, TODAY, max_dates=1)
    whole = g.prune(graph, TODAY)
    assert sorted(map(tuple, step["edges"].collect())) == sorted(map(tuple, whole["edges"].collect()))


def test_counts(graph):
    assert g.violent_between(graph, "2020-01-01", "2030-01-01").first()["n"] == 2
    assert g.violent_between(graph, "2030-01-01", "2031-01-01").first()["n"] == 0
    assert g.group_in_area(graph, "LINCOLN park", "Theft").first()["n"] == 2
    assert g.group_in_area(graph, "hyde", "Theft").first()["n"] == 0
    rows = dicts(g.month_trend(graph, CUTOFF.isoformat()))
    assert [(r["year"], r["month"], r["incidents"]) for r in rows] == [(2025, 6, 1), (2026, 6, 1)]


def test_coverage(spark):
    df = spark.createDataFrame([(date(2025, 2, 28),), (date(2025, 3, 1),), (TODAY - timedelta(days=10),), (TODAY - timedelta(days=9),)], "d date")
    assert g.clamp_coverage(df, "d", TODAY).count() == 2


def test_graph_from_older_silver(spark):
    df = build_silver(landing_frame(spark, [rec(1, TODAY)]), TODAY).drop("district_name", "community_area_name", "ward", "crime_category")
    graph = g.build_graph(df)
    assert graph["Location"].first()["location_text_key"] == "Unknown|Unknown|B1|STREET"
