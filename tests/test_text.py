"""Text rules (M1-M7)."""

import json

import pytest
from helpers import dicts
from pyspark.sql import functions as F

from tallyward.functions import guardrails as gr
from tallyward.operators import messages


def apply(spark, fn, text):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t")).alias("r")).first()["r"]


@pytest.mark.parametrize("fn, text, want", [
    (gr.strip_comments, "MATCH (n) -- note\nRETURN n", "MATCH (n) \nRETURN n"),
    (gr.strip_comments, "a /* x\ny */ b /* z */", "a  b"),
    (gr.strip_comments, "a\n \t\n\n b", "a\n b"),
    (gr.repair_apostrophes, "n CONTAINS 'O'Hare'", "n CONTAINS 'O\\'Hare'"),
    (gr.repair_apostrophes, "n starts  with 'O'Hare' AND m ENDS WITH 'D'Arc'", "n starts  with 'O\\'Hare' AND m ENDS WITH 'D\\'Arc'"),
    (gr.repair_apostrophes, "n CONTAINS 'ok'", "n CONTAINS 'ok'"),
    (gr.repair_apostrophes, "n XCONTAINS 'O'Hare'", "n XCONTAINS 'O'Hare'"),
    (gr.repair_flag_tests, "CASE WHEN NOT violent THEN 1", "CASE WHEN violent <> 1 THEN 1"),
    (gr.repair_flag_tests, "case when c.violent then 1", "case WHEN c.violent = 1 THEN 1"),
    (gr.repair_flag_tests, "WHEN a = 1 THEN", "WHEN a = 1 THEN"),
    (gr.query_class, "MERGE (n)", "write"),
    (gr.query_class, "call  db.labels()", "write"),
    (gr.query_class, " \n ", "empty"),
    (gr.query_class, None, "empty"),
    (gr.query_class, "MATCH (n:Settlement) RETURN n", "read_only"),
    (gr.query_class, "MATCH (n) WHERE n.x = 'drop' RETURN n", "write"),
    (gr.result_summary, "  ", "No results returned."),
    (gr.result_summary, "[1, 2, 3]", "Found 3 result(s)."),
    (gr.result_summary, "[1, 2", "[1, 2"),
    (gr.result_summary, "a Neo4j failure", gr.RETRY_LATER),
    (gr.result_summary, "x" * 120, "x" * 120),
    (gr.result_summary, "x" * 121, "x" * 117 + "…"),
])
def test_rules(spark, fn, text, want):
    assert apply(spark, fn, text) == want


def test_repeated_apostrophes_take_several_passes(spark):
    assert apply(spark, gr.repair_apostrophes, "CONTAINS 'a'b'c'") == "CONTAINS 'a\\'b\\'c'"
    escaped = "CONTAINS 'O\\'Hare'"
    assert apply(spark, gr.repair_apostrophes, escaped) == escaped


def test_repairs_go_on_until_none_is_left(spark):
    text = "CONTAINS '" + "'".join("abcdefgh") + "'"
    assert apply(spark, gr.repair_apostrophes, text) == "CONTAINS '" + "\\'".join("abcdefgh") + "'"
    assert apply(spark, lambda c: gr.repair_apostrophes(c, max_passes=2), text).count("\\") == 2


def test_plain_passes_escape_again(spark):
    got = apply(spark, lambda c: gr.repair_apostrophes(c, literal_passes=True), "CONTAINS 'O'Hare'")
    assert got == "CONTAINS 'O" + 5 * "\\" + "'Hare'"


def test_long_literals_do_not_exhaust_the_stack(spark):
    text = "CONTAINS '" + "\\x" * 50_000 + "' " + "y" * 50_000
    assert apply(spark, gr.repair_apostrophes, text) == text


def test_long_inner_white_space_is_linear(spark):
    text = "  a" + " " * 300_000 + "b \u00a0\n"
    assert apply(spark, gr.strip_unicode, text) == text[2:-3]
    assert apply(spark, gr.strip_unicode, " " * 300_000) == ""


def test_guarded_log(spark):
    df = spark.createDataFrame([(1, "MATCH (n) /* MERGE */ RETURN n"), (2, "-- only"), (3, "DELETE n")], "id int, query string")
    assert {r["id"]: r["query_class"] for r in messages.guard_queries(df).collect()} == {1: "read_only", 2: "empty", 3: "write"}


def test_citations(spark):
    web = json.dumps([{"url": "u", "name": "n", "snippet": "s"}, {"url": "u", "title": "later"}, {"name": "no url"}, 5,
                      {"url": "v", "title": "t", "summary": "y" * 3000}])
    rows = [
        ("t", 0, "user", None, web), ("t", 1, "tool", "LangSearch_web_search", web), ("t", 2, "tool", "other", ' [{"url":"w"}]'),
        ("t", 3, "tool", "read_neo4j_cypher", " 12 rows "), ("t", 4, "tool", "read_neo4j_cypher", "12 rows"),
        ("t", 5, "tool", "read_neo4j_cypher", ""), ("t", 6, "tool", "web_search", "not json"), ("s", 0, "tool", "web_search", web),
    ]
    df = spark.createDataFrame(rows, "thread_id string, position int, role string, tool_name string, content string")
    got = sorted(dicts(messages.citations(df)), key=lambda r: (r["thread_id"], r["position"], r["item"]))
    mine = [r for r in got if r["thread_id"] == "t"]
    assert [(r["source"], r["url"], r["title"]) for r in mine] == [
        ("web", "u", "n"), ("web", "v", "t"), ("web", "w", None), ("graph", None, "Crime Knowledge Graph"),
        ("graph", None, "Crime Knowledge Graph")]
    assert len(mine[1]["detail"]) == 2000 and mine[2]["detail"] == ""
    assert [r["detail"] for r in mine[3:]] == ["12 rows", "Queried the crime knowledge graph."]
    assert len(got) == 7


def test_citations_are_told_apart_by_their_whole_text(spark):
    same = "z" * 2000
    df = spark.createDataFrame([("t", k, "tool", "neo4j", same + end) for k, end in enumerate("aba")],
                               "thread_id string, position int, role string, tool_name string, content string")
    assert [(r["position"], len(r["detail"])) for r in messages.citations(df).orderBy("position").collect()] == [(0, 2000), (1, 2000)]
    assert messages.citations(df, cut_identity=True).count() == 1
    assert {len(r["detail"]) for r in messages.citations(df, detail_limit=7).collect()} == {7}


def test_dangling_calls(spark):
    calls = spark.createDataFrame([("t", 1, "a", "x"), ("t", 3, "b", None), ("t", 5, "a", "x"), ("s", 1, "a", "x"), ("s", 2, "", "x")],
                                  "thread_id string, position int, call_id string, tool_name string")
    results = spark.createDataFrame([("t", 2, "a"), ("s", 9, "a")], "thread_id string, position int, call_id string")
    assert {tuple(r) for r in messages.dangling_calls(calls, results).collect()} == {("t", "a", "x"), ("t", "b", "unknown_tool")}
