"""Batch jobs over a log of queries and tool messages (M1-M7).

A message log has one row per message: thread_id, position, role, tool_name, content and, for tool
traffic, call_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.functions.guardrails import SUMMARY_LIMIT, normalize_query, query_class, result_summary, strip_unicode
from tallyward.operators.dedupe import keep_latest

# Fixed values.
WEB_TOOLS = ["langsearch", "web_search"]
GRAPH_TOOL = "neo4j"
DETAIL_LIMIT = 2000
# Display texts, which a deployment sets to its own wording.
GRAPH_TITLE = "Crime Knowledge Graph"
GRAPH_EMPTY_DETAIL = "Queried the crime knowledge graph."


def guard_queries(df: DataFrame, query_col: str = "query", literal_passes: bool = False) -> DataFrame:
    """M1-M4: add ``normalized_query`` and ``query_class``."""
    out = df.withColumn("normalized_query", normalize_query(F.col(query_col), literal_passes))
    return out.withColumn("query_class", query_class(F.col("normalized_query")))


def summarize_results(df: DataFrame, content_col: str = "content", limit: int = SUMMARY_LIMIT) -> DataFrame:
    """M7: add ``summary``."""
    return df.withColumn("summary", result_summary(F.col(content_col), limit))


def citations(log: DataFrame, graph_title: str = GRAPH_TITLE,
              graph_empty_detail: str = GRAPH_EMPTY_DETAIL, detail_limit: int = DETAIL_LIMIT,
              cut_identity: bool = False) -> DataFrame:
    """M5: (thread_id, position, item, source, url, title, detail); position and item give the order.

    Details are cut for display to ``detail_limit`` characters. A web result counts once per URL, a graph result once
    per whole text, or with ``cut_identity`` once per displayed text. Both rules keep the first
    occurrence only, which Spark also applies before the shuffle, so a URL that a thread repeats
    without end does not gather in one task.
    """
    tool = F.lower(F.coalesce(F.col("tool_name"), F.lit("")))
    content = F.coalesce(F.col("content"), F.lit(""))
    named_web = F.lit(False)
    for name in WEB_TOOLS:
        named_web = named_web | tool.contains(name)
    looks_web = strip_unicode(content).startswith("[") & content.contains('"url"')
    tools = log.filter(F.col("role") == "tool").withColumns({"_tool": tool, "_text": content})

    items = tools.filter(named_web | looks_web).select(
        "thread_id", "position", F.posexplode(F.from_json("_text", "array<string>")).alias("item", "_raw")
    ).withColumn("m", F.from_json("_raw", "map<string,string>"))
    title, detail = _first_filled("name", "title"), _first_filled("snippet", "summary")
    web = items.select(
        "thread_id", "position", "item", F.lit("web").alias("source"), F.col("m")["url"].alias("url"),
        title.alias("title"), F.coalesce(detail, F.lit("")).alias("_whole"),
    ).filter(F.coalesce(F.col("url"), F.lit("")) != "")

    text = strip_unicode(F.col("_text"))
    graph = tools.filter(F.col("_tool").contains(GRAPH_TOOL)).select(
        "thread_id", "position", F.lit(2_147_483_647).alias("item"), F.lit("graph").alias("source"),
        F.lit(None).cast("string").alias("url"), F.lit(graph_title).alias("title"),
        F.when(text == "", graph_empty_detail).otherwise(text).alias("_whole"))

    shown = F.substring("_whole", 1, detail_limit)
    own = shown if cut_identity else F.sha2("_whole", 256)
    both = web.unionByName(graph).withColumn("detail", shown).withColumn(
        "_identity", F.when(F.col("source") == "web", F.col("url")).otherwise(own)).drop("_whole")
    first = keep_latest(both, ["thread_id", "source", "_identity"], [F.asc("position"), F.asc("item")])
    return first.select("thread_id", "position", "item", "source", "url", "title", "detail")


def _first_filled(*names: str):
    return F.coalesce(*[F.nullif(F.col("m")[n], F.lit("")) for n in names])


def dangling_calls(calls: DataFrame, results: DataFrame) -> DataFrame:
    """M6: (thread_id, call_id, tool_name) of calls without a later result in their thread."""
    made = keep_latest(calls.filter(F.coalesce(F.col("call_id"), F.lit("")) != ""), ["thread_id", "call_id"],
                       [F.desc("position"), F.asc_nulls_last("tool_name")])
    answered = results.groupBy(F.col("thread_id").alias("_t"), F.col("call_id").alias("_c")).agg(
        F.max("position").alias("_at"))
    same = ((made["thread_id"] == answered["_t"]) & (made["call_id"] == answered["_c"])
            & (answered["_at"] > made["position"]))
    return made.join(answered, same, "left_anti").select(
        "thread_id", "call_id", F.coalesce("tool_name", F.lit("unknown_tool")).alias("tool_name"))
