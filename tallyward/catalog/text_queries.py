"""Query and message logs derived from documents and conversations; whole texts take part."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyward.catalog import inputs
from tallyward.operators import messages
from tallyward.operators.layout import spread

# One logged query per document, in SQL that both engines read. Every text is part of its query.
_NEWLINE = "chr(10)"
QUERY_TEXT = f"""case
  when doc_id % 11 = 0 then '/* ' || replace(text, '*/', '') || ' */ -- ' || source
  else 'MATCH (c:Crime) /* ' || lang || {_NEWLINE} || source || ' */ -- ' || cast(doc_id as string) || {_NEWLINE} || {_NEWLINE}
    || 'WHERE c.name CONTAINS ''O''' || source || ''' AND c.block STARTS  WITH ''a''b''c'' RETURN CASE WHEN NOT c.' || lang
    || ' THEN 1 when violent Then 2 END' || {_NEWLINE} || text
    || case when doc_id % 5 = 0 then {_NEWLINE} || 'merge (n)' when doc_id % 7 = 0 then ' CALL  db.labels()' else '' end end"""


def textlog_guardrails(spark, sf):
    log = spread(inputs.table(spark, sf, "documents")).selectExpr("doc_id", f"{QUERY_TEXT} as query")
    return messages.guard_queries(log).drop("query")


def textlog_literal_passes(spark, sf):
    """The same log with the five plain passes, which escape a repaired quote again."""
    log = spread(inputs.table(spark, sf, "documents")).selectExpr("doc_id", f"{QUERY_TEXT} as query")
    return messages.guard_queries(log, literal_passes=True).drop("query")


_WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"


def _strip(text: str) -> str:
    return rf"regexp_replace({text}, '\A{_WS}+|{_WS}+\z', '', 'g')"


def _guarded(query: str, content: str) -> str:
    q = rf"regexp_replace({query}, '(?s)/\*.*?\*/', '', 'g')"
    q = rf"regexp_replace({q}, '--[^\n]*', '', 'g')"
    q = _strip(rf"regexp_replace({q}, '\n{_WS}*\n', chr(10), 'g')")
    for _ in range(5):
        q = (rf"regexp_replace({q}, '(?i)(\bCONTAINS\b|\bSTARTS\s+WITH\b|\bENDS\s+WITH\b)\s*''({content})''([A-Za-z][^'']*)''', "
             rf"'\1 ''\2\\''\3''', 'g')")
    q = rf"regexp_replace({q}, '(?i)\bWHEN\s+NOT\s+([\w]+(?:\.[\w]+)*)\s+THEN\b', 'WHEN \1 <> 1 THEN', 'g')"
    return rf"regexp_replace({q}, '(?i)\bWHEN\s+([\w]+(?:\.[\w]+)*)\s+THEN\b', 'WHEN \1 = 1 THEN', 'g')"


def _guard_sql(content: str) -> str:
    return rf"""SELECT doc_id, normalized_query, CASE WHEN {_strip('normalized_query')} = '' THEN 'empty'
  WHEN regexp_matches(normalized_query, '(?i)\b(CREATE|MERGE|DELETE|DETACH|SET|REMOVE|DROP)\b|\bcall\s+db\.') THEN 'write'
  ELSE 'read_only' END AS query_class
FROM (SELECT doc_id, {_guarded('query', content)} AS normalized_query FROM (SELECT doc_id, {QUERY_TEXT} AS query FROM documents))"""

# Tool results: plain texts, JSON arrays, blanks and error messages.
RESULT_TEXT = """case when doc_id % 13 = 0 then '  ' when doc_id % 7 = 0 then ' ["' || source || '","' || lang || '",' || cast(doc_id as string) || '] '
  when doc_id % 17 = 0 then text || ' Traceback (most recent call)' else text end"""


def result_summary(spark, sf):
    log = spread(inputs.table(spark, sf, "documents")).selectExpr("doc_id", f"{RESULT_TEXT} as content")
    return messages.summarize_results(log).drop("content")


RESULT_SUMMARY = f"""SELECT doc_id, CASE WHEN t = '' THEN 'No results returned.'
  WHEN regexp_matches(t, '(?i)(neo4j|cypher|gql_status|clienterror|syntaxerror|database|read_neo4j_cypher|traceback|exception)')
    THEN 'Something went wrong on our side. Please try again after a couple of minutes.'
  WHEN json_valid(t) AND json_type(t) = 'ARRAY' THEN 'Found ' || json_array_length(t) || ' result(s).'
  WHEN length(t) > 120 THEN substring(t, 1, 117) || '…' ELSE t END AS summary
FROM (SELECT doc_id, {_strip('content')} AS t FROM (SELECT doc_id, {RESULT_TEXT} AS content FROM documents))"""


def message_log(spark, sf):
    """Assistant turns as tool messages: web results, graph results and an unnamed tool that also
    returns web results; user turns stay as they are."""
    turns = spread(inputs.table(spark, sf, "conversations"))
    conv, turn = F.col("conv_id"), F.col("turn")
    kind = (conv + turn) % 4
    first = F.struct(
        F.concat(F.lit("http://site/"), (turn % 3).cast("string")).alias("url"),
        F.concat(F.lit("name "), turn.cast("string")).alias("name"), F.col("text").alias("snippet"))
    second = F.struct(
        F.concat(F.lit("http://site/"), ((turn + 1) % 3).cast("string")).alias("url"),
        F.concat(F.lit("title "), turn.cast("string")).alias("title"), F.col("text").alias("summary"))
    web = F.concat(F.lit("["), F.to_json(first), F.lit(","), F.to_json(second), F.lit(",7]"))
    return turns.select(
        conv.alias("thread_id"), turn.alias("position"),
        F.when(F.col("role") == "assistant", "tool").otherwise(F.col("role")).alias("role"),
        F.when(kind == 0, "LangSearch_web_search").when(kind == 1, "read_neo4j_cypher").when(kind == 2, "other")
        .alias("tool_name"),
        F.when(kind == 1, F.col("text")).when(kind == 3, F.lit("plain")).otherwise(web).alias("content"))


def citations(spark, sf):
    return messages.citations(message_log(spark, sf))


CITATIONS = f"""WITH log AS (SELECT conv_id AS thread_id, turn AS "position", (conv_id + turn) % 4 AS kind, text FROM conversations
  WHERE role = 'assistant'),
items AS (SELECT thread_id, "position", 0 AS item, 'web' AS source, 'http://site/' || ("position" % 3) AS url,
    'name ' || "position" AS title, text AS whole FROM log WHERE kind IN (0, 2)
  UNION ALL SELECT thread_id, "position", 1, 'web', 'http://site/' || (("position" + 1) % 3), 'title ' || "position",
    text FROM log WHERE kind IN (0, 2)
  UNION ALL SELECT thread_id, "position", 2147483647, 'graph', NULL, 'Crime Knowledge Graph',
    CASE WHEN {_strip('text')} = '' THEN 'Queried the crime knowledge graph.' ELSE {_strip('text')} END
    FROM log WHERE kind = 1)
SELECT * EXCLUDE (rn, whole), substring(whole, 1, 2000) AS detail
FROM (SELECT *, row_number() OVER (PARTITION BY thread_id, source, coalesce(url, whole)
  ORDER BY "position", item) AS rn FROM items) WHERE rn = 1"""


def dangling_calls(spark, sf):
    """M6: assistant turns call a tool, user turns answer the call before them, but not always."""
    turns = inputs.table(spark, sf, "conversations").withColumn("thread_id", F.col("conv_id"))
    call = F.concat(F.lit("call-"), F.floor(F.col("turn") / 2).cast("string"))
    calls = turns.filter(F.col("role") == "assistant").select(
        "thread_id", F.col("turn").alias("position"), call.alias("call_id"),
        F.when(F.col("turn") % 4 != 3, F.concat(F.lit("tool_"), (F.col("turn") % 3).cast("string"))).alias("tool_name"))
    answers = turns.filter((F.col("role") == "user") & ((F.col("conv_id") + F.col("turn")) % 3 != 0)).select(
        "thread_id", (F.col("turn") + 2).alias("position"), call.alias("call_id"))
    return messages.dangling_calls(calls, answers)


DANGLING_CALLS = """WITH calls AS (SELECT conv_id AS thread_id, turn AS p, 'call-' || CAST(floor(turn / 2) AS BIGINT) AS call_id,
  CASE WHEN turn % 4 <> 3 THEN 'tool_' || (turn % 3) END AS tool FROM conversations WHERE role = 'assistant'),
answers AS (SELECT conv_id AS thread_id, turn + 2 AS p, 'call-' || CAST(floor(turn / 2) AS BIGINT) AS call_id FROM conversations
  WHERE role = 'user' AND (conv_id + turn) % 3 <> 0),
last AS (SELECT *, row_number() OVER (PARTITION BY thread_id, call_id ORDER BY p DESC, tool NULLS LAST) AS rn FROM calls)
SELECT thread_id, call_id, coalesce(tool, 'unknown_tool') AS tool_name FROM last l WHERE rn = 1
AND NOT EXISTS (SELECT 1 FROM answers a WHERE a.thread_id = l.thread_id AND a.call_id = l.call_id AND a.p > l.p)"""

QUERIES = {
    "textlog_guardrails": (textlog_guardrails, _guard_sql(r"(?:[^''\\]|\\[\s\S])*")),
    "textlog_literal_passes": (textlog_literal_passes, _guard_sql("[^'']*")),
    "result_summary": (result_summary, RESULT_SUMMARY),
    "citations": (citations, CITATIONS),
    "dangling_calls": (dangling_calls, DANGLING_CALLS),
}
