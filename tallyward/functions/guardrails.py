"""Text rules for logged graph queries and tool results (M1-M4, M7).

Java patterns carry ``(?U)`` where Unicode word and space classes matter.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------------
# Keywords, patterns and messages.
# ---------------------------------------------------------------------------------------------
WRITE_KEYWORDS = ["CREATE", "MERGE", "DELETE", "DETACH", "SET", "REMOVE", "DROP"]
PROCEDURE_CALL = r"\bcall\s+db\."
STRING_OPERATORS = ["CONTAINS", r"STARTS\s+WITH", r"ENDS\s+WITH"]
FLAG_NAME = r"([\w]++(?:\.[\w]++)*+)"
INTERNAL_WORDS = ["neo4j", "cypher", "gql_status", "clienterror", "syntaxerror", "database",
                  "read_neo4j_cypher", "traceback", "exception"]
EMPTY_RESULT = "No results returned."
RETRY_LATER = "Something went wrong on our side. Please try again after a couple of minutes."
SUMMARY_LIMIT = 120
APOSTROPHE_PASSES = 5  # of the literal rule
BLOCK_COMMENT, LINE_COMMENT = r"(?s)/\*.*?\*/", r"--[^\n]*"
BROKEN_LITERAL = r"\s*'({content})'([A-Za-z][^']*)'"
# ---------------------------------------------------------------------------------------------

_SPACE = r"[\s\x{1c}-\x{1f}]"


def strip_unicode(text: Column) -> Column:
    """Trim every kind of white space at both ends.

    The trailing run is only tried from its first character, so long inner runs stay linear.
    """
    return F.regexp_replace(text, rf"(?U)\A{_SPACE}++|{_SPACE}(?<!{_SPACE}{_SPACE}){_SPACE}*+\z", "")


def strip_comments(query: Column) -> Column:
    """M1: remove block comments, then line comments, then collapse blank lines and trim."""
    q = F.regexp_replace(query, BLOCK_COMMENT, "")
    q = F.regexp_replace(q, LINE_COMMENT, "")
    q = F.regexp_replace(q, rf"(?U)\n{_SPACE}*\n", "\n")
    return strip_unicode(q)


def _from_word_start(keyword: str) -> str:
    """The keyword, required to begin a word. The boundary is tested behind its first word, so that
    most positions of a long text fail on the first letter already."""
    head = re.match(r"[A-Z]+", keyword).group()
    return rf"{head}(?<=\b{head}){keyword[len(head):]}"


def repair_apostrophes(query: Column, literal_passes: bool = False, max_passes: int | None = None) -> Column:
    """M2: escape a quote that closes a literal too early, until none is left or ``max_passes`` are done.

    The passes stop at the first one that finds nothing, so an intact text is scanned once; each other pass
    escapes a quote, so a text needs no more of them than it has quotes. A quote behind a backslash counts
    as escaped. ``literal_passes=True`` ignores backslashes as the plain rule does: it finds each
    repaired quote again and adds a backslash in every pass, five times unless ``max_passes`` says otherwise.
    """
    operators = "|".join(_from_word_start(k) for k in STRING_OPERATORS)
    content = r"[^']*" if literal_passes else r"[^'\\]*+(?:\\[\s\S][^'\\]*+)*+"
    pattern = rf"(?iU)({operators})" + BROKEN_LITERAL.format(content=content)

    def one_pass(state: Column, _: Column) -> Column:
        fixed = F.regexp_replace(state["q"], pattern, r"$1 '$2\\'$3'")
        again = state["open"] & state["q"].rlike(pattern)
        return F.when(again, _state(fixed, True)).otherwise(_state(state["q"], False))

    quotes = F.length(query) - F.length(F.replace(query, F.lit("'"), F.lit("")))
    if literal_passes and max_passes is None:
        max_passes = APOSTROPHE_PASSES
    passes = F.sequence(F.lit(1), F.greatest(F.lit(1), quotes) if max_passes is None else F.lit(max_passes))
    return F.aggregate(passes, _state(query, True), one_pass, lambda state: state["q"])


def _state(query: Column, is_open: bool) -> Column:
    return F.struct(query.alias("q"), F.lit(is_open).alias("open"))


def repair_flag_tests(query: Column) -> Column:
    """M3: a bare flag in CASE WHEN becomes a comparison; the negated form first."""
    when = _from_word_start("WHEN")
    q = F.regexp_replace(query, rf"(?iU){when}\s+NOT\s+{FLAG_NAME}\s+THEN\b", "WHEN $1 <> 1 THEN")
    return F.regexp_replace(q, rf"(?iU){when}\s+{FLAG_NAME}\s+THEN\b", "WHEN $1 = 1 THEN")


def query_class(query: Column) -> Column:
    """M4: 'empty', 'write' or 'read_only'. A keyword inside a literal counts as a write."""
    forbidden = rf"(?iU)\b({'|'.join(WRITE_KEYWORDS)})\b|{PROCEDURE_CALL}"
    return (F.when(F.coalesce(strip_unicode(query), F.lit("")) == "", "empty")
            .when(query.rlike(forbidden), "write").otherwise("read_only"))


def normalize_query(query: Column, literal_passes: bool = False) -> Column:
    """M1, M2 and M3 in that order."""
    return repair_flag_tests(repair_apostrophes(strip_comments(query), literal_passes))


def result_summary(content: Column, limit: int = SUMMARY_LIMIT) -> Column:
    """M7: short text shown for a tool result; longer texts are cut for display to ``limit`` characters."""
    text = strip_unicode(content)
    internal = rf"(?iU)({'|'.join(INTERNAL_WORDS)})"
    entries = F.when(text.startswith("["), F.json_array_length(text))
    shortened = F.when(F.length(text) > limit,
                       F.concat(F.substring(text, 1, limit - 3), F.lit("…"))).otherwise(text)
    return (F.when(F.coalesce(text, F.lit("")) == "", EMPTY_RESULT)
            .when(text.rlike(internal), RETRY_LATER)
            .when(entries.isNotNull(), F.concat(F.lit("Found "), entries.cast("string"), F.lit(" result(s).")))
            .otherwise(shortened))
