"""Small builders for rule tables, shared by the classification functions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def case_chain(branches: Iterable[tuple[Column, object]], default: object) -> Column:
    """First true condition wins; ``default`` when none holds."""
    branches = list(branches)
    head, tail = branches[0], branches[1:]
    chain = reduce(lambda acc, b: acc.when(b[0], _as_col(b[1])), tail, F.when(head[0], _as_col(head[1])))
    return chain.otherwise(_as_col(default))


def member_chain(value: Column, table: Sequence[tuple[str, Sequence[str]]], default: object) -> Column:
    """Label of the first row of ``table`` whose member list holds ``value``."""
    return case_chain([(value.isin(*members), label) for label, members in table], default)


def pattern_chain(value: Column, table: Sequence[tuple[str, str]], default: object) -> Column:
    """Label of the first row of ``table`` whose case-insensitive word pattern occurs in ``value``."""
    return case_chain([(value.rlike(f"(?i)({pattern})"), label) for label, pattern in table], default)


def _as_col(value: object) -> Column:
    return value if isinstance(value, Column) else F.lit(value)
