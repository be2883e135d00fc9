"""Join helpers: size-checked broadcast, missing keys (C5) and dimension guards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` only when it provably has at most ``max_rows`` rows.

    The check reads at most ``max_rows + 1`` rows. A larger side keeps its plan: Spark then
    shuffles both sides and adaptive execution splits skewed partitions.
    Meant for stored tables; for computed sides leave the choice to adaptive execution, which sees
    the real size without a second run.
    """
    within = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if within else df


def missing_keys(facts: DataFrame, dim: DataFrame, key: str, dim_key: str | None = None) -> DataFrame:
    """Distinct fact keys with no dimension row, including a null key.

    ``distinct`` combines map-side, so a key that holds most of the facts costs one row per task.
    """
    keys = dim.select(F.col(dim_key or key).alias("_dim_key")).distinct()
    facts_keys = facts.select(key).distinct()
    return facts_keys.join(keys, facts_keys[key] == keys["_dim_key"], "left_anti")


def require_keys(facts: DataFrame, dim: DataFrame, key: str, sample: int = 10) -> None:
    """C5 as a guard: raise with a count and a short sample when a key is missing."""
    missing = missing_keys(facts, dim, key)
    row = missing.agg(F.count(F.lit(1)).alias("n")).first()
    if row["n"]:
        shown = [r[0] for r in missing.limit(sample).collect()]
        raise ValueError(f"{row['n']} value(s) of {key} are missing from the dimension, e.g. {shown}")


def require_rows(**tables: DataFrame) -> None:
    """Raise when any named table is empty. Looks for one row instead of counting."""
    empty = [name for name, df in tables.items() if df.isEmpty()]
    if empty:
        raise ValueError(f"empty table(s): {', '.join(empty)}; build them first")


def current_rows(dim: DataFrame, key: str, version_col: str = "updated_date",
                 tie_break: Sequence[str] = ()) -> DataFrame:
    """One row per key of a dimension that keeps a copy per batch: the latest version."""
    from tallyward.operators.dedupe import keep_latest

    order = [F.desc_nulls_last(version_col), *[F.asc_nulls_last(c) for c in tie_break]]
    return keep_latest(dim, [key], order)
