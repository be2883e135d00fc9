"""Registered queries: each operator on the driver tables, with an independent SQL statement where one exists.

The driver tables hold no incidents, so ``inputs`` derives landing records from every row of
``lineitem`` and boundary polygons from ``nation``, ``region`` and ``supplier``. Both engines use the
same derivation text; the operators themselves are restated by hand in the oracle SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def registered() -> dict[str, tuple[Query, str | None]]:
    """name -> (query, oracle SQL or None)."""
    from tallyward.catalog import (
        area_queries, contract_queries, graph_queries, landing_queries, model_queries, serving_queries, star_queries, stream_queries,
        table_queries, text_queries,
    )

    out: dict[str, tuple[Query, str | None]] = {}
    for module in (landing_queries, star_queries, area_queries, model_queries, serving_queries, graph_queries,
                   table_queries, text_queries, stream_queries, contract_queries):
        clash = out.keys() & module.QUERIES.keys()
        if clash:
            raise ValueError(f"query registered twice: {sorted(clash)}")
        out.update(module.QUERIES)
    return out
