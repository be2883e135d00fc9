"""Connected components by alternating large-star and small-star steps on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm.common import staged


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the undirected ``edges`` (a, b); component is the smallest node.

    Each round is an aggregation with map-side combine and an equi-join, which adaptive execution splits
    when one node has very many edges; the edge table of a round is written to the shared folder. Rounds
    grow with the logarithm of the component size. Null ends and self loops are ignored.
    """
    pairs = staged(edges.filter("a is not null and b is not null and a <> b")
                   .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter("u <> v").distinct())
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u")
        pairs = staged(small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
                       .unionByName(lower.select("u", F.col("m").alias("v"))).distinct(), "edges")
        state = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return (pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.col("m").alias("component"))
            .unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
