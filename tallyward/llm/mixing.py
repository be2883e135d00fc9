"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame expressions only.

The mix has a size in words and every source a weight. A source's target is its weight's share of the mix, but at most twice its
own words; the excess goes to the others by weight. Documents of a source are dealt to shards (a source of ``DOCS`` documents
or fewer is one shard) and ordered by a seeded key there. The mix consists of blocks of ``block`` words. They go to the shards by the
highest quotients votes / (k + 1/2), where a shard's votes are its part of the target; the number of blocks a shard gets is its quota. The
quota's blocks are laid end to end over the shard's stream of words, beginning anew at its end, so a document is taken in
whole rounds and in part at the seam.

Nothing is sorted or numbered in one task: the lowest quotient that gets a block, and the cut between shards that tie on it, are
found by narrowing an interval with sums over all shards, 64 trial values a query.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyward.llm.common import staged

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
BLOCK = 8
DOCS = 100_000
WORD = r"[^\x20\x09-\x0D]+"
TRIALS = 64
SHARD_BITS = 24


def sized(docs: DataFrame, seed: int, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """doc_id, source, size (words), key (seeded order) and lot (seeded 32-bit number that picks the shard)."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    name = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    mark = F.md5(F.concat(F.lit(f"{seed}:"), name, F.lit(":"), text).cast("binary"))
    return docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), mark.alias("mark")).select(
        "doc_id", "source", "size", F.substring("mark", 1, 16).alias("key"),
        F.conv(F.substring("mark", 17, 8), 16, 10).cast("long").alias("lot"))


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``place``: numbers from 0 in the given order, by range partitions and the sizes of those before."""
    placed = staged(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "placed")
    counts = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, at = [], 0
    for part in range(max(counts, default=-1) + 1):
        before.append(at)
        at += counts.get(part, 0)
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    offset = F.element_at(F.array(*[F.lit(b).cast("long") for b in before or [0]]), F.col("part") + 1)
    return placed.withColumn("place", offset + inside).drop("part")


def water_level(sources: DataFrame, total: float) -> float:
    """The level at which the sum over sources of min(MOST * size, weight * level) is ``total``: the excess of the sources above
    their limit is shared again until none is above. Each round is one sum over the sources."""
    limit, level = MOST * F.col("size"), 0.0
    while True:
        full = limit <= F.col("weight") * F.lit(level)
        got = sources.agg(F.sum(F.when(full, limit)).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("free")).first()
        if not got["free"]:
            return level
        risen = (total - (got["full"] or 0)) / got["free"]
        if risen <= level:
            return level
        level = risen


def first_true(holds: Callable[[list[int]], list[bool]], low: int, high: int) -> int:
    """The smallest integer of [low, high] for which a monotone property holds; it is known to hold for ``high``."""
    while low < high:
        step = -(-(high - low) // TRIALS)
        trial = list(range(low, high, step))
        known = holds(trial)
        at = known.index(True) if True in known else len(trial)
        high = trial[at] if at < len(trial) else high
        low = trial[at - 1] + 1 if at else low
    return low


def seats(lowest: Column) -> Column:
    """How many quotients votes / (k + 1/2), k = 0, 1, ..., are ``lowest`` or more."""
    votes = F.col("votes")
    k = F.floor(votes / lowest + 0.5)
    over = F.when((k > 0) & (votes / (k - 0.5) < lowest), 1).otherwise(0)
    under = F.when(votes / (k + 0.5) >= lowest, 1).otherwise(0)
    return k - over + under


def sums(cells: DataFrame, trial: list, value: Callable[[Column], Column]) -> list[int]:
    """The sum of ``value`` over all cells, for each trial number, in one query."""
    each = cells.select("*", F.posexplode(F.array(*[F.lit(t) for t in trial])).alias("nth", "trial"))
    got = {r["nth"]: r["n"] for r in each.groupBy("nth").agg(F.sum(value(F.col("trial"))).alias("n")).collect()}
    return [got.get(i) or 0 for i in range(len(trial))]


def _bits(x: float) -> int:
    return struct.unpack(">q", struct.pack(">d", x))[0]


def _float(bits: int) -> float:
    return struct.unpack(">d", struct.pack(">q", bits))[0]


def apportion(cells: DataFrame, blocks: int) -> DataFrame:
    """``cells`` (votes, place) with ``quota``: ``blocks`` go to the highest quotients, ties to the lower place. ``cells`` is read many
    times and should be a stored table."""
    facts = cells.agg(F.sum("votes").alias("all"), F.max("votes").alias("most"), F.max("place").alias("last"),
                      F.count(F.lit(1)).alias("n")).first()
    if blocks <= 0 or not facts["all"]:
        return cells.withColumn("quota", F.lit(0).cast("long"))
    # seats(q) lies within n / 2 of all / q; positive floating point numbers order like their bits
    floor = facts["all"] / (blocks + facts["n"]) * (1 - 1e-6)
    roof = 2 * facts["most"] * (1 + 1e-6)
    if blocks > facts["n"]:
        roof = min(roof, facts["all"] / (blocks - facts["n"]) * (1 + 1e-6))
    enough = lambda xs: [n >= blocks for n in sums(cells, [_float(-x) for x in xs], seats)]
    cut = _float(-first_true(enough, -_bits(roof), -_bits(floor)))
    sure, last = seats(F.lit(math.nextafter(cut, math.inf))), seats(F.lit(cut))
    ties = cells.withColumn("sure", sure).withColumn("tied", last - sure)
    left = blocks - (ties.agg(F.sum("sure")).first()[0] or 0)
    reach = lambda xs: [n >= left for n in sums(
        ties, xs, lambda x: F.when(F.col("place") <= x, F.col("tied")).otherwise(0))]
    to = first_true(reach, 0, facts["last"]) if left > 0 else -1
    quota = F.col("sure") + F.when(F.col("place") <= to, F.col("tied")).otherwise(0)
    return ties.withColumn("quota", quota.cast("long")).drop("sure", "tied")


def mix_sources(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, block: int = BLOCK, seed: int = 1,
                docs_per_shard: int = DOCS, id_col: str = "doc_id", source_col: str = "source",
                text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, source.

    Sources in code point order, null last, take the weights in turn; null is a source of its own. A null text has no words, a
    source without words has target 0. ``taken`` is at most twice the size. A shard takes ``block`` words per block of its
    quota, or twice its words where that is less, so a source's words differ from its target by less than a block a shard. Repeated rows
    are documents of their own; equal ones are interchangeable, so reruns give the same rows. Other columns are ignored; an
    empty table gives an empty result.
    """
    rows = staged(sized(docs, seed, id_col, source_col, text_col), "sized")
    sources = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    order = F.col("source").isNull(), F.col("source")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sources = staged(numbered(sources, *order).withColumn("weight", weight), "sources")
    total = share * (sources.agg(F.sum("size")).first()[0] or 0)
    level = water_level(sources, total)
    sources = sources.select(
        F.col("source").alias("name"), F.col("place").alias("rank"), F.col("size").alias("source_size"),
        F.least((MOST * F.col("size")).cast("double"), F.col("weight") * F.lit(level)).alias("target"),
        F.ceil(F.col("n") / docs_per_shard).alias("shards"))
    dealt = rows.join(sources, F.col("source").eqNullSafe(F.col("name"))).select(
        "doc_id", "size", "key", "source", "source_size", "target", "rank", (F.col("lot") % F.col("shards")).alias("shard"))
    cells = staged(dealt.groupBy("rank", "shard").agg(
        F.sum("size").alias("words"), F.first("target").alias("target"), F.first("source_size").alias("source_size")).select(
        "rank", "shard", "words", F.shiftleft("rank", SHARD_BITS).bitwiseOR(F.col("shard")).alias("place"),
        F.when(F.col("source_size") > 0, F.col("target") * F.col("words") / F.col("source_size")).otherwise(0.0)
        .alias("votes")), "cells")
    quotas = apportion(cells, math.floor(total / block + 0.5)).select(
        F.col("rank").alias("r"), F.col("shard").alias("s"), "words",
        F.least(F.col("quota") * block, MOST * F.col("words")).alias("take"))
    run = Window.partitionBy("rank", "shard").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumn("end", F.sum("size").over(run)).join(
        quotas, (F.col("rank") == F.col("r")) & (F.col("shard") == F.col("s")))
    whole = F.when(F.col("words") > 0, F.expr("take div words")).otherwise(0)
    seam = F.when(F.col("words") > 0, F.col("take") % F.col("words")).otherwise(0)
    part = F.greatest(F.least(F.col("end"), seam) - (F.col("end") - F.col("size")), F.lit(0))
    return placed.select("doc_id", "size", "source_size", "target", (whole * F.col("size") + part).cast("long").alias("taken"),
                         "source")
