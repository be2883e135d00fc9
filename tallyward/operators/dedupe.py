"""Keep-latest operators.

All of them filter ``row_number() == 1`` (or ``rank() == 1``) over an ordered window. Spark turns
that shape into a group limit that runs before the shuffle too, so a key that owns a third of the
table sends one row per map task instead of all its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyward.operators.layout import apart, stage

_RANK, _LEAST = "_keep_rank", "_least"
# Bits per repeated key in the broadcast bitmaps of ``keep_latest_repeated``, and the bounds of their number (at most 64 MB).
BITS_PER_KEY, MIN_BITS, MAX_BITS = 8, 2 ** 15, 2 ** 29
# From so many rows of one key on, tasks reduce them before the shuffle.
HOT_ROWS = 10_000
# From so many repeated rows on, rows that are older than others of their key are dropped by bitmaps, in so many passes.
MANY_ROWS, NEWEST_PASSES = 1_000_000, 2


def keep_latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row per key in ``order``."""
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(_RANK, F.row_number().over(window)).filter(F.col(_RANK) == 1).drop(_RANK)


def _bits(n: int) -> int:
    """Size of the bitmap for ``n`` hashes."""
    return min(max(1 << (n * BITS_PER_KEY - 1).bit_length(), MIN_BITS), MAX_BITS)


def _bit(hash_: Column, bits: int) -> Column:
    return F.pmod(hash_, F.lit(bits)) + 1


def _marks(hashes: DataFrame, bits: int, label: str) -> DataFrame:
    """The bitmap of the hashes in the column ``_hash``, in words of 8 bytes, as a stored table of about ``bits / 8`` bytes at most."""
    bit = _bit(F.col("_hash"), bits)
    buckets = hashes.groupBy(F.bitmap_bucket_number(bit).alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("_bits"))
    return stage(buckets.select("_bucket", F.expr(
        "transform(sequence(1, length(_bits), 8), i -> cast(conv(hex(substring(_bits, i, 8)), 16, -10) as bigint))").alias("_words")), label)


def _with_bit(df: DataFrame, hashed: Column, marks: DataFrame, bits: int, how: str = "left_semi") -> DataFrame:
    """The rows whose hash has a bit, or with ``left_anti`` those without one. A join, since it drops rows before other columns are made."""
    bit = _bit(hashed, bits)
    at = F.bitmap_bit_position(bit).cast("int")
    word = F.get("_words", F.shiftright(at, 6))
    place = (F.lit(7) - F.shiftright(at, 3) % 8) * 8 + at % 8  # a word's first byte is its highest
    return df.join(F.broadcast(marks), (F.bitmap_bucket_number(bit) == F.col("_bucket")) & (F.getbit(word, place) == 1), how)


def _likely_newest(df: DataFrame, keys: Sequence[str], newest: str, bits: int, seed: int) -> DataFrame:
    """Every row whose ``newest`` is the largest of its key (null only where all are), and a few others: those that share a bit
    with such a row. Shuffles the keys and ``newest`` alone."""
    def hashed() -> Column:
        return F.xxhash64(F.lit(seed), *keys, newest)

    best = df.groupBy(*keys).agg(F.max(newest).alias(newest)).select(hashed().alias("_hash"))
    return _with_bit(df, hashed(), _marks(best, bits, "newest"), bits)


def keep_latest_repeated(df: DataFrame, keys: Sequence[str], order: Sequence[Column], newest: str | None = None) -> DataFrame:
    """``keep_latest`` for wide rows: only rows whose key may come again are shuffled.

    Key hashes are counted first, and those that occur more than once set a bit each. A row without its bit is the only one of its
    key and goes straight through; all rows of a key share a bit, so the others meet in one window, whatever hashes collide. ``df``
    is read three times, once for its keys alone: it should be a stored table or cheap to derive, and the same each time.

    ``newest`` may name the column whose descending order, nulls last, leads ``order``. Where many rows are repeated, the largest
    value of each key sets a bit then, and rows without their bit are dropped, as they cannot come first; twice, since the bits of
    very many keys collide. What is left is counted anew, so that only rows that tie or still collide are shuffled whole. ``df`` is
    read seven times then, thrice for keys and ``newest`` alone.
    """
    hashed = F.xxhash64(*keys)
    again = stage(df.select(hashed.alias("_hash")).groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "repeated")
    n, most, rows = again.agg(F.count(F.lit(1)), F.max("_n"), F.sum("_n")).first()
    if not n:
        return df
    bits = _bits(n)
    marks = _marks(again, bits, "repeated-bits")
    alone, rest = (_with_bit(df, hashed, marks, bits, how) for how in ("left_anti", "left_semi"))
    if newest and rows >= MANY_ROWS:
        for seed in range(NEWEST_PASSES):
            rest = _likely_newest(rest, keys, newest, bits, seed)
        return apart(alone).unionByName(keep_latest_repeated(rest, keys, order))
    if most < HOT_ROWS:
        rest = rest.repartition(*keys)  # sorted once, behind the shuffle
    return apart(alone).unionByName(keep_latest(rest, keys, order))


def keep_top(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
             rank_col: str = "rn") -> DataFrame:
    """The first ``n`` rows per key, numbered (top-k report)."""
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(window)).filter(F.col(rank_col) <= n)


def keep_latest_ties(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """All rows that share the first place of their key, as a join with the per-key maximum would."""
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(_RANK, F.rank().over(window)).filter(F.col(_RANK) == 1).drop(_RANK)


def full_order(df: DataFrame, leading: Sequence[Column] = (), skip: Sequence[str] = ()) -> list[Column]:
    """``leading`` followed by every other column: two rows that still tie are identical."""
    return [*leading, *[F.asc_nulls_last(c) for c in df.columns if c not in skip]]


def dedupe_landing(df: DataFrame, id_col: str = "id", updated_col: str = "updated_on") -> DataFrame:
    """Latest parseable ``updated_on`` per id, unparseable dates last; unchanged without an id column."""
    if id_col not in df.columns:
        return df
    lead = [F.desc_nulls_last(F.try_to_timestamp(F.col(updated_col)))] if updated_col in df.columns else []
    order = full_order(df, lead, skip=[id_col])
    return keep_latest(df, [id_col], order)


def dedupe_silver(df: DataFrame) -> DataFrame:
    """Latest per id by the raw texts of updated_on, date and case_number."""
    lead = [F.desc_nulls_last(c) for c in ("updated_on", "date", "case_number")]
    return keep_latest_repeated(df, ["id"], full_order(df, lead, skip=["id", "updated_on", "date", "case_number"]))


def dedupe_fact(df: DataFrame, key: str = "incident_id") -> DataFrame:
    """Latest per incident by time, date key and case number. ``key`` may name the untouched source id."""
    used = ["incident_datetime", "date_key", "case_number"]
    lead = [F.desc_nulls_last(c) for c in used]
    return keep_latest_repeated(df, [key], full_order(df, lead, skip=["incident_id", key, *used]), newest=used[0])


def keep_one(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """one row per key, the smallest over all other columns, nulls last, so that reruns agree. An aggregation: where a query uses
    the keys alone, nothing else is read, sorted or shuffled."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    parts = [part for i, c in enumerate(rest) for part in (F.col(c).isNull().alias(f"n{i}"), F.col(c).alias(f"v{i}"))]
    least = {c: F.col(f"{_LEAST}.v{i}").alias(c) for i, c in enumerate(rest)}
    return df.groupBy(*keys).agg(F.min(F.struct(*parts)).alias(_LEAST)).select(*[least.get(c, F.col(c)) for c in df.columns])
