"""Surrogate keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Separator for the portable key; a control character cannot occur in cleaned source text.
_UNIT = "\x1f"

KEY_METHODS = ("xxhash64", "hash32", "md5")


def surrogate_key(parts: Sequence[Column], method: str = "xxhash64") -> Column:
    """A bigint key over string parts.

    ``hash32``  Murmur3 widened to bigint: the values older tables hold, but collisions become
                likely from tens of thousands of keys on.
    ``xxhash64``  64-bit, the default for new tables.
    ``md5``  first 60 bits of an md5 digest: slower, but any SQL engine can recompute it.
    """
    if method == "hash32":
        return F.hash(*parts).cast("bigint")
    if method == "xxhash64":
        return F.xxhash64(*parts)
    if method == "md5":
        digest = F.md5(F.concat_ws(_UNIT, *parts).cast("binary"))
        return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
    raise ValueError(f"unknown key method {method!r}; use one of {KEY_METHODS}")


# The location identity columns and what stands for a missing one. The zeros are
# strings on purpose, so that codes such as '0123' hash as text.
LOCATION_KEY_DEFAULTS = {
    "beat": "0",
    "district": "0",
    "ward": "0",
    "community_area": "0",
    "location_description": "Unknown",
    "block": "Unknown",
}


def location_key(method: str = "xxhash64", defaults: dict[str, str] | None = None) -> Column:
    """One key for the dimension and every fact that points at it."""
    parts = (defaults or LOCATION_KEY_DEFAULTS).items()
    return surrogate_key([F.coalesce(F.col(c).cast("string"), F.lit(d)) for c, d in parts], method)


def date_key(ts: Column) -> Column:
    """yyyyMMdd as an int, computed arithmetically (no string formatting per row)."""
    return (F.year(ts) * 10000 + F.month(ts) * 100 + F.dayofmonth(ts)).cast("int")


def location_text_key(
    parts: Sequence[str] = ("community_area_name", "district_name", "block", "location_description"),
) -> Column:
    """Readable location identity; null becomes 'Unknown', an empty string stays empty."""
    return F.concat_ws("|", *[F.coalesce(F.trim(F.col(c)), F.lit("Unknown")) for c in parts])
