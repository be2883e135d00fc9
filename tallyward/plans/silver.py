"""Landing records to the typed incident table."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.functions.taxonomy import add_taxonomy
from tallyward.operators.dedupe import dedupe_silver
from tallyward.operators.layout import apart
from tallyward.operators.spatial import fill_from_layers
from tallyward.schema import LANDING_COLUMNS, SILVER_DDL, enforce, evolve, lower_columns
from tallyward.sources.tables import replace_slices

# Layer order and the columns each fills.
LAYERS = [
    ("districts", "district", "district_name"),
    ("beats", "beat", None),
    ("wards", "ward", None),
    ("community_areas", "community_area", "community_area_name"),
]


def build_silver(
    landing: DataFrame,
    process_date: date | Column,
    layers: dict[str, DataFrame] | None = None,
    key_method: str = "xxhash64",
    on_overlap: str = "first",
) -> DataFrame:
    """Dedupe, fill geography from the given layers, classify, enforce the 39-column schema.

    ``process_date`` is a constant batch date, or a column (such as the incident day) when many
    days are loaded in one pass. Any layer may be absent.
    """
    stamp = process_date if isinstance(process_date, Column) else F.lit(process_date)
    text_columns = ", ".join(f"{c} string" for c in LANDING_COLUMNS)
    df = evolve(lower_columns(landing), text_columns)
    df = dedupe_silver(df).withColumns({
        "process_date": stamp.cast("timestamp"),
        "district_name": F.lit(None).cast("string"),
        "community_area_name": F.lit(None).cast("string"),
    })
    given = {name: (layers[name], id_col, name_col) for name, id_col, name_col in LAYERS
             if layers and layers.get(name) is not None}
    if given:
        df = apart(fill_from_layers(df, given, on_overlap=on_overlap))
    return enforce(add_taxonomy(df, key_method=key_method), SILVER_DDL)


def write_silver(silver: DataFrame, path: str) -> None:
    """Replace the batch days present in ``silver``; the partition value is the batch date."""
    replace_slices(silver.withColumn("process_date", F.to_date("process_date")), path, ["process_date"])
