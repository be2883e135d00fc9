"""Incident landing records and boundary polygons derived from the driver tables.

The expressions are plain SQL that Spark and DuckDB read alike.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.operators.layout import spread
from tallyward.plans.silver import build_silver
from tallyward.sources.boundaries import boundary_layer

# Values the derivation cycles through. Some are lower case, padded or unknown on purpose.
TYPES = ["HOMICIDE", "ROBBERY", "BATTERY", "ASSAULT", "KIDNAPPING", "CRIMINAL SEXUAL ASSAULT", "HUMAN TRAFFICKING",
         "INTIMIDATION", "STALKING", "SEX OFFENSE", "PROSTITUTION", "OFFENSE INVOLVING CHILDREN", "WEAPONS VIOLATION",
         "CONCEALED CARRY LICENSE VIOLATION", "NARCOTICS", "OTHER NARCOTIC VIOLATION", "CANNABIS",
         "LIQUOR LAW VIOLATION", "THEFT", "MOTOR VEHICLE THEFT", "BURGLARY", "CRIMINAL DAMAGE", "CRIMINAL TRESPASS",
         "ARSON", "DECEPTIVE PRACTICE", "STOLEN PROPERTY", "OTHER OFFENSE", "GAMBLING", "NON-CRIMINAL",
         "DOMESTIC VIOLENCE", " battery ", "theft"]
DESCRIPTIONS = ["SIMPLE", "AGGRAVATED: HANDGUN", "AGG: HANDS NO/MIN INJURY", "OVER $500", "FIRST DEGREE MURDER",
                "poss: cannabis 30gms or less", "FORCIBLE ENTRY", " aggravated - other "]
PLACES = ["STREET", "Parking lot", "PARK PROPERTY", "APARTMENT", "BARBERSHOP", "SCHOOL, PUBLIC, BUILDING",
          "HOSPITAL BUILDING / GROUNDS", "COURTHOUSE", "CHURCH / SYNAGOGUE", "sidewalk", "RESIDENCE", "SMALL RETAIL STORE",
          "POLICE FACILITY", "ALLEY", "VACANT LOT"]
STREETS = ["N STATE ST", "S LAKE SHORE DR", "w ashland ave", "E PULASKI RD", "N Western Ave"]


def _nth(values: list[str], index: str) -> str:
    return f"split_part('{'|'.join(values)}', '|', cast(({index}) % {len(values)} + 1 as int))"


def _text(number: str, width: int = 0) -> str:
    text = f"cast({number} as string)"
    return f"lpad({text}, {width}, '0')" if width else text


_ID = "l_orderkey * 8 + l_linenumber"
_DAY = "cast(cast(l_shipdate as date) as string)"
_LON = f"'-87.' || {_text('600000 + (l_partkey * 37 % 1000) * 139')}"
_LAT = f"'41.' || {_text('900000 + ((l_suppkey * 53 + l_linenumber * 101) % 1000) * 98')}"

LANDING_EXPRESSIONS = {
    "id": _text(_ID),
    "case_number": f"'CN' || {_text(_ID)}",
    "date": f"{_DAY} || 'T' || {_text('l_partkey % 24', 2)} || ':' || {_text('l_suppkey % 60', 2)} || ':00.000'",
    "block": f"{_text('l_partkey % 90 + 10', 3)} || 'XX ' || {_nth(STREETS, 'l_suppkey + l_linenumber')}",
    "iucr": f"case when l_partkey % 41 <> 0 then {_text('l_partkey % 60', 4)} end",
    "primary_type": f"case when l_partkey % 97 <> 0 then {_nth(TYPES, 'l_partkey')} end",
    "description": f"case when l_suppkey % 43 <> 0 then {_nth(DESCRIPTIONS, 'l_partkey + l_linenumber')} end",
    "location_description": f"case when l_suppkey % 16 <> 15 then {_nth(PLACES, 'l_suppkey % 16')} end",
    "arrest": "case l_returnflag when 'A' then 'true' when 'N' then 'false' end",
    "domestic": "case when l_linestatus = 'O' then 'true' else 'false' end",
    "beat": f"case when l_suppkey % 29 <> 0 then {_text('l_suppkey % 25 * 100 + l_linenumber', 4)} end",
    "district": f"case when l_suppkey % 29 = 0 then null when l_suppkey % 31 = 0 then '' "
                f"else {_text('l_suppkey % 25', 3)} end",
    "ward": f"case when l_suppkey % 17 = 0 then null when l_suppkey % 19 = 0 then '  ' "
            f"else {_text('l_suppkey % 50')} end",
    "community_area": f"case when l_partkey % 37 = 0 then null when l_partkey % 23 = 0 then '' "
                      f"else {_text('l_suppkey % 77 + 1')} end",
    "fbi_code": _text("l_partkey % 26", 2),
    "x_coordinate": _text("1100000 + l_partkey % 1000 * 37"),
    "y_coordinate": _text("1800000 + l_suppkey % 1000 * 41"),
    "year": f"substring({_DAY}, 1, 4)",
    "updated_on": "case when l_partkey % 47 = 0 then 'pending' else "
                  "cast(cast(l_shipdate as date) + cast(l_quantity as int) as string) || 'T00:00:00.000' end",
    "latitude": f"case when l_quantity <> 7 then {_LAT} end",
    "longitude": f"case when l_quantity <> 7 then {_LON} end",
    "location": f"'(' || {_LAT} || ', ' || {_LON} || ')'",
}


def _ring(cx: str, cy: str, offsets: list[tuple[int, int]]) -> str:
    closed = [*offsets, offsets[0]]
    points = [f"'-87.' || {_text(f'({cx} + ({dx}))')} || ' 41.' || {_text(f'({cy} + ({dy}))')}" for dx, dy in closed]
    return "'(' || " + " || ', ' || ".join(points) + " || ')'"


def _box(dx: int, dy: int) -> list[tuple[int, int]]:
    return [(dx, dy), (-dx, dy), (-dx, -dy), (dx, -dy)]


_NX = "(614013 + 28000 * (n_nationkey % 5))"
_NY = "(912013 + 18000 * cast(floor(n_nationkey / 5) as int))"
_OCTAGON = [(16000, 5000), (8000, 10000), (-8000, 10000), (-16000, 5000),
            (-16000, -5000), (-8000, -10000), (8000, -10000), (16000, -5000)]
_HOLE = f"case when n_nationkey % 3 = 0 then ', ' || {_ring(_NX, _NY, _box(3000, 3000))} else '' end"

# name -> (table, raw id column, raw label column or None, id expression, label expression, WKT expression)
LAYERS = {
    "districts": ("nation", "DIST_NUM", "DIST_LABEL", _text("n_nationkey"), "n_name",
                  f"case when n_nationkey % 5 = 0 then 'MULTIPOLYGON ((' || {_ring(_NX, _NY, _OCTAGON)} || {_HOLE} || "
                  f"'), (' || {_ring(_NX, '996513', _box(2000, 1500))} || '))' "
                  f"else 'POLYGON (' || {_ring(_NX, _NY, _OCTAGON)} || {_HOLE} || ')' end"),
    "beats": ("supplier", "BEAT_NUM", None, _text("s_suppkey", 4), "cast(null as string)",
              "'POLYGON (' || " + _ring("(600013 + (s_suppkey * 7919 % 140) * 1000)",
                                        "(903013 + (s_suppkey * 104729 % 94) * 1000)",
                                        [(1500, 0), (0, 1500), (-1500, 0), (0, -1500)]) + " || ')'"),
    "wards": ("region", "WARD", None, _text("r_regionkey"), "cast(null as string)",
              "'POLYGON (' || " + _ring("670013", "(910013 + 19500 * r_regionkey)", _box(70000, 9750)) + " || ')'"),
    "community_areas": ("nation", "AREA_NUMBE", "COMMUNITY_NAME", _text("n_nationkey + 1"), "n_name",
                        "'POLYGON (' || " + _ring(_NX, _NY, _box(13000, 8500)) + " || ')'"),
}
# A further layer: diamonds whose extents are 1 to 1,024, on places that do not repeat as suppliers are added.
_REACH = "(cast(pow(2, s_suppkey % 11) as int) * 40)"
MORE_LAYERS = {
    "diamonds": ("supplier", "BEAT_NUM", "BEAT_LABEL", _text("s_suppkey"), "s_name", "'POLYGON (' || " + _ring(
        "(600013 + s_suppkey * 7919 % 139999)", "(903013 + s_suppkey * 15485 % 93997)",
        [(f"{_REACH}", 0), (0, f"{_REACH}"), (f"- {_REACH}", 0), (0, f"- {_REACH}")]) + " || ')'"),
}
ROLE_OF_LAYER = {"districts": "district", "beats": "beat", "wards": "ward", "community_areas": "community_area"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landing records (all text) from every lineitem row; repeated order lines are repeated ids."""
    return spread(table(spark, sf_dir, "lineitem")).selectExpr(*[f"{e} as {c}" for c, e in LANDING_EXPRESSIONS.items()])


def raw_boundary(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A boundary table with WKT geometry and column names that must be found by role."""
    source, id_col, label_col, id_expr, label_expr, wkt = (LAYERS | MORE_LAYERS)[name]
    columns = [f"{id_expr} as {id_col}", f"{wkt} as THE_GEOM"]
    if label_col:
        columns.append(f"{label_expr} as {label_col}")
    return table(spark, sf_dir, source).selectExpr(*columns)


def layers(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: boundary_layer(raw_boundary(spark, sf_dir, name), ROLE_OF_LAYER[name]) for name in LAYERS}


def silver(spark: SparkSession, sf_dir: str, located: bool = False) -> DataFrame:
    """All days in one pass; the process date is the incident day. Keys are the portable ones."""
    day = F.to_date(F.substring("date", 1, 10))
    return build_silver(landing(spark, sf_dir), day, layers(spark, sf_dir) if located else None, key_method="md5")


def first_last_day(spark: SparkSession, sf_dir: str) -> tuple[date, date]:
    """First and last incident day: a job that reads one column."""
    day = F.col("l_shipdate").cast("date")
    row = table(spark, sf_dir, "lineitem").agg(F.min(day).alias("a"), F.max(day).alias("b")).first()
    return row["a"], row["b"]


def naive_times(df: DataFrame) -> DataFrame:
    """Timestamps without time zone, so that a comparison does not depend on the session's zone."""
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c)
                       for c, t in df.dtypes])


def event_landing(spark: SparkSession, sf_dir: str, delivery: int = 1) -> DataFrame:
    """Landing records from every event. The second delivery repeats the even ids with a later
    ``updated_on`` and another type; the third moves every fourth id to the next day."""
    from tallyward.schema import LANDING_COLUMNS, evolve

    ts = F.col("ts").cast("string")
    day = F.substring(ts, 1, 10)
    kinds = F.create_map(*[F.lit(v) for v in ("click", "THEFT", "error", "BATTERY", "purchase", "NARCOTICS",
                                              "signup", "WEAPONS VIOLATION", "view", "GAMBLING")])
    rows = table(spark, sf_dir, "events").select(
        "event_id",
        F.col("event_id").cast("string").alias("id"),
        F.concat(F.lit("EV"), F.col("event_id").cast("string")).alias("case_number"),
        F.concat(day, F.lit("T"), F.substring(ts, 12, 8)).alias("date"),
        kinds[F.col("event_type")].alias("primary_type"),
        F.get_json_object("props", "$.k").alias("description"),
        F.lit("STREET").alias("location_description"),
        F.when(F.col("value") > 50, "true").otherwise("false").alias("arrest"),
        (F.col("user_id") % 25).cast("string").alias("district"),
        (F.col("user_id") % 77 + 1).cast("string").alias("community_area"),
        F.concat(day, F.lit("T23:00:00")).alias("updated_on"),
    )
    if delivery == 2:
        rows = rows.filter(F.col("event_id") % 2 == 0).withColumns({
            "updated_on": F.concat(F.lit("2025-01-01T00:00:"), F.lpad((F.col("event_id") % 60).cast("string"), 2, "0")),
            "primary_type": F.lit("ARSON"),
        })
    if delivery == 3:
        later = F.date_format(F.date_add(F.to_date(F.substring("date", 1, 10)), 1), "yyyy-MM-dd")
        rows = rows.filter(F.col("event_id") % 4 == 1).withColumns({
            "updated_on": F.lit("2025-02-01T00:00:00"), "date": F.concat(later, F.substring("date", 11, 9))})
    return evolve(rows, ", ".join(f"{c} string" for c in LANDING_COLUMNS)).select(*LANDING_COLUMNS)
