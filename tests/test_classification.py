"""Truth tables: taxonomy (B6-B15), locations (B17-B21), calendar (B26-B30, B34, G1, G2), keys."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tallyward.functions import calendar as cal
from tallyward.functions import location as loc
from tallyward.functions.keys import location_key, location_text_key, surrogate_key
from tallyward.functions.taxonomy import TAXONOMY_COLUMNS, add_taxonomy, ensure_taxonomy
from tallyward.operators.dimensions import date_dimension_for, time_of_day_dimension

TAXONOMY = [
    ("HOMICIDE", "FIRST DEGREE MURDER", "Violent", "Homicide", "High", "Violent Crime", "High", (1, 0, 0, 0)),
    ("CRIMINAL SEXUAL ASSAULT", "x", "Violent", "Sexual assault", "High", "Violent Crime", "High", (1, 0, 0, 0)),
    ("BATTERY", "AGGRAVATED: HANDGUN", "Violent", "Aggravated battery", "Medium", "Violent Crime", "Medium", (1, 0, 0, 0)),
    ("BATTERY", "AGG: HANDS", "Violent", "Battery", "Medium", "Violent Crime", "Medium", (1, 0, 0, 0)),
    (" battery ", "simple", "Violent", "Battery", "Medium", "Violent Crime", "Medium", (1, 0, 0, 0)),
    ("STALKING", "x", "Violent", "Stalking", "Variable", "Violent Crime", "Variable", (1, 0, 0, 0)),
    ("PROSTITUTION", "x", "Sex offense", "Commercial sex offense", "Variable", "Sex Crime", "Variable", (0, 0, 0, 0)),
    ("WEAPONS VIOLATION", "x", "Weapons", "Weapons offense", "Medium", "Weapons Crime", "Variable", (0, 0, 0, 1)),
    ("CANNABIS", "x", "Drug", "Drug offense", "Low", "Drug Crime", "Variable", (0, 0, 1, 0)),
    ("THEFT", "OVER $500", "Property", "Theft", "Low", "Property Crime", "Low", (0, 1, 0, 0)),
    ("ARSON", "x", "Property", "Arson", "Medium", "Property Crime", "Variable", (0, 1, 0, 0)),
    ("OTHER OFFENSE", "x", "Property", "Other Offense", "Variable", "Property Crime", "Variable", (0, 1, 0, 0)),
    ("GAMBLING", "x", "Public order", "Public order offense", "Variable", "Public Order Crime", "Variable", (0, 0, 0, 0)),
    ("DOMESTIC VIOLENCE", "x", "Other", "Domestic Violence", "Variable", "Other Crime", "Variable", (0, 0, 0, 0)),
    (None, None, "Unknown", "Unknown", "Variable", "Other Crime", "Variable", (0, 0, 0, 0)),
]


def test_taxonomy_truth_table(spark):
    df = spark.createDataFrame([(i, t[0], t[1], None) for i, t in enumerate(TAXONOMY)],
                               "n int, primary_type string, description string, iucr string")
    for row in add_taxonomy(df).collect():
        _, _, category, group, severity, fbi, clearance, flags = TAXONOMY[row["n"]]
        got = (row["crime_category"], row["crime_offense_group"], row["crime_severity_level"],
               row["crime_fbi_classification"], row["crime_clearance_bucket"],
               (row["violent_crime_flag"], row["property_crime_flag"], row["drug_crime_flag"], row["weapon_crime_flag"]))
        assert got == (category, group, severity, fbi, clearance, flags), row
        if row["primary_type"] is None:
            assert row["crime_offense_label"] == "0000 | UNKNOWN | UNKNOWN"


def test_partial_taxonomy_is_recomputed(spark):
    df = spark.createDataFrame([("THEFT", "x", "1", "stale")],
                               "primary_type string, description string, iucr string, crime_category string")
    full = ensure_taxonomy(df)
    assert full.first()["crime_category"] == "Property"
    assert ensure_taxonomy(full) is full
    assert set(TAXONOMY_COLUMNS) <= set(full.columns)


def test_key_methods(spark):
    df = spark.createDataFrame([("0123",)], "beat string").withColumns(
        {c: F.lit(None).cast("string") for c in ("district", "ward", "community_area", "location_description", "block")})
    row = df.select(surrogate_key([F.col("beat")], "hash32").alias("h"), location_key("hash32").alias("l"),
                    F.hash(F.lit("0123"), F.lit("0"), F.lit("0"), F.lit("0"), F.lit("Unknown"), F.lit("Unknown")).alias("w"),
                    surrogate_key([F.col("beat")], "md5").alias("m")).first()
    assert row["h"] == -678127420
    assert row["l"] == row["w"]
    assert 0 <= row["m"] < 2 ** 60
    with pytest.raises(ValueError):
        surrogate_key([F.col("beat")], "sha")


def test_location_text_key_keeps_empty_text(spark):
    df = spark.createDataFrame([(None, "", " B ", "d")],
                               "community_area_name string, district_name string, block string, location_description string")
    assert df.select(location_text_key().alias("k")).first()["k"] == "Unknown||B|d"


@pytest.mark.parametrize("text, kind, category, risk", [
    ("STREET", "Public/Street", "Public", "High"),
    ("Parking lot", "Public/Street", "Public", "High"),
    ("PARK PROPERTY", "Recreation", "Other", "Medium"),
    ("APARTMENT", "Residential", "Private", "Low"),
    ("BARBERSHOP", "Commercial", "Semi-Public", "Medium"),
    ("SCHOOL, PUBLIC", "Educational", "Semi-Public", "Low"),
    ("HOSPITAL BUILDING", "Medical", "Semi-Public", "Low"),
    ("COURTHOUSE", "Residential", "Private", "Low"),
    ("CHURCH", "Religious", "Other", "Low"),
    (None, "Other", "Other", "Medium"),
])
def test_location_classes(spark, text, kind, category, risk):
    df = spark.createDataFrame([(text,)], "d string")
    k = loc.location_type(F.col("d"))
    assert tuple(df.select(k, loc.location_category(k), loc.risk_level(k)).first()) == (kind, category, risk)


def test_incident_risk_and_district_label(spark):
    df = spark.createDataFrame([("ALLEY", "7", None), ("APARTMENT", "7", " Near "), ("BAR", None, None), (None, None, None)],
                               "d string, district string, name string")
    rows = df.select(loc.incident_risk(F.col("d")).alias("r"),
                     loc.district_label(F.col("district"), F.col("name")).alias("l")).collect()
    assert [r["r"] for r in rows] == ["High Risk", "Medium Risk", "Low Risk", "Low Risk"]
    assert [r["l"] for r in rows] == ["District 7", "Near", None, None]


def test_date_dimension(spark):
    dim = date_dimension_for(spark, date(2026, 7, 1))
    assert dim.count() == 5 * 365 + 365 + 1 and len(dim.columns) == 18
    rows = {r["date"]: r for r in dim.collect()}
    expect = {
        date(2026, 3, 1): (20260301, 1, 7, 9, True, "Spring", 2026),
        date(2026, 7, 1): (20260701, 3, 3, 27, False, "Summer", 2027),
        date(2027, 1, 1): (20270101, 1, 5, 53, False, "Winter", 2027),
    }
    for day, want in expect.items():
        r = rows[day]
        assert (r["date_key"], r["quarter"], r["day_of_week"], r["week_of_year"], r["is_weekend"], r["season"],
                r["fiscal_year"]) == want
    assert rows[date(2026, 7, 1)]["month_name"] == "July" and rows[date(2026, 7, 1)]["day_name"] == "Wednesday"


def test_time_of_day_dimension(spark):
    dim = time_of_day_dimension(spark, date(2026, 1, 1))
    rows = {r["hour"]: r for r in dim.collect()}
    assert len(rows) == 24 and len(dim.columns) == 10
    expect = {
        0: ("Night", "Late Night", "Night Shift", "Low"), 5: ("Morning", "Late Night", "Night Shift", "Low"),
        6: ("Morning", "Early Morning", "Day Shift", "Low"), 8: ("Morning", "Early Morning", "Day Shift", "High"),
        12: ("Afternoon", "Business Hours", "Day Shift", "Medium"), 17: ("Afternoon", "Business Hours", "Evening Shift", "High"),
        22: ("Evening", "Evening Hours", "Evening Shift", "Medium"), 23: ("Night", "Late Night", "Evening Shift", "Low"),
    }
    for hour, want in expect.items():
        r = rows[hour]
        assert (r["time_period"], r["business_period"], r["police_shift"], r["activity_level"]) == want
    assert rows[7]["hour_display"] == "07:00"


def test_calendar_features_number_sunday_first(spark):
    day = F.lit(date(2026, 3, 1))
    row = spark.range(1).select(*[c.alias(n) for n, c in cal.calendar_features(day).items()]).first()
    assert tuple(row) == (1, 1, 3, 2)
