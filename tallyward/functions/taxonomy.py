"""Offense taxonomy (B6-B15): fourteen columns derived from type, description and code.

The category is computed once as a column and everything that depends on it reads that column,
so the generated code holds one copy of the membership tests.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.functions.keys import surrogate_key
from tallyward.functions.rules import case_chain, member_chain

# ---------------------------------------------------------------------------------------------
# Offense type lists and labels. They must stay exactly as they are for results to
# match existing tables.
# ---------------------------------------------------------------------------------------------
VIOLENT_TYPES = ["HOMICIDE", "ROBBERY", "BATTERY", "ASSAULT", "KIDNAPPING", "CRIMINAL SEXUAL ASSAULT",
                 "HUMAN TRAFFICKING", "INTIMIDATION", "STALKING"]
SEX_TYPES = ["CRIMINAL SEXUAL ASSAULT", "SEX OFFENSE", "PROSTITUTION", "OFFENSE INVOLVING CHILDREN"]
WEAPON_TYPES = ["WEAPONS VIOLATION", "CONCEALED CARRY LICENSE VIOLATION"]
DRUG_TYPES = ["NARCOTICS", "OTHER NARCOTIC VIOLATION", "CANNABIS", "LIQUOR LAW VIOLATION"]
PROPERTY_TYPES = ["THEFT", "MOTOR VEHICLE THEFT", "BURGLARY", "CRIMINAL DAMAGE", "CRIMINAL TRESPASS",
                  "ARSON", "DECEPTIVE PRACTICE", "STOLEN PROPERTY", "OTHER OFFENSE"]
PUBLIC_ORDER_TYPES = ["PUBLIC PEACE VIOLATION", "INTERFERENCE WITH PUBLIC OFFICER", "OBSCENITY", "GAMBLING",
                      "RITUALISM", "NON-CRIMINAL", "NON-CRIMINAL (SUBJECT SPECIFIED)", "NON - CRIMINAL"]

CATEGORY_TABLE = [
    ("Violent", VIOLENT_TYPES),
    ("Sex offense", SEX_TYPES),
    ("Weapons", WEAPON_TYPES),
    ("Drug", DRUG_TYPES),
    ("Property", PROPERTY_TYPES),
    ("Public order", PUBLIC_ORDER_TYPES),
]
FBI_LABELS = {
    "Violent": "Violent Crime",
    "Property": "Property Crime",
    "Drug": "Drug Crime",
    "Weapons": "Weapons Crime",
    "Sex offense": "Sex Crime",
    "Public order": "Public Order Crime",
}
GROUP_OF_TYPE = [
    ("HOMICIDE", "Homicide"),
    ("ROBBERY", "Robbery"),
    ("BATTERY", "Battery"),
    ("ASSAULT", "Assault"),
    ("CRIMINAL SEXUAL ASSAULT", "Sexual assault"),
    ("SEX OFFENSE", "Sex offense"),
    ("BURGLARY", "Burglary"),
    ("THEFT", "Theft"),
    ("MOTOR VEHICLE THEFT", "Motor vehicle theft"),
    ("DECEPTIVE PRACTICE", "Fraud / deception"),
    ("CRIMINAL DAMAGE", "Criminal damage"),
    ("CRIMINAL TRESPASS", "Criminal trespass"),
    ("ARSON", "Arson"),
    ("OFFENSE INVOLVING CHILDREN", "Child-related offense"),
    ("PROSTITUTION", "Commercial sex offense"),
]
GROUP_OF_LIST = [
    ("Drug offense", DRUG_TYPES),
    ("Weapons offense", WEAPON_TYPES),
    ("Public order offense", PUBLIC_ORDER_TYPES),
]
AGGRAVATED_GROUPS = [("BATTERY", "Aggravated battery"), ("ASSAULT", "Aggravated assault")]
SEVERITY_TABLE = [
    ("High", ["HOMICIDE", "CRIMINAL SEXUAL ASSAULT", "HUMAN TRAFFICKING"]),
    ("Medium", ["ROBBERY", "BATTERY", "ASSAULT", "KIDNAPPING", "WEAPONS VIOLATION",
                "CONCEALED CARRY LICENSE VIOLATION", "ARSON"]),
    ("Low", ["THEFT", "MOTOR VEHICLE THEFT", "BURGLARY", "CRIMINAL DAMAGE", "CRIMINAL TRESPASS",
             "DECEPTIVE PRACTICE", "NARCOTICS", "OTHER NARCOTIC VIOLATION", "CANNABIS", "LIQUOR LAW VIOLATION"]),
]
CLEARANCE_TABLE = [
    ("High", ["HOMICIDE", "CRIMINAL SEXUAL ASSAULT"]),
    ("Medium", ["ROBBERY", "BATTERY", "ASSAULT", "BURGLARY"]),
    ("Low", ["THEFT", "MOTOR VEHICLE THEFT", "CRIMINAL DAMAGE", "DECEPTIVE PRACTICE"]),
]
FLAG_CATEGORY = {
    "violent_crime_flag": "Violent",
    "property_crime_flag": "Property",
    "drug_crime_flag": "Drug",
    "weapon_crime_flag": "Weapons",
}
TAXONOMY_COLUMNS = [
    "crime_type_key", "crime_primary_type_clean", "crime_description_clean", "crime_offense_label",
    "crime_category", "crime_offense_group", "crime_offense_subtype", "crime_severity_level",
    "crime_fbi_classification", "crime_clearance_bucket",
    "violent_crime_flag", "property_crime_flag", "drug_crime_flag", "weapon_crime_flag",
]
# ---------------------------------------------------------------------------------------------

CANONICAL = ["_canonical_type", "_canonical_description", "_canonical_code"]


def canonical(value: Column, default: str) -> Column:
    """Upper-case, trimmed, with a default for null."""
    return F.upper(F.trim(F.coalesce(value, F.lit(default))))


def display_text(value: Column, default: str = "Unknown") -> Column:
    """Title-cased and trimmed for display."""
    return F.trim(F.initcap(F.lower(F.coalesce(value, F.lit(default)))))


def offense_category(raw_type: Column, type_: Column, table: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """A null raw type is Unknown, otherwise the first list that holds the type, else Other."""
    return F.when(raw_type.isNull(), F.lit("Unknown")).otherwise(member_chain(type_, table, "Other"))


def offense_group(type_: Column, description: Column, fallback: Column) -> Column:
    """Aggravated variants first, then single types, then whole lists, then the display name."""
    aggravated = [((type_ == t) & description.contains("AGGRAVATED"), g) for t, g in AGGRAVATED_GROUPS]
    single = [(type_ == t, g) for t, g in GROUP_OF_TYPE]
    listed = [(type_.isin(*members), g) for g, members in GROUP_OF_LIST]
    return case_chain(aggravated + single + listed, fallback)


def add_taxonomy(
    df: DataFrame,
    type_col: str = "primary_type",
    description_col: str = "description",
    code_col: str = "iucr",
    key_method: str = "xxhash64",
    category_table: Sequence[tuple[str, Sequence[str]]] = CATEGORY_TABLE,
) -> DataFrame:
    """Add the fourteen taxonomy columns (B6-B14). The canonical texts are columns for the time being: rules read them, each is made once."""
    type_, description, code = (F.col(c) for c in CANONICAL)
    base = df.withColumns(dict(zip(CANONICAL, (
        canonical(F.col(type_col), "Unknown"), canonical(F.col(description_col), "Unknown"), canonical(F.col(code_col), "0000"))))).withColumns({
        "crime_type_key": surrogate_key([code, type_, description], key_method),
        "crime_primary_type_clean": display_text(F.col(type_col)),
        "crime_description_clean": display_text(F.col(description_col)),
        "crime_offense_label": F.concat_ws(" | ", code, type_, description),
        "crime_category": offense_category(F.col(type_col), type_, category_table),
        "crime_severity_level": member_chain(type_, SEVERITY_TABLE, "Variable"),
        "crime_clearance_bucket": member_chain(type_, CLEARANCE_TABLE, "Variable"),
    })
    category = F.col("crime_category")
    derived = {
        "crime_offense_group": offense_group(type_, description, F.col("crime_primary_type_clean")),
        "crime_offense_subtype": F.col("crime_description_clean"),
        "crime_fbi_classification": case_chain([(category == c, v) for c, v in FBI_LABELS.items()], "Other Crime"),
    }
    flags = {name: F.when(category == c, 1).otherwise(0) for name, c in FLAG_CATEGORY.items()}
    out = base.withColumns({**derived, **flags})
    return out.select(*[c for c in df.columns if c not in TAXONOMY_COLUMNS], *TAXONOMY_COLUMNS)


def ensure_taxonomy(df: DataFrame, **kwargs) -> DataFrame:
    """Leave a complete frame alone; otherwise drop partial columns and recompute all of them."""
    present = [c for c in TAXONOMY_COLUMNS if c in df.columns]
    if len(present) == len(TAXONOMY_COLUMNS):
        return df
    return add_taxonomy(df.drop(*present), **kwargs)
