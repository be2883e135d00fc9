"""Calendar and clock expressions (B23, B26-B30, B34 and the parts of G1, G2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyward.functions.rules import case_chain

# Month groups with their label and number.
SEASONS = [("Winter", 1, [12, 1, 2]), ("Spring", 2, [3, 4, 5]), ("Summer", 3, [6, 7, 8]), ("Fall", 4, [9, 10, 11])]
FISCAL_YEAR_START_MONTH = 7

# Hour bands. Hours outside every band take the default.
TIME_PERIODS = ([("Morning", [(5, 11)]), ("Afternoon", [(12, 17)]), ("Evening", [(18, 22)])], "Night")
BUSINESS_PERIODS = (
    [("Business Hours", [(9, 17)]), ("Evening Hours", [(18, 22)]), ("Late Night", [(23, 23), (0, 5)])],
    "Early Morning",
)
POLICE_SHIFTS = ([("Day Shift", [(6, 14)]), ("Evening Shift", [(15, 23)])], "Night Shift")
ACTIVITY_LEVELS = ([("High", [(7, 9), (17, 19)]), ("Medium", [(10, 16), (20, 22)])], "Low")


def _banded(hour: Column, bands) -> Column:
    table, default = bands
    branches = []
    for label, ranges in table:
        test = F.lit(False)
        for low, high in ranges:
            test = test | hour.between(low, high)
        branches.append((test, label))
    return case_chain(branches, default)


def time_period(hour: Column) -> Column:
    return _banded(hour, TIME_PERIODS)


def business_period(hour: Column) -> Column:
    return _banded(hour, BUSINESS_PERIODS)


def police_shift(hour: Column) -> Column:
    return _banded(hour, POLICE_SHIFTS)


def activity_level(hour: Column) -> Column:
    return _banded(hour, ACTIVITY_LEVELS)


def hour_display(hour: Column) -> Column:
    return F.format_string("%02d:00", hour)


def season_name(month: Column) -> Column:
    return case_chain([(month.isin(*months), name) for name, _, months in SEASONS], F.lit(None).cast("string"))


def season_number(month: Column) -> Column:
    """Season 1-4 used as a model feature; a missing month counts as 1."""
    return case_chain([(month.isin(*months), number) for _, number, months in SEASONS], 1)


def iso_weekday(day: Column) -> Column:
    """1=Monday..7=Sunday (date dimension)."""
    return (F.weekday(day) + 1).cast("int")


def weekend_flag(sunday_first_day: Column) -> Column:
    """1 on Saturday and Sunday of the 1=Sunday numbering, else 0."""
    return F.when(sunday_first_day.isin(1, 7), 1).otherwise(0)


def fiscal_year(day: Column) -> Column:
    shift = F.when(F.month(day) < FISCAL_YEAR_START_MONTH, 0).otherwise(1)
    return (F.year(day) + shift).cast("int")


def calendar_features(day: Column) -> dict[str, Column]:
    """day_of_week (1=Sunday), is_weekend, month, season."""
    return {
        "day_of_week": F.dayofweek(day),
        "is_weekend": weekend_flag(F.dayofweek(day)),
        "month": F.month(day),
        "season": season_number(F.month(day)),
    }
