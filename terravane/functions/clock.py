"""Wall clocks, offsets and zones as Column expressions on microseconds since 1970 (any session time zone)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SECOND = 1_000_000
DAY = 86_400 * SECOND

# Zone abbreviations and their hours from UTC.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "UT": 0,
    "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7,
    "AKST": -9, "AKDT": -8, "HST": -10, "AST": -4, "ADT": -3, "NST": -3.5, "NDT": -2.5,
    "WET": 0, "WEST": 1, "CET": 1, "CEST": 2, "MEZ": 1, "MESZ": 2, "EET": 2, "EEST": 3, "BST": 1, "IST": 5.5, "JST": 9,
}
# Month names.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def month_number(name: Column) -> Column:
    """1 to 12 for the first three letters of an English month name, null for others."""
    at = F.instr(F.lit("".join(MONTHS)), F.lower(name))
    return F.when((F.length(name) == 3) & (at % 3 == 1), ((at + 2) / 3).cast("int"))


def civil_days(year: Column, month: Column, day: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date; null unless it is a real date."""
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    length = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    moved = F.when(month <= 2, year - 1).otherwise(year)
    era = F.floor(moved / 400).cast("bigint")
    of_era = moved - era * 400
    of_year = F.floor((153 * (month + F.when(month > 2, -3).otherwise(9)) + 2) / 5) + day - 1
    days = era * 146097 + of_era * 365 + F.floor(of_era / 4) - F.floor(of_era / 100) + of_year - 719468
    return F.when((month >= 1) & (month <= 12) & (day >= 1) & (day <= length), days.cast("bigint"))


def wall_micros(days: Column, hour: Column, minute: Column, second: Column, micro: Column) -> Column:
    """Microseconds of a wall clock as if it were UTC; null unless it is a real time of day."""
    real = hour.between(0, 23) & minute.between(0, 59) & second.between(0, 59)
    return F.when(real, days * DAY + (hour * 3600 + minute * 60 + second).cast("bigint") * SECOND + micro)


def offset_micros(text: Column) -> Column:
    """``+hh``, ``+hhmm``, ``+hh:mm`` (with or without ``UTC``/``GMT`` before) to microseconds, else null."""
    # What does not start like an offset is not matched.
    like = F.when(F.substring(text, 1, 1).isin("+", "-", "U", "u", "G", "g"), text)
    signed = F.regexp_extract(like, r"^(?:[Uu][Tt][Cc]|[Gg][Mm][Tt])?([+-](?:0\d|1[0-8])(?::?[0-5]\d)?)$", 1)
    minutes = F.substring(signed, 2, 2).cast("int") * 60 + F.coalesce(F.substring(signed, -2, 2).cast("int") * (F.length(signed) > 3).cast("int"), F.lit(0))
    return F.when(F.length(signed) > 0, minutes.cast("bigint") * F.when(F.substring(signed, 1, 1) == "-", -60 * SECOND).otherwise(60 * SECOND))


def zone_names(spark: SparkSession) -> DataFrame:
    """``_zone_key, _zone_name, _zone_fixed``: lower-case and proper names of the regions the JVM knows, and
    abbreviations with their fixed offset in microseconds (some 650 rows in all)."""
    ids = sorted(spark._jvm.java.time.ZoneId.getAvailableZoneIds().toArray())
    regions = {i.lower(): f"('{i.lower()}', '{i}', CAST(NULL AS BIGINT))" for i in ids if "/" in i and not i.startswith("SystemV/")}
    short = {a.lower(): f"('{a.lower()}', CAST(NULL AS STRING), {int(h * 3600) * SECOND}L)" for a, h in ABBREVIATIONS.items()}
    rows = ", ".join((regions | short).values())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(_zone_key, _zone_name, _zone_fixed)")


def in_zone(utc: Column, zone: Column) -> Column:
    """Wall clock in ``zone`` at an instant, both in microseconds."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(utc), zone))
