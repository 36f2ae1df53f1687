"""Time helpers. All of them work on zone-less timestamps, so none depends on the session zone."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillroll.functions.text import blank_to_null, by_value

# Zone abbreviations that stand for one offset all year.
ZONE_OFFSETS = {
    "UTC": "+00:00",
    "GMT": "+00:00",
    "PST": "-08:00",
    "PDT": "-07:00",
    "MST": "-07:00",
    "MDT": "-06:00",
    "CST": "-06:00",
    "CDT": "-05:00",
    "EST": "-05:00",
    "EDT": "-04:00",
}
PACIFIC = "America/Los_Angeles"


def wall_clock(text: Column) -> Column:
    """The local time of text like '2024-01-15 12:00:00 PST'; the zone token is left aside."""
    return F.substring_index(text, " ", 2).cast("timestamp_ntz")


def zone_token(text: Column) -> Column:
    """The zone token of such text, '' when it has none."""
    return F.split_part(text, F.lit(" "), F.lit(3))


def to_utc(text: Column) -> Column:
    """The same instant as a UTC wall clock; text without a zone is already UTC."""
    token = zone_token(text)
    zone = by_value(token, {"": "+00:00", **ZONE_OFFSETS}, default=token)
    return F.convert_timezone(zone, F.lit("UTC"), wall_clock(text))


def in_zone(utc: Column, zone: str = PACIFIC) -> Column:
    """A UTC wall clock as the wall clock of another zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def from_epoch(seconds: Column) -> Column:
    """Epoch seconds as a UTC wall clock."""
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return origin + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def us_date(text: Column) -> Column:
    """'1/5/2024' or '01/05/2024' as a date; blank is NULL, anything else raises."""
    return F.to_date(blank_to_null(text), "M/d/yyyy")


def month_of(value: Column) -> Column:
    """First day of the month, as a date."""
    return F.trunc(value.cast("date"), "month")


def rolling_months(day: Column, as_of: date, months: int) -> Column:
    """A date within the `months` before `as_of`, that day itself excluded. The bounds are literals,
    so parquet row groups outside them are not read; with a zone-less timestamp all of them would be."""
    return (day >= F.add_months(F.lit(as_of), -months)) & (day < F.lit(as_of))


def months_since(start: Column, at: Column) -> Column:
    """Whole months from `start` to `at`: the last month whose billing day has come. A billing day
    that a short month lacks falls on that month's last day."""
    first, day = start.cast("date"), at.cast("date")
    months = (F.year(day) - F.year(first)) * 12 + F.month(day) - F.month(first)
    return months - F.when(F.add_months(first, months) > day, 1).otherwise(0)


def days_in_month(value: Column) -> Column:
    return F.dayofmonth(F.last_day(value.cast("date")))


def days_to_next_year(value: Column) -> Column:
    """Days from a date to the same date a year later."""
    day = value.cast("date")
    return F.datediff(F.add_months(day, 12), day)
