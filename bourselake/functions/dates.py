"""Date rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The one accepted text form of a trading day, and the other spellings sources use.
ISO_DAY = r"^\d{4}-\d{2}-\d{2}$"
OTHER_DAY_FORMATS = ("MMM d, yyyy", "MMMM d, yyyy", "yyyy/MM/dd", "M/d/yyyy")


def day(text: Column, fmt: str = "yyyy-MM-dd") -> Column:
    """A date parsed with one format, or null."""
    return F.try_to_timestamp(text, F.lit(fmt)).cast("date")


def is_iso_day(text: Column) -> Column:
    return text.rlike(ISO_DAY)


def normalize_date(text: Column) -> Column:
    """ISO days and spelled-out days (quotes dropped) as dates; anything else is null."""
    s = F.trim(F.regexp_replace(text, '"', ""))
    iso = F.when(is_iso_day(s), day(s))
    return F.coalesce(iso, *[day(s, f) for f in OTHER_DAY_FORMATS])


def well_formed_day(text: Column) -> Column:
    """True for a plain day; timestamps that slipped into a day column give false."""
    return ~text.contains("T") & ~text.contains(":")


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)


def add_years(date: Column, years: int) -> Column:
    """Calendar year shift; February 29 moves to March 1 when the target year has no leap day."""
    shifted = F.add_months(date, 12 * years)
    leap_day = (F.month(date) == 2) & (F.dayofmonth(date) == 29)
    return F.when(leap_day & (F.dayofmonth(shifted) == 28), F.date_add(shifted, 1)).otherwise(shifted)


def year_span(later: Column, earlier: Column) -> Column:
    """Years between two dates at 365.25 days per year."""
    return F.datediff(later, earlier).cast("double") / 365.25
