"""Dates against an explicit present."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000.0
DUE_SOON_DAYS = 3


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def days_between(since: Column, as_of: Column) -> Column:
    """Fractional days."""
    return (micros(as_of) - micros(since)) / DAY_MICROS


def health_status(due: Column, as_of: Column) -> Column:
    """stalled after the date, due_soon up to three days before, else on_track; null without a date."""
    left = F.datediff(due, as_of)
    return F.when(left < 0, "stalled").when(left <= DUE_SOON_DAYS, "due_soon").when(due.isNotNull(), "on_track")


def health_label(status: Column) -> Column:
    return F.when(status == "on_track", "On track").when(status == "due_soon", "Due soon").when(status.isNotNull(), "Stalled")


def relative_day(ts: Column, as_of: Column) -> Column:
    days = F.floor(days_between(ts, as_of))
    return F.when(days <= 0, "today").when(days == 1, "yesterday").otherwise(F.concat(days.cast("string"), F.lit(" days ago")))


def day_text(ts: Column, shift: int = 0) -> Column:
    return F.date_format(F.date_add(ts.cast("date"), shift), "yyyy-MM-dd")


def greeting(ts: Column) -> Column:
    return F.when(F.hour(ts) < 12, "Good morning").when(F.hour(ts) < 18, "Good afternoon").otherwise("Good evening")


def short_day(c: Column) -> Column:
    return F.date_format(c, "MMM d")
