"""Date rules with an explicit clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def today_iso(now: Column) -> Column:
    return F.date_format(now, "yyyy-MM-dd")


def resolve_tonight(now: Column, hour: int = 21) -> Column:
    """Today at ``hour``, or tomorrow if that isn't after ``now`` (in the session's time zone)."""
    tonight = F.date_trunc("day", now) + F.expr(f"INTERVAL {hour} HOURS")
    return F.when(tonight <= now, tonight + F.expr("INTERVAL 1 DAY")).otherwise(tonight)


def format_day(at: Column, now: Column) -> Column:
    days = F.datediff(at, now)
    text = days.cast("string")
    month = F.element_at(F.array(*map(F.lit, MONTHS)), F.month(at))
    return (
        F.when(at.isNull(), "")
        .when(days == 0, "Today")
        .when(days == -1, "Yesterday")
        .when(days == 1, "Tomorrow")
        .when((days < 0) & (days > -7), F.concat((-days).cast("string"), F.lit(" days ago")))
        .when((days > 0) & (days < 7), F.concat(F.lit("In "), text, F.lit(" days")))
        .otherwise(F.concat_ws(" ", month, F.dayofmonth(at).cast("string")))
    )


def format_time(at: Column) -> Column:
    hour = F.hour(at)
    shown = F.when(hour % 12 == 0, 12).otherwise(hour % 12).cast("string")
    text = F.concat(shown, F.lit(":"), F.lpad(F.minute(at).cast("string"), 2, "0"), F.when(hour >= 12, " pm").otherwise(" am"))
    return F.when(at.isNull(), "").otherwise(text)


def _minutes(a: Column, b: Column) -> Column:
    """Minutes from a to b, halves up."""
    us = F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))
    return F.floor(us / 60_000_000 + 0.5)


def format_due(at: Column, now: Column) -> Column:
    away, day = _minutes(now, at), format_day(at, now)
    return (
        F.when(at.isNull(), "No date yet")
        .when(away <= 0, "Due now")
        .when(away < 60, F.concat(F.lit("In "), away.cast("string"), F.lit(" min")))
        .otherwise(F.concat(day, F.lit(", "), format_time(at)))
    )


def format_duration(start: Column, end: Column) -> Column:
    return F.when(end.isNull(), "").otherwise(F.concat(F.greatest(F.lit(1), _minutes(start, end)).cast("string"), F.lit(" min")))
