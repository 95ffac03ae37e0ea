"""Date and time expressions. No function reads the clock: callers pass ``as_of``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from marquee.functions import values as V
from marquee.functions.text import clean, or_empty

LOCAL_ZONE = "Asia/Taipei"


def as_of_date(day: str) -> Column:
    return F.lit(day).cast("date")


def lenient_date(c: Column) -> Column:
    """fn_05: first ten characters, slashes as dashes, unpadded accepted; NULL when invalid."""
    v = F.replace(F.substring(or_empty(c), 1, 10), F.lit("/"), F.lit("-"))
    return F.when(v.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), v.try_cast("date"))


def strict_date(c: Column) -> Column:
    """Year, month and day with nothing after; NULL otherwise."""
    return F.when(c.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), c.try_cast("date"))


def valid_clock(c: Column) -> Column:
    return c.rlike(r"^(?:[01]?\d|2[0-3]):[0-5]?\d$")


def session(c: Column) -> Column:
    """fn_06: struct(date, time) from mixed separators. NULL when the date or clock is invalid.

    The clock needs at least sixteen characters of text; shorter text gives a NULL time.
    """
    text = F.replace(F.replace(clean(c), F.lit("/"), F.lit("-")), F.lit("T"), F.lit(" "))
    day = lenient_date(text)
    clock = F.when(F.length(text) >= 16, F.substring(text, 12, 5))
    ok = day.isNotNull() & (clock.isNull() | valid_clock(clock))
    return F.when(ok, F.struct(day.alias("date"), clock.alias("time")))


def utc_stamp(day: Column, clock: Column) -> Column:
    """fn_07: ISO UTC timestamp text from a date and a strict HH:MM:SSZ clock; NULL when invalid."""
    ok = (
        day.rlike(r"^\d{4}-\d{2}-\d{2}$")
        & day.try_cast("date").isNotNull()
        & clock.rlike(r"^(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\dZ$")
    )
    return F.when(ok, F.concat(day, F.lit("T"), F.substring(clock, 1, 8), F.lit("+00:00")))


def local_time(utc: Column, zone: str = LOCAL_ZONE) -> Column:
    """fn_17: zone-less local time of a zone-less UTC timestamp."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def local_day(utc: Column, zone: str = LOCAL_ZONE) -> Column:
    return F.to_date(local_time(utc, zone))


def cross_day(utc: Column, zone: str = LOCAL_ZONE) -> Column:
    """fn_17: calendar days between the local day and the UTC day."""
    return F.datediff(local_day(utc, zone), F.to_date(utc))


def day_gap(day: Column, base: Column) -> Column:
    """fn_18: days from base to day; NULL when either is unknown."""
    return F.datediff(day, base)


def date_label(start: Column, end: Column) -> Column:
    """fn_19: period text with placeholders for unknown dates."""
    return F.concat(
        F.coalesce(start.cast("string"), F.lit(V.START_UNKNOWN)),
        F.lit(" — "),
        F.coalesce(end.cast("string"), F.lit(V.END_UNKNOWN)),
    )


def date_shaped(c: Column) -> Column:
    """fn_26: looks like YYYY-MM-DD; says nothing about validity."""
    return F.coalesce(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False))


def period_from_dates(dates: Column, open_ended: Column) -> Column:
    """ext_09: struct(start, end, problem) from the explicit dates of a page.

    No date: both unknown. One date: a one-day event, or an unknown end when the text is
    open-ended. Two dates: a range, rejected when reversed. More: rejected.
    """
    n = F.size(dates)
    first = F.when(n >= 1, F.element_at(dates, 1))
    second = F.when(n >= 2, F.element_at(dates, 2))
    start = F.when(n <= 2, first)
    end = F.when((n == 1) & ~open_ended, first).when(n == 2, second)
    problem = (
        F.when(n > 2, F.lit("two explicit dates required"))
        .when((n == 2) & (second < first), F.lit("reversed dates"))
    )
    return F.struct(start.alias("start"), end.alias("end"), problem.alias("problem"))


def sessions_from_points(points: Column) -> Column:
    """ext_08: sessions of a one- or two-point range; points are structs(date, time).

    Same day: the first point only. Up to one day apart: each distinct point. Longer: NULL,
    because a long range does not say which days have a performance. Callers reject zero or
    more than two points beforehand.
    """
    first = F.element_at(points, 1)
    last = F.element_at(points, -1)
    gap = F.datediff(last["date"], first["date"])
    return (
        F.when(gap == 0, F.array(first))
        .when(gap <= 1, F.array_distinct(points))
    )


def hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(3.6e9)


def is_stale(last_success: Column, now: Column) -> Column:
    """cls_10: no success, or the last one more than 36 hours ago."""
    return last_success.isNull() | (hours_between(now, last_success) > V.STALE_HOURS)


def covers(start: Column, end: Column, day: Column) -> Column:
    """flt_02: the day lies in a fully known period."""
    return F.coalesce((start <= day) & (end >= day), F.lit(False))
