"""Column functions on Unix seconds (UTC unless the session time zone says otherwise)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86400


def at(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def key(seconds: Column, pattern: str) -> Column:
    """Text key of a moment: ``yyyy``, ``yyyy-MM``, ``yyyy-MM-dd``, ``MMMM yyyy`` and so on."""
    return F.date_format(at(seconds), pattern)


def day(seconds: Column) -> Column:
    return F.to_date(at(seconds))


def civil(seconds: Column) -> Column:
    """year, month, day, hour, minute, second of a moment."""
    t = at(seconds)
    return F.struct(*[f(t).alias(n) for n, f in (("year", F.year), ("month", F.month), ("day", F.dayofmonth), ("hour", F.hour), ("minute", F.minute), ("second", F.second))])


def exif_seconds(text: Column) -> Column:
    """Unix seconds of ``YYYY:MM:DD HH:MM:SS`` (or with dashes), null unless it is a date of 1900 to 2200."""
    plain = F.regexp_replace(text, r"^(\d{4})[:-](\d{2})[:-](\d{2})[ T](\d{2}:\d{2}:\d{2}).*$", "$1-$2-$3 $4")
    t = F.when(plain.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"), F.try_to_timestamp(plain, F.lit("yyyy-MM-dd HH:mm:ss")))
    return F.when(F.year(t).between(1900, 2200), F.unix_timestamp(t))


def near_anniversary(seconds: Column, year: int, month: int, day_: int, days: int = 3) -> Column:
    """Within ``days`` of the day in the moment's own year; an impossible 29 February counts as 1 March.

    The window does not wrap across New Year.
    """
    own = F.year(at(seconds))
    leap_day = month == 2 and day_ == 29
    there = F.make_date(own, F.lit(month), F.lit(28 if leap_day else day_))
    if leap_day:
        there = F.date_add(there, 1)
    return (F.abs(F.datediff(day(seconds), there)) <= days) & (own < year)


def days_span(first: Column, last: Column) -> Column:
    return F.datediff(day(last), day(first)) + 1
