"""Typed time of a log line from the text found in it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: month names of log lines ----

MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")

# ---- end of fixed values ----

_ZONED = r"(?:Z|[+-]\d{2}:\d{2})$"


def dated_time(time: Column) -> Column:
    """Timestamp of a text that names its day and year; null for others.

    Without a zone, the text counts as UTC.
    """
    plain = F.translate(time, ", ", ".T")
    colon = F.regexp_replace(plain, r"([+-]\d{2})(\d{2})$", "$1:$2")
    iso = F.when(colon.rlike(_ZONED), colon).otherwise(F.concat(colon, F.lit("Z")))
    web = F.when(time.contains(" "), time).otherwise(F.concat(time, F.lit(" +0000")))
    return (
        F.when(time.rlike(r"^\d{4}-"), iso.try_cast("timestamp"))
        .when(time.rlike(r"^\d{2}/"), F.try_to_timestamp(web, F.lit("dd/MMM/yyyy:HH:mm:ss Z")))
    )


def names_day(time: Column) -> Column:
    """Whether a text without a year names month and day."""
    return time.rlike(r"^[A-Z][a-z]{2} [ \d]\d ")


def names_clock(time: Column) -> Column:
    """Whether a text is a time of day alone."""
    return time.rlike(r"^\d{2}:\d{2}:\d{2}")


def _nearest(candidates: Column, anchor: Column) -> Column:
    """The candidate closest to ``anchor``, the earlier of equals; nulls are left out."""
    distance = F.transform(
        F.array_compact(candidates),
        lambda t: F.struct(F.abs(F.unix_micros(t) - F.unix_micros(anchor)).alias("off"), t.alias("time")),
    )
    return F.array_min(distance)["time"]


def _clock(time: Column) -> tuple[Column, Column, Column]:
    text = F.substring_index(time, " ", -1)
    parts = F.split(F.replace(text, F.lit(","), F.lit(".")), ":")
    return F.get(parts, 0).try_cast("int"), F.get(parts, 1).try_cast("int"), F.get(parts, 2).try_cast("decimal(16,6)")


def _at(year: Column, month: Column, day: Column, clock: tuple[Column, Column, Column]) -> Column:
    return F.try_make_timestamp(year, month, day, *clock, F.lit("UTC"))


def time_near(time: Column, anchor: Column) -> Column:
    """Timestamp of a text without year or day, chosen to lie as near as possible to ``anchor``.

    A text with month and day may fall in the year before or after, a time of
    day on the day before or after; so New Year and midnight roll over.
    """
    clock = _clock(time)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(time, 1, 3)).cast("int")
    day = F.trim(F.substring(time, 5, 2)).try_cast("int")
    years = F.array(*(_at(F.year(anchor) + i, month, day, clock) for i in (-1, 0, 1)))
    days = F.array(
        *(_at(F.year(d), F.month(d), F.day(d), clock) for d in (F.date_add(F.to_date(anchor), i) for i in (-1, 0, 1)))
    )
    return F.when(names_day(time) & (month > 0), _nearest(years, anchor)).when(names_clock(time), _nearest(days, anchor))
