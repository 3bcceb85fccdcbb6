"""Calendar expressions in the session's time zone. Instants are milliseconds since 1970 in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import COCOA_EPOCH_S, DAY_START_HOUR, MINUTE


def instant(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def effective_day(ms: Column) -> Column:
    """The day that a moment counts for: days begin at 06:00. Earlier moments count for the date six elapsed hours before."""
    at = instant(ms)
    return F.when(F.hour(at) < DAY_START_HOUR, F.to_date(instant(ms - DAY_START_HOUR * 60 * MINUTE))).otherwise(F.to_date(at))


def day_start(day: Column) -> Column:
    """06:00 of a date, in milliseconds."""
    return F.unix_millis(F.make_timestamp(F.year(day), F.month(day), F.day(day), F.lit(DAY_START_HOUR), F.lit(0), F.lit(0)))


def next_day(day: Column) -> Column:
    return F.date_add(day, 1)


def month_days(yyyymm: Column) -> Column:
    """All dates of a month given as yyyyMM."""
    first = F.to_date(F.concat(yyyymm, F.lit("01")), "yyyyMMdd")
    return F.sequence(first, F.last_day(first))


def cocoa_to_ms(seconds: Column) -> Column:
    """Seconds since 2001-01-01 to milliseconds, toward zero."""
    return ((F.lit(float(COCOA_EPOCH_S)) + seconds) * 1000.0).cast("long")


def ms_to_cocoa(ms: Column) -> Column:
    return ms / 1000.0 - COCOA_EPOCH_S


def extended_time(day: Column, ms: Column, up: bool = False) -> Column:
    """HH:MM since midnight of ``day``; hours may pass 24."""
    midnight = F.unix_millis(F.make_timestamp(F.year(day), F.month(day), F.day(day), F.lit(0), F.lit(0), F.lit(0)))
    minutes = (F.ceil if up else F.floor)((ms - midnight) / MINUTE).cast("long")
    return F.format_string("%02d:%02d", F.floor(minutes / 60), F.pmod(minutes, F.lit(60)))


def duration(ms: Column) -> Column:
    """HHhMM, minutes rounded half away from zero."""
    minutes = F.round(ms / float(MINUTE)).cast("long")
    return F.format_string("%02dh%02d", F.floor(minutes / 60), F.pmod(minutes, F.lit(60)))


def weekday(day: Column) -> Column:
    return F.date_format(day, "E")


def month_name(day: Column) -> Column:
    return F.date_format(day, "MMMM")
