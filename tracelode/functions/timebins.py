"""Civil time, bins and stamps as column expressions (zone names are IANA)."""

from __future__ import annotations

from enum import IntEnum

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_S, HOUR_S = 86_400, 3_600


class Frequency(IntEnum):
    """Summary frequencies in minutes; HOURLY_AND_DAILY asks for two outputs."""

    HOURLY_AND_DAILY = -1
    MINUTE = 1
    HOURLY = 60
    THREE_HOURLY = 180
    SIX_HOURLY = 360
    TWELVE_HOURLY = 720
    DAILY = 1440


def _instant(epoch_s: Column) -> Column:
    return F.timestamp_millis(F.floor(epoch_s * 1000).cast("long"))


def local_now(zone: str, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """The time of the query's start as text in ``zone``."""
    return F.date_format(F.from_utc_timestamp(F.current_timestamp(), zone), pattern)


def month_from_today() -> Column:
    """The date 31 days from the query's start, the end of a study that states none."""
    return F.date_add(F.current_date(), 31)


def next_day(day: Column) -> Column:
    return F.date_add(day, 1)


def civil_to_epoch(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column, zone: str) -> Column:
    """Epoch seconds of a civil time in ``zone``."""
    return F.unix_timestamp(F.to_utc_timestamp(F.make_timestamp(year, month, day, hour, minute, second), zone))


def epoch_to_civil(epoch_s: Column, zone: str) -> Column:
    """Struct year, month, day, hour, minute, second of an instant in ``zone``; fractions are cut off."""
    local = F.from_utc_timestamp(_instant(epoch_s), zone)
    parts = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second}
    return F.struct(*[f(local).alias(n) for n, f in parts.items()])


def local_floor(epoch_s: Column, unit: str, zone: str) -> Column:
    """Epoch seconds of the local start of the DAY or HOUR that holds an instant."""
    return F.unix_timestamp(F.to_utc_timestamp(F.date_trunc(unit, F.from_utc_timestamp(_instant(epoch_s), zone)), zone))


def utc_offset_hours(epoch_s: Column, zone: str) -> Column:
    at = _instant(epoch_s)
    return (F.unix_timestamp(F.from_utc_timestamp(at, zone)) - F.unix_timestamp(at)) / HOUR_S


def clock_text(second_of_day: Column) -> Column:
    """"HH:MM" of a second of the day, null beyond 86,400."""
    return F.when(second_of_day <= DAY_S, F.date_format(_instant(second_of_day), "HH:mm"))


def reformat_stamp(text: Column, old: str, new: str) -> Column:
    """Date text in another pattern, null where it can't be read."""
    return F.date_format(F.try_to_timestamp(text, F.lit(old)), new)


def text_to_epoch_ms(text: Column, pattern: str, zone: str) -> Column:
    """Date text in ``zone`` as epoch ms, null where it can't be read."""
    return F.unix_millis(F.to_utc_timestamp(F.try_to_timestamp(text, F.lit(pattern)), zone))


def epoch_ms_to_text(epoch_ms: Column, pattern: str, zone: str) -> Column:
    return F.date_format(F.from_utc_timestamp(F.timestamp_millis(epoch_ms), zone), pattern)


def days_between(first: Column, last: Column) -> Column:
    """Array of all dates from ``first`` to ``last``, both included."""
    return F.sequence(first.cast("date"), last.cast("date"))


def bracket(stamp: Column, unit: int) -> Column:
    """Struct of the multiple of ``unit`` at or before a stamp and the next one."""
    low = stamp - F.pmod(stamp, F.lit(unit))
    return F.struct(low.alias("low"), (low + unit).alias("high"))


def file_name_epoch(name: Column) -> Column:
    """Epoch seconds of the hour that a file name ``YYYY-MM-DD HH_...`` states; else null."""
    hour = F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2} \d{2})_", 1)
    return F.unix_timestamp(F.try_to_timestamp(hour, F.lit("yyyy-MM-dd HH")))


def file_name_local(name: Column, zone: str) -> Column:
    """Local wall time in ``zone`` of a name ``YYYY-MM-DD HH_MM_SS+HH_MM``; else null."""
    stamp = F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2} \d{2}_\d{2}_\d{2}[+-]\d{2}_\d{2})", 1)
    at = F.try_to_timestamp(F.translate(stamp, "_", ":"), F.lit("yyyy-MM-dd HH:mm:ssXXX"))
    return F.from_utc_timestamp(at, zone)
