"""Epoch milliseconds from the stamp columns of the streams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An epoch count below the first is in seconds, below the second in
#: milliseconds, below the third in microseconds, else in nanoseconds.
UNIT_LIMITS = (100_000_000_000, 100_000_000_000_000, 100_000_000_000_000_000)


def epoch_ms(count: Column) -> Column:
    """An integer epoch count in s, ms, us or ns as ms; finer digits are cut off, null stays null."""
    seconds, millis, micros = UNIT_LIMITS
    size = F.abs(count)
    return (
        F.when(size < seconds, count * 1000)
        .when(size < millis, count)
        .when(size < micros, F.floor(count / F.lit(1000).cast("decimal(4,0)")).cast("long"))
        .otherwise(F.floor(count / F.lit(1_000_000).cast("decimal(7,0)")).cast("long"))
    )


def stamp_ms(stamp: Column) -> Column:
    """A TIMESTAMP or TIMESTAMP_NTZ (taken as UTC) as epoch ms; finer digits are cut off."""
    return F.expr("null").cast("long") if stamp is None else F.floor(F.unix_micros(stamp.cast("timestamp")) / F.lit(1000).cast("decimal(4,0)")).cast("long")


def iso_ms(text: Column) -> Column:
    """ISO text (blank or T between date and time, Z or no zone) as epoch ms; unreadable gives null."""
    return stamp_ms(F.try_to_timestamp(F.trim(text)))


def survey_instant() -> Column:
    """Instant of a survey_timings row: ``timestamp`` in any unit, else ``utc_time``."""
    return F.coalesce(epoch_ms(F.col("timestamp")), stamp_ms(F.col("utc_time")))


def sensor_instant() -> Column:
    """Instant of a gps or accelerometer row: ``timestamp`` in ms, else the ISO ``utc_time``."""
    return F.coalesce(F.col("timestamp"), iso_ms(F.col("utc_time")))
