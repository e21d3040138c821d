"""Named statistics, windows and calendar rules as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Name -> aggregate of a numeric column; percentiles are linear, deviations those of a sample.
STATISTICS: dict[str, Callable[[Column], Column]] = {
    "range": lambda c: F.max(c) - F.min(c),
    "iqr": lambda c: F.percentile(c, F.lit(0.75)) - F.percentile(c, F.lit(0.25)),
    "std": F.stddev_samp,
    "var": F.var_samp,
    "mean": F.avg,
    "median": F.median,
}


def describe(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """All named statistics of a column per key, and how many values it has; nulls don't count."""
    return df.groupBy(*keys).agg(F.count(column).alias("n"), *[f(F.col(column)).alias(n) for n, f in STATISTICS.items()])


def window_counts(df: DataFrame, keys: Sequence[str], at: Column, width: int) -> DataFrame:
    """Rows per window of ``width`` that starts at a multiple of it, empty windows left out."""
    start = at - F.pmod(at, F.lit(width))
    return df.where(at.isNotNull()).groupBy(*keys, start.alias("window_start")).agg(F.count(F.lit(1)).alias("n_rows"))


def window_rows(df: DataFrame, keys: Sequence[str], at: Column, width: int, row: str) -> DataFrame:
    """``*keys, window_start, rows``: the values of ``row`` in each window in order of time; a window's rows are held together, so ``width`` bounds them."""
    start = at - F.pmod(at, F.lit(width))
    grouped = df.where(at.isNotNull()).groupBy(*keys, start.alias("window_start")).agg(F.sort_array(F.collect_list(F.struct(at.alias("t"), F.col(row).alias("r")))).alias("s"))
    return grouped.select(*keys, "window_start", F.col("s.r").alias("rows"))


def gap_multiplier(seconds: Column) -> Column:
    """1, 5, 10 or 50 for lengths below half an hour, 3 hours, 18 hours and beyond."""
    return F.when(seconds <= 1800, 1).when(seconds <= 10_800, 5).when(seconds <= 64_800, 10).otherwise(50)


#: Federal holidays as (month, day) and as (month, weekday from Monday 0, which one in the month; -1 is the last).
FIXED_HOLIDAYS = ((1, 1), (6, 19), (7, 4), (11, 11), (12, 25))
MOVING_HOLIDAYS = ((1, 0, 3), (2, 0, 3), (5, 0, -1), (9, 0, 1), (10, 0, 2), (11, 3, 4))
JUNETEENTH_SINCE = 2021


def _fixed_holiday(day: Column) -> Column:
    any_of = F.lit(False)
    for month, number in FIXED_HOLIDAYS:
        here = (F.month(day) == month) & (F.dayofmonth(day) == number)
        any_of = any_of | (here & (F.year(day) >= JUNETEENTH_SINCE) if month == 6 else here)
    return any_of


def is_us_holiday(day: Column) -> Column:
    """Whether a date of any year is a federal holiday by today's rules, or the Friday or Monday on which one of a weekend is observed; null dates are none."""
    day = day.cast("date")
    found = _fixed_holiday(day)
    found = found | ((F.weekday(day) == 4) & _fixed_holiday(F.date_add(day, 1))) | ((F.weekday(day) == 0) & _fixed_holiday(F.date_add(day, -1)))
    for month, weekday, which in MOVING_HOLIDAYS:
        place = F.dayofmonth(day) > F.dayofmonth(F.last_day(day)) - 7 if which < 0 else F.ceil(F.dayofmonth(day) / 7) == which
        found = found | ((F.month(day) == month) & (F.weekday(day) == weekday) & place)
    return F.coalesce(found, F.lit(False))
