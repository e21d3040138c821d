"""Mixed stamp notations to one UTC instant.

All notations are compiled into one alternation with named groups. One pass of it over the
text puts the components into fixed places; calendar ranges are then checked and the instant is
assembled with integer day arithmetic. Everything stays in JVM expressions.
"""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Minutes east of UTC of zone abbreviations.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "IST": 330, "NPT": 345, "AWST": 480, "JST": 540, "KST": 540, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660,
    "NZST": 720, "NZDT": 780, "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360,
    "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}

MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_MONTH_NAME = "(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
_WEEKDAY = "(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\\s+)?"

#: Dates that a clock time may follow.
DATE_FORMATS = (
    r"(?<y1>\d{4})-(?<mo1>\d{2})-(?<d1>\d{2})",
    r"(?<y2>\d{4})-(?<doy>\d{3})",
    _WEEKDAY + r"(?<d3>\d{1,2})\s+(?<mn3>" + _MONTH_NAME + r")\.?,?\s+(?<y3>\d{4})",
    _WEEKDAY + r"(?<mn4>" + _MONTH_NAME + r")\.?\s+(?<d4>\d{1,2}),?\s+(?<y4>\d{4})",
    r"(?<a5>\d{1,2})[/.\-](?<b5>\d{1,2})[/.\-](?<y5>\d{4}|\d{2})",
)
_CLOCK = r"(?<h>\d{1,2})[:_](?<mi>\d{2})(?:[:_](?<s>\d{2})(?:[.,](?<f>\d+))?)?\s*(?<ap>[ap]\.?m\.?)?"
_ZONE = (
    r"\s*(?:(?<zu>z|utc|gmt)?(?:(?<zs>[+-])(?<zh>\d{1,2})(?:[:_]?(?<zm>\d{2}))?)?|(?<za>[a-z]{2,5}))"
    r"\s*(?:\[(?<zn>[a-z][a-z_/+\-0-9]*)\])?"
)
#: Whole notations without separators.
COUNTS = (
    r"(?<e>\d{9,10}|\d{12,13}|\d{15,16}|\d{18,19})(?:\.(?<ef>\d*))?",
    r"(?<eg>\d{1,3}(?:,\d{3}){2,6})",
    r"(?<y6>\d{4})(?<mo6>\d{2})(?<d6>\d{2})t?(?<h6>\d{2})(?<mi6>\d{2})(?<s6>\d{2})(?<z6>z)?",
)
ALTERNATION = (
    "(?is)^[\\s\"'\\u00a0\\u202f\\u200b\\ufeff]*(?:"
    + "|".join([*COUNTS, "(?:" + "|".join(DATE_FORMATS) + r")(?:[t _]|,?\s+)" + _CLOCK + _ZONE])
    + ")[\\s\"'\\u00a0\\u202f\\u200b\\ufeff]*$"
)
#: Component -> the groups that may hold it; at most one of them took part in the match.
COMPONENTS = {
    "count": ("e", "eg"), "count_rest": ("ef",), "year": ("y1", "y2", "y3", "y4", "y5", "y6"), "month": ("mo1", "mo6"),
    "month_name": ("mn3", "mn4"), "day": ("d1", "d3", "d4", "d6"), "day_of_year": ("doy",), "one": ("a5",), "two": ("b5",),
    "hour": ("h", "h6"), "minute": ("mi", "mi6"), "second": ("s", "s6"), "fraction": ("f",), "half": ("ap",),
    "utc": ("zu", "z6"), "sign": ("zs",), "zone_h": ("zh",), "zone_m": ("zm",), "abbreviation": ("za",), "zone": ("zn",),
}
_MARK = "\u0001"
#: Blanks that writers of dates put between the clock and AM or PM, or around a value.
WIDE_BLANKS = "\u00a0\u2002\u2003\u2007\u2009\u202f\u3000"


def _whole_number(text: Column) -> Column:
    """A run of digits as a number, else null; failing casts would cost an exception each."""
    return F.when((F.length(text) > 0) & (F.translate(text, "0123456789", "") == ""), text.cast("long"))


def _div(value: Column, by: int) -> Column:
    return F.call_function("div", value, F.lit(by).cast("long"))


def days_from_civil(year: Column, month: Column, day: Column) -> Column:
    """Days since 1970-01-01 of a Gregorian date from year 1 on, by integer arithmetic only.

    ``day`` may run past the month: day 60 of month 1 is the first or second day of March.
    """
    y = year - F.when(month <= 2, 1).otherwise(0)
    shifted = month + F.when(month > 2, -3).otherwise(9)
    return y * 365 + _div(y, 4) - _div(y, 100) + _div(y, 400) + _div(shifted * 153 + 2, 5) + day - 719469


def month_length(year: Column, month: Column, ordinal: Column) -> Column:
    """Days of the month, or of the year for an ordinal date."""
    leap = F.when((year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0)), 1).otherwise(0)
    return F.when(ordinal, leap + 365).when(month == 2, leap + 28).when(month.isin(4, 6, 9, 11), 30).otherwise(31)


def _wall_to_utc(wall_ms: Column, zone: Column) -> Column:
    """Wall time in an IANA zone as UTC ms: of two instants the first; null in a gap."""
    wall = F.timestamp_millis(wall_ms)
    utc = F.to_utc_timestamp(wall, zone)
    return F.when(F.from_utc_timestamp(utc, zone) == wall, F.unix_millis(utc))


def normalise_stamps(df: DataFrame, raw: str, zone: str, day_first: str, out: str = "utc_ms") -> DataFrame:
    """Adds ``out``: the instant of text ``raw`` in epoch ms UTC, null where it can't be read.

    Finer digits are cut off, missing ones zero. A value without offset or zone is wall time in
    the IANA name of column ``zone`` (UTC where null); of a wall time that occurs twice the
    first counts, one that never occurs can't be read, nor can one with an unknown zone. An
    offset wins over a zone written beside it. ``day_first`` orders all-numeric dates with
    separators (null: month first); two-digit years are 20xx; 24:00:00 is the next midnight.
    Blanks, quotes and byte-order marks around the value don't count. Null, blank and any other
    text gives null. All columns of ``df`` are kept, whatever their names but ``out``.
    """
    names = list(COMPONENTS)
    replacement = _MARK + _MARK.join("".join(f"${{{g}}}" for g in COMPONENTS[n]) for n in names)
    # The row itself travels as one struct, so its column names can't clash with those made here.
    df = df.select(F.struct("*").alias("_row"), F.col(raw).alias("_raw"), F.col(zone).alias("_given_zone"), F.col(day_first).alias("_day_first"))
    plain = F.translate("_raw", WIDE_BLANKS, " " * len(WIDE_BLANKS))
    packed = F.regexp_replace(plain, F.lit(ALTERNATION), F.lit(replacement))
    kept = ["_row"]
    # Each step is a projection of its own: columns used more than once stay shared and small.
    df = df.select(*kept, "_given_zone", "_day_first", F.when(F.startswith(packed, F.lit(_MARK)), F.split(packed, _MARK)).alias("_p"))
    df = df.select(*kept, "_given_zone", "_day_first", "_p", F.transform("_p", _whole_number).alias("_n"))
    text = {n: F.get(F.col("_p"), F.lit(i + 1)) for i, n in enumerate(names)}  # empty where the notation lacks the component
    number = lambda n: F.get(F.col("_n"), F.lit(names.index(n) + 1))
    thousandths = lambda c: F.rpad(F.substring(c, 1, 3), 3, "0").cast("long")
    given = lambda n: F.length(text[n]) > 0

    first_is_day = F.coalesce(F.col("_day_first"), F.lit(False))
    named_month = F.when(given("month_name"), (F.instr(F.lit(MONTHS), F.lower(F.substring(text["month_name"], 1, 3))) + 2) / 3).cast("long")
    abbreviations = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    sign = F.when(text["sign"] == "-", -1).otherwise(1)
    df = df.select(
        *kept,
        F.translate(text["count"], ",", "").alias("_count"),
        thousandths(text["count_rest"]).alias("_count_rest"),
        F.when(F.length(text["year"]) == 2, number("year") + 2000).otherwise(number("year")).alias("_y"),
        F.when(given("day_of_year"), F.lit(1).cast("long")).otherwise(F.coalesce(number("month"), named_month, F.when(first_is_day, number("two")).otherwise(number("one")))).alias("_mo"),
        F.coalesce(number("day_of_year"), number("day"), F.when(first_is_day, number("one")).otherwise(number("two"))).alias("_d"),
        given("day_of_year").alias("_ordinal"),
        number("hour").alias("_h"),
        number("minute").alias("_mi"),
        F.coalesce(number("second"), F.lit(0)).alias("_s"),
        thousandths(text["fraction"]).alias("_ms"),
        (F.translate(text["fraction"], "0", "") == "").alias("_whole"),
        F.nullif(F.lower(F.substring(text["half"], 1, 1)), F.lit("")).alias("_half"),
        F.when(given("sign"), sign * (number("zone_h") * 60 + F.coalesce(number("zone_m"), F.lit(0))))
        .when(given("utc"), 0)
        .otherwise(F.try_element_at(abbreviations, F.upper(text["abbreviation"])))
        .alias("_shift"),
        (number("zone_h").between(0, 18) & F.coalesce(number("zone_m"), F.lit(0)).between(0, 59)).alias("_shift_ok"),
        (given("sign") | given("utc") | given("abbreviation")).alias("_shifted"),
        F.coalesce(F.nullif(text["zone"], F.lit("")), F.nullif(F.trim("_given_zone"), F.lit("")), F.lit("UTC")).alias("_zone"),
    )
    y, mo, d, h, mi, sec = (F.col(f"_{n}") for n in ("y", "mo", "d", "h", "mi", "s"))
    size, count = F.length("_count"), _whole_number(F.col("_count"))
    counted = (
        F.when(size == 0, F.lit(None).cast("long"))
        .when(size <= 10, count * 1000 + F.col("_count_rest"))
        .when(size <= 13, count)
        .when(size <= 16, _div(count, 1000))
        .otherwise(_div(count, 1_000_000))
    )
    date_ok = mo.between(1, 12) & (d >= 1) & (d <= month_length(y, mo, F.col("_ordinal")))
    hour_ok = F.when(F.col("_half").isNotNull(), h.between(1, 12)).otherwise(h.between(0, 23) | ((h == 24) & (mi == 0) & (sec == 0) & F.col("_whole")))
    df = df.select(
        *kept,
        counted.alias("_counted"),
        days_from_civil(y, mo, d).alias("_days"),
        F.when(F.col("_half").isNotNull(), h % 12 + F.when(F.col("_half") == "p", 12).otherwise(0)).otherwise(h).alias("_h24"),
        (date_ok & hour_ok & mi.between(0, 59) & sec.between(0, 59)).alias("_ok"),
        "_mi", "_s", "_ms", "_shift", "_shift_ok", "_shifted", "_zone",
    )
    df = df.select(
        *kept,
        "_counted", "_shift", "_shift_ok", "_shifted", "_zone",
        F.when(F.col("_ok"), ((F.col("_days") * 24 + F.col("_h24")) * 60 + F.col("_mi")) * 60_000 + F.col("_s") * 1000 + F.col("_ms")).alias("_wall"),
        F.col("_zone").isin(sorted(zoneinfo.available_timezones())).alias("_known"),
    )
    shifted = F.when(F.coalesce(F.col("_shift_ok"), F.lit(True)), F.col("_wall") - F.col("_shift") * 60_000)
    result = F.coalesce("_counted", F.when(F.col("_shifted"), shifted).when(F.col("_known"), _wall_to_utc(F.col("_wall"), F.col("_zone"))))
    return df.select("_row.*", result.cast("long").alias(out))
