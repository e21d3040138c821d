from __future__ import annotations

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from tracelode.operators.stamps import normalise_stamps


def ms(y, mo, d, h=0, mi=0, s=0, milli=0, zone="UTC"):
    return int(datetime(y, mo, d, h, mi, s, tzinfo=ZoneInfo(zone)).timestamp()) * 1000 + milli


NY, KTM = "America/New_York", "Asia/Kathmandu"
CASES = [
    ("1609459200", None, False, 1609459200000), ("1609459200.9876", None, False, 1609459200987), ("1609459200123", None, False, 1609459200123),
    ("1609459200123.7", None, False, 1609459200123), ("1609459200123999", None, False, 1609459200123), ("1609459200123999999", NY, False, 1609459200123),
    ("1,609,459,200,123", NY, True, 1609459200123), ('  "1609459200123" ', NY, True, 1609459200123), ("﻿1609459200", NY, True, 1609459200000),
    ("20210216063742", NY, False, ms(2021, 2, 16, 6, 37, 42, zone=NY)), ("20210216T063742Z", NY, False, ms(2021, 2, 16, 6, 37, 42)),
    ("2020-05-11T22:38:35.6319Z", NY, False, ms(2020, 5, 11, 22, 38, 35, 631)), ("2020-05-11t22:38:35.6z", NY, False, ms(2020, 5, 11, 22, 38, 35, 600)),
    ("2020-05-11T22:38:35,063Z", NY, False, ms(2020, 5, 11, 22, 38, 35, 63)), ("2020-05-11 22:38", None, False, ms(2020, 5, 11, 22, 38)),
    ("2012-04-22 22_15_06+00_00", NY, False, ms(2012, 4, 22, 22, 15, 6)), ("2022-111T04:03:47Z", None, False, ms(2022, 4, 21, 4, 3, 47)),
    ("2020-366T00:00:00Z", None, False, ms(2020, 12, 31)), ("2021-366T00:00:00Z", None, False, None),
    ("2023-07-13T05:02:16.901-0530", NY, False, ms(2023, 7, 13, 10, 32, 16, 901)), ("2013-04-05T15:13:20+11:00[Australia/Sydney]", None, False, ms(2013, 4, 5, 4, 13, 20)),
    ("2013-04-05T15:13:20[Australia/Sydney]", None, False, ms(2013, 4, 5, 15, 13, 20, zone="Australia/Sydney")),
    ("2021-04-26 19:23:01 UTC+05:45", None, False, ms(2021, 4, 26, 13, 38, 1)), ("2022-05-22 12:01:58 GMT-7", KTM, False, ms(2022, 5, 22, 19, 1, 58)),
    ("10 March 2019 01:32:56", KTM, False, ms(2019, 3, 10, 1, 32, 56, zone=KTM)), ("Fri Dec 15 2023 7:12:52am", NY, False, ms(2023, 12, 15, 7, 12, 52, zone=NY)),
    ("Mon, 11 Jun 2012 23:29:06 +0100", NY, False, ms(2012, 6, 11, 22, 29, 6)), ("Jul 10, 2021, 12:44:25 AM CDT", NY, False, ms(2021, 7, 10, 5, 44, 25)),
    ("Jul 10, 2021, 12:44:25 PM PDT", NY, False, ms(2021, 7, 10, 19, 44, 25)), ("Jul 10, 2021, 12:44:25 AM XYZT", NY, False, None),
    ("04/09/2012 20:55:19", None, True, ms(2012, 9, 4, 20, 55, 19)), ("04/09/2012 20:55:19", None, False, ms(2012, 4, 9, 20, 55, 19)),
    ("04/09/2012 20:55:19", None, None, ms(2012, 4, 9, 20, 55, 19)), ("28.01.15 17:39:14", None, True, ms(2015, 1, 28, 17, 39, 14)), ("28.01.15 17:39:14", None, False, None),
    ("9/10/14 3:23 PM", KTM, False, ms(2014, 9, 10, 15, 23, zone=KTM)), ("9/10/14 13:23 PM", KTM, False, None), ("9/10/14 0:23 AM", KTM, False, None),
    ("2017-09-04T24:00:00Z", None, False, ms(2017, 9, 5)), ("2017-09-04T24:00:01Z", None, False, None), ("2017-09-04T25:10:00Z", None, False, None),
    ("2023-02-29T10:00:00Z", None, False, None), ("2024-02-29T10:00:00Z", None, False, ms(2024, 2, 29, 10)), ("2100-02-29T10:00:00Z", None, False, None), ("2020-13-05 08:00:00", None, False, None),
    ("2021-03-14 02:30:00", NY, False, None), ("2021-11-07 01:30:00", NY, False, ms(2021, 11, 7, 5, 30)), ("2021-11-07 01:30:00", "Mars/Olympus", False, None),
    ("2021-11-07 01:30:00+25:00", None, False, None), ("0000-00-00 00:00:00", None, False, None),
    (None, None, None, None), ("", None, False, None), ("   ", None, False, None), ("unknown", None, False, None), ("12:30", None, False, None), ("2023-05-", None, False, None), ("##########", NY, False, None), ("9" * 5000, NY, False, None),
]


def test_every_notation(spark):
    rows = [(i, *c) for i, c in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, raw string, zone string, day_first boolean, want long").withColumn("_count", F.lit("clash"))
    got = {r.i: (r.raw, r.utc_ms, r.want) for r in normalise_stamps(df, "raw", "zone", "day_first").collect()}
    assert len(got) == len(CASES)
    assert [v for v in got.values() if v[1] != v[2]] == []


def test_all_days_round_trip(spark):
    days = [datetime(1999, 1, 1, tzinfo=timezone.utc) + timedelta(days=17 * k, seconds=61 * k) for k in range(900)]
    rows = [(d.strftime("%Y-%m-%dT%H:%M:%SZ"), d.strftime("%d/%m/%Y %H:%M:%S"), int(d.timestamp()) * 1000) for d in days]
    df = spark.createDataFrame(rows, "raw string, other string, want long").withColumn("zone", F.lit(None).cast("string")).withColumn("day_first", F.lit(True))
    assert normalise_stamps(df, "raw", "zone", "day_first").where("utc_ms IS DISTINCT FROM want").count() == 0
    assert normalise_stamps(df, "other", "zone", "day_first").where("utc_ms IS DISTINCT FROM want").count() == 0


def test_empty(spark):
    df = spark.createDataFrame([], "raw string, zone string, day_first boolean")
    assert normalise_stamps(df, "raw", "zone", "day_first").count() == 0
