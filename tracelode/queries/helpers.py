"""Small relational helpers: statistics, windows, spines, civil time, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.functions import stats, timebins
from tracelode.functions.instants import stamp_ms
from tracelode.operators.surveys import standard_question_type
from tracelode.queries.mobility import rounded
from tracelode.sources.streams import texts_of
from tracelode.sources.tables import load


def summary_stat_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.describe(load(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice")
    return rounded(found, 2, *stats.STATISTICS)


def round_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").select("event_id", timebins.bracket(stamp_ms(F.col("ts")), 900_000).alias("b"))
    return rows.select("event_id", "b.low", "b.high")


def between_days_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = load(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return spans.select("user_id", F.explode(timebins.days_between(F.col("a"), F.col("b"))).alias("day"))


def window_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.window_counts(load(spark, sf_dir, "events"), ["user_id"], F.floor(stamp_ms(F.col("ts")) / 1000), 3600)


def window_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.window_rows(load(spark, sf_dir, "events"), ["user_id"], F.floor(stamp_ms(F.col("ts")) / 1000), 3600, "event_id")
    return found.select("user_id", "window_start", F.concat_ws(",", F.transform("rows", lambda r: r.cast("string"))).alias("rows"))


def clean_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct accelerometer rows."""
    return load(spark, sf_dir, "accelerometer").distinct().groupBy("participant").agg(F.count(F.lit(1)).alias("n_rows"))


def civil_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = stamp_ms(F.col("ts")) / 1000
    rows = load(spark, sf_dir, "events").select("event_id", timebins.epoch_to_civil(at, "UTC").alias("c"), timebins.clock_text(F.pmod(F.floor(at), F.lit(86_400))).alias("clock"), F.weekday("ts").alias("weekday"))
    return rows.select("event_id", "c.*", "clock", "weekday")


def question_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = standard_question_type(F.col("question_type")).alias("kind")
    return load(spark, sf_dir, "survey_timings").groupBy(kind).agg(F.count(F.lit(1)).alias("n"))


def weekend_holidays(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = load(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return days.where(stats.is_us_holiday(F.col("day"))).select("day", (F.weekday("day") >= 5).alias("weekend"))


def gap_multipliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", stats.gap_multiplier(F.col("value") * 200).alias("multiplier"))


def contacts_never_answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phones that wrote to a participant and were never written to."""
    texts = texts_of(load(spark, sf_dir, "events")).dropna(subset=["participant", "phone"])
    came = texts.where("direction = 'received SMS'").select("participant", "phone").distinct()
    went = texts.where("direction = 'sent SMS'").select("participant", "phone")
    return came.join(went, ["participant", "phone"], "left_anti")


QUERIES = {f.__name__: f for f in (summary_stat_registry, round_timestamp, between_days_spine, window_index, window_members, clean_frame, civil_fields, question_types, weekend_holidays, gap_multipliers, contacts_never_answered)}

_FIXED = "((month({d}) = 1 AND day({d}) = 1) OR (month({d}) = 7 AND day({d}) = 4) OR (month({d}) = 11 AND day({d}) = 11) OR (month({d}) = 12 AND day({d}) = 25) OR (month({d}) = 6 AND day({d}) = 19 AND year({d}) >= 2021))"

ORACLE = {
    "weekend_holidays": f"""
WITH d AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders)
SELECT day, isodow(day) >= 6 AS weekend FROM d WHERE {_FIXED.format(d="day")} OR (isodow(day) = 5 AND {_FIXED.format(d="(day + 1)")}) OR (isodow(day) = 1 AND {_FIXED.format(d="(day - 1)")})
 OR (isodow(day) = 1 AND ((month(day) = 1 AND day(day) BETWEEN 15 AND 21) OR (month(day) = 2 AND day(day) BETWEEN 15 AND 21) OR (month(day) = 5 AND day(day) >= 25) OR (month(day) = 9 AND day(day) <= 7) OR (month(day) = 10 AND day(day) BETWEEN 8 AND 14)))
 OR (isodow(day) = 4 AND month(day) = 11 AND day(day) BETWEEN 22 AND 28)""",
    "summary_stat_registry": """SELECT o_orderpriority, count(o_totalprice) AS n, round(max(o_totalprice) - min(o_totalprice) + 13e-5, 2) AS range,
 round(quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25) + 13e-5, 2) AS iqr, round(stddev_samp(o_totalprice) + 13e-5, 2) AS std, round(var_samp(o_totalprice) + 13e-5, 2) AS var,
 round(avg(o_totalprice) + 13e-5, 2) AS mean, round(median(o_totalprice) + 13e-5, 2) AS median FROM orders GROUP BY o_orderpriority""",
    "round_timestamp": "SELECT event_id, t - t % 900000 AS low, t - t % 900000 + 900000 AS high FROM (SELECT event_id, epoch_us(ts) // 1000 AS t FROM events)",
    "between_days_spine": "SELECT user_id, unnest(generate_series(min(ts)::DATE::TIMESTAMP, max(ts)::DATE::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM events GROUP BY user_id",
    "window_index": "SELECT user_id, epoch_us(ts) // 1000000 // 3600 * 3600 AS window_start, count(*) AS n_rows FROM events GROUP BY ALL",
    "window_members": "SELECT user_id, t // 3600 * 3600 AS window_start, string_agg(event_id::VARCHAR, ',' ORDER BY t, event_id) AS rows FROM (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS t FROM events) GROUP BY ALL",
    "clean_frame": "SELECT participant, count(*) AS n_rows FROM (SELECT DISTINCT * FROM accelerometer) GROUP BY participant",
    "civil_fields": "SELECT event_id, year(ts) AS year, month(ts) AS month, day(ts) AS day, hour(ts) AS hour, minute(ts) AS minute, second(ts) AS second, strftime(ts, '%H:%M') AS clock, isodow(ts) - 1 AS weekday FROM events",
    "question_types": """SELECT CASE question_type WHEN 'radio_button' THEN 'Radio Button Question' WHEN 'checkbox' THEN 'Checkbox Question' WHEN 'slider' THEN 'Slider Question'
 WHEN 'free_response' THEN 'Open Response Question' WHEN 'info_text_box' THEN 'Info Text Box' ELSE question_type END AS kind, count(*) AS n FROM survey_timings GROUP BY ALL""",
    "gap_multipliers": "SELECT event_id, CASE WHEN value * 200 <= 1800 THEN 1 WHEN value * 200 <= 10800 THEN 5 WHEN value * 200 <= 64800 THEN 10 ELSE 50 END AS multiplier FROM events",
    "contacts_never_answered": """
WITH b AS (SELECT user_id AS participant, props ->> '$.k' AS phone, event_type FROM events WHERE event_type IN ('signup', 'purchase') AND event_id % 5 <> 0)
SELECT DISTINCT participant, phone FROM b WHERE event_type = 'signup' AND phone IS NOT NULL AND NOT EXISTS (SELECT 1 FROM b s WHERE s.event_type = 'purchase' AND s.participant = b.participant AND s.phone = b.phone)""",
}
