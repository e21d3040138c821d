"""Call and text summaries over the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracelode.functions.timebins import Frequency
from tracelode.operators import comm_logs
from tracelode.sources.streams import calls_of, texts_of
from tracelode.sources.tables import load


def _summary(frequency: Frequency):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = load(spark, sf_dir, "events")
        return comm_logs.communication_summary(calls_of(events), texts_of(events), frequency)

    return query


def text_reciprocity_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comm_logs.text_reciprocity(texts_of(load(spark, sf_dir, "events")))


def contact_union_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    return comm_logs.contact_union(calls_of(events), texts_of(events))


QUERIES = {
    "comm_daily_summary": _summary(Frequency.DAILY),
    "comm_hourly_summary": _summary(Frequency.HOURLY),
    "comm_three_hourly_summary": _summary(Frequency.THREE_HOURLY),
    "comm_six_hourly_summary": _summary(Frequency.SIX_HOURLY),
    "comm_twelve_hourly_summary": _summary(Frequency.TWELVE_HOURLY),
    "text_reciprocity_daily": text_reciprocity_daily,
    "contact_union_cardinality": contact_union_cardinality,
}

_BASE = """
WITH b AS (SELECT user_id AS participant, epoch_us(ts) // 1000 AS t, props ->> '$.k' AS phone, event_type, value,
   CASE event_type WHEN 'click' THEN 'in' WHEN 'view' THEN 'out' WHEN 'error' THEN 'mis'
   WHEN 'signup' THEN CASE WHEN event_id % 5 = 0 THEN 'mms_r' ELSE 'r' END WHEN 'purchase' THEN CASE WHEN event_id % 5 = 0 THEN 'mms_s' ELSE 's' END END AS kind
   FROM events)"""


def _sql(step: int, daily: bool) -> str:
    floor = 86400 if daily else 3600
    calls = "num_in_call num_out_call num_mis_call num_in_caller num_out_caller num_mis_caller total_mins_in_call total_mins_out_call".split()
    texts = "num_s num_r num_mms_s num_mms_r num_s_tel num_r_tel total_char_s total_char_r".split() + (["text_reciprocity_incoming", "text_reciprocity_outgoing"] if daily else [])
    shown = [f"CASE WHEN has_calls THEN coalesce({c}, 0) END AS {c}" for c in calls]
    shown += [f"CASE WHEN has_texts THEN coalesce({c}, 0) END AS {c}" for c in texts]
    clock = "year(binned_at) AS year, month(binned_at) AS month, day(binned_at) AS day" + ("" if daily else ", hour(binned_at) AS hour")
    return (
        _BASE
        + f""",
 sp AS (SELECT participant, min(t) // 1000 // {floor} * {floor} AS f, max(t) // 1000 // {floor} * {floor} AS l,
   bool_or(kind IN ('in','out','mis')) AS has_calls, bool_or(kind IN ('s','r','mms_s','mms_r')) AS has_texts FROM b WHERE kind IS NOT NULL GROUP BY participant),
 x AS (SELECT b.*, (t // 1000 - f) // {step} AS bin FROM b JOIN sp USING (participant) WHERE kind IS NOT NULL),
 one AS (SELECT participant, bin, phone, bool_or(kind='s') AS ws, bool_or(kind='r') AS wr, count(*) FILTER (kind='s') AS cs, count(*) FILTER (kind='r') AS cr FROM x GROUP BY ALL),
 rec AS (SELECT participant, bin, coalesce(sum(cr) FILTER (NOT ws), 0) AS text_reciprocity_incoming, coalesce(sum(cs) FILTER (NOT wr), 0) AS text_reciprocity_outgoing FROM one WHERE phone IS NOT NULL GROUP BY ALL),
 a AS (SELECT participant, bin, count(*) FILTER (kind='in') AS num_in_call, count(*) FILTER (kind='out') AS num_out_call, count(*) FILTER (kind='mis') AS num_mis_call,
   count(DISTINCT phone) FILTER (kind='in') AS num_in_caller, count(DISTINCT phone) FILTER (kind='out') AS num_out_caller, count(DISTINCT phone) FILTER (kind='mis') AS num_mis_caller,
   coalesce(sum(floor(value)) FILTER (kind='in'), 0) / 60 AS total_mins_in_call, coalesce(sum(floor(value)) FILTER (kind='out'), 0) / 60 AS total_mins_out_call,
   count(DISTINCT phone) FILTER (kind IN ('in','out','mis','s','r')) AS j,
   count(*) FILTER (kind='s') AS num_s, count(*) FILTER (kind='r') AS num_r, count(*) FILTER (kind='mms_s') AS num_mms_s, count(*) FILTER (kind='mms_r') AS num_mms_r,
   count(DISTINCT phone) FILTER (kind='s') AS num_s_tel, count(DISTINCT phone) FILTER (kind='r') AS num_r_tel,
   coalesce(sum(floor(value)) FILTER (kind='s'), 0)::BIGINT AS total_char_s, coalesce(sum(floor(value)) FILTER (kind='r'), 0)::BIGINT AS total_char_r FROM x GROUP BY ALL),
 spine AS (SELECT *, unnest(range(0, (l - f) // {step} + 1)) AS bin FROM sp),
 o AS (SELECT spine.*, a.* EXCLUDE (participant, bin), rec.* EXCLUDE (participant, bin), make_timestamp((f + spine.bin * {step}) * 1000000) AS binned_at
   FROM spine LEFT JOIN a USING (participant, bin) LEFT JOIN rec USING (participant, bin))
SELECT participant, {clock}, coalesce(j, 0) AS num_uniq_individuals_call_or_text, {", ".join(shown)} FROM o"""
    )


ORACLE = {
    "comm_daily_summary": _sql(86400, True),
    "comm_hourly_summary": _sql(3600, False),
    "comm_three_hourly_summary": _sql(3 * 3600, False),
    "comm_six_hourly_summary": _sql(6 * 3600, False),
    "comm_twelve_hourly_summary": _sql(12 * 3600, False),
    "text_reciprocity_daily": _BASE
    + """,
 one AS (SELECT participant, t // 86400000 AS bin, phone, count(*) FILTER (kind='s') AS s, count(*) FILTER (kind='r') AS r FROM b
   WHERE kind IN ('s','r','mms_s','mms_r') AND phone IS NOT NULL GROUP BY ALL)
SELECT participant, bin, sum(CASE WHEN s = 0 THEN r ELSE 0 END)::BIGINT AS text_reciprocity_incoming, sum(CASE WHEN r = 0 THEN s ELSE 0 END)::BIGINT AS text_reciprocity_outgoing FROM one GROUP BY ALL""",
    "contact_union_cardinality": _BASE + " SELECT participant, count(DISTINCT phone) AS n_contacts FROM b WHERE kind IN ('in','out','mis','s','r') AND phone IS NOT NULL GROUP BY participant",
}
