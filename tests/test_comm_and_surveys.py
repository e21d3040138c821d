from __future__ import annotations

import random

import pytest

from tracelode.functions.timebins import Frequency
from tracelode.operators import surveys as S
from tracelode.operators.comm_logs import communication_summary
from tracelode.queries import surveys as survey_queries

CALLS = "participant string, timestamp long, phone string, call_type string, duration_s double"
TEXTS = "participant string, timestamp long, phone string, direction string, message_length string"
DAY = 86_400_000


def test_daily_summary(spark):
    calls = spark.createDataFrame([("p", 1000, "a", "Incoming Call", 90.0), ("p", 2 * DAY, "b", "Missed Call", None), ("p", 2000, None, "Outgoing Call", 30.0), (None, 1, "a", "Missed Call", 1.0)], CALLS)
    texts = spark.createDataFrame([("p", 5000, "a", "sent SMS", "7"), ("p", 5000, "c", "received SMS", "x"), ("p", 6000, "d", "sent MMS", "MMS"), ("q", 5, "z", "sent SMS", None)], TEXTS)
    rows = {(r.participant, r.day): r for r in communication_summary(calls, texts, Frequency.DAILY).collect()}
    assert len(rows) == 4
    first = rows["p", 1]
    assert (first.num_in_call, first.num_out_call, first.num_out_caller, first.total_mins_in_call, first.num_s, first.num_mms_s, first.total_char_s) == (1, 1, 0, 1.5, 1, 1, 7)
    assert (first.text_reciprocity_incoming, first.text_reciprocity_outgoing, first.num_uniq_individuals_call_or_text) == (1, 1, 2)
    assert rows["p", 2].num_in_call == 0 and rows["p", 2].num_s == 0
    assert rows["q", 1].num_in_call is None and rows["q", 1].num_s == 1


def test_summary_of_nothing_and_zones(spark):
    calls, texts = spark.createDataFrame([], CALLS), spark.createDataFrame([], TEXTS)
    assert communication_summary(calls, texts, Frequency.HOURLY).count() == 0
    one = spark.createDataFrame([("p", 3 * 3_600_000, "a", "Incoming Call", 1.0)], CALLS)
    assert communication_summary(one, texts, Frequency.HOURLY, "America/New_York").first().hour == 22
    with pytest.raises(ValueError):
        communication_summary(calls, texts, Frequency.HOURLY_AND_DAILY)


def test_without_neighbour_matches_brute_force(spark):
    rnd = random.Random(3)
    pick = lambda n: [(rnd.choice(["a", "b", None]), rnd.choice([None, rnd.randrange(0, 40_000)])) for _ in range(n)]
    left, right = pick(300), pick(60)
    want = sorted((k, t) for k, t in left if k is not None and t is not None and not any(k == j and u is not None and abs(t - u) <= 500 for j, u in right))
    got = S.without_neighbour(spark.createDataFrame(left, "k string, t long"), spark.createDataFrame(right, "k string, u long"), ["k"], "t", "u", 500)
    assert sorted((r.k, r.t) for r in got.collect() if r.k is not None and r.t is not None) == want


def test_instances(spark):
    rows = [("p", "s", t, q, None, e, None) for t, q, e in [(0, "a", "present"), (10, "a", "changed"), (20, "b", "submitted"), (30, "a", "present"), (8_000_000, "a", "present")]]
    rows += [("q", "s", 5, "a", None, "present", None)]
    events = spark.createDataFrame(rows, "participant string, survey_id string, t_ms long, question_id string, question_type string, event string, answer string")
    got = [(r.participant, r.t_ms, r.question_index, r.instance) for r in S.number_events(events).orderBy("participant", "t_ms").collect()]
    assert got == [("p", 0, 1, 1), ("p", 10, 1, 1), ("p", 20, 2, 1), ("p", 30, 3, 2), ("p", 8_000_000, 3, 3), ("q", 5, 0, 0)]


def test_wide_form_holds_every_survey(spark, tmp_path):
    history = [("s1", '[{"question_id": "b"}, {"question_id": "a"}]'), ("s2", '[{"question_id": "c"}]')]
    spark.createDataFrame(history, "survey_id string, survey_json string").write.parquet(f"{tmp_path}/survey_history.parquet")
    rows = [("p", "s1", 1000, "a", "changed", "x"), ("p", "s1", 2000, "a", "changed", "y"), ("p", "s1", 3000, "b", "submitted", "z")]
    rows += [("p", "s2", 5000, "c", "changed", "u"), ("q", "s2", 6000, "0", "changed", "v"), ("q", "s3", 7000, "d", "changed", "w"), ("q", "s3", 8000, "d", "changed", None)]
    timings = [(p, s, 1_600_000_000_000 + t, q, e, a, None, None) for p, s, t, q, e, a in rows]
    spark.createDataFrame(timings, "participant string, survey_id string, timestamp long, question_id string, event string, answer string, question_type string, utc_time timestamp_ntz").write.parquet(f"{tmp_path}/survey_timings.parquet")
    wide = survey_queries.responses_wide(spark, str(tmp_path))
    assert [c for c in wide.columns if c.startswith("question_")] == ["question_1", "question_2"]
    got = sorted(((r.survey_id, r.participant, r.question_1, r.question_2) for r in wide.collect()), key=str)
    assert got == [("s1", "p", "y", "z"), ("s2", "p", "u", None), ("s2", "q", None, "v"), ("s3", "q", "w", None)]
