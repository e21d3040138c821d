"""Whole analyses over a small study folder."""

from __future__ import annotations

import json
import logging

import numpy as np
import pytest

from tracelode import pipelines as P
from tracelode.__main__ import main
from tracelode.functions.timebins import Frequency
from tracelode.operators import simulate
from tracelode.sources import sinks

START = 1_612_483_200  # 2021-02-05


def put(root, path, lines):
    at = root / path
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_text("\n".join(lines) + "\n")


@pytest.fixture(scope="module")
def study(tmp_path_factory):
    root = tmp_path_factory.mktemp("all") / "study"
    for hour in range(30):
        name = f"2021-02-{5 + hour // 24:02d} {hour % 24:02d}_00_00+00_00.csv"
        t = START + hour * 3600
        put(root, f"u1/gps/{name}", ["timestamp,UTC time,latitude,longitude,altitude,accuracy"] + [f"{1000 * (t + 10 * k)},x,{42.0 + (0.0005 * k if hour == 12 else 0.18 if hour == 13 else 0)},{-71.0 + 0.00001 * (k % 2)},1,10" for k in range(360) if hour != 20])
        put(root, f"u1/calls/{name}", ["timestamp,UTC time,hashed phone number,call type,duration in seconds", f"{1000 * t},x,p{hour % 3},Incoming Call,60"])
    t = np.arange(0, 40, 0.1)
    put(root, "u1/accelerometer/2021-02-05 10_00_00+00_00.csv", ["timestamp,UTC time,accuracy,x,y,z"] + [f"{int(1000 * (START + 36_000 + s))},x,unknown,0,0,{1 + 0.5 * np.sin(2 * np.pi * 1.8 * s)}" for s in t])
    head = "timestamp,UTC time,question id,survey id,question type,question text,question answer options,answer,event"
    rows = []
    for d in range(2):
        at = 1000 * (START + 86_400 * d + 36_600)
        rows += [f"{at},x,q1,s1,radio_button,?,[a;b],,present", f"{at + 5000},x,q1,s1,radio_button,?,[a;b],a,changed", f"{at + 9000},x,q2,s1,slider,?,,{d},changed", f"{at + 20_000},x,,s1,,,,,submitted"]
    put(root, "u1/survey_timings/s1/2021-02-05 10_00_00+00_00.csv", [head, *rows])
    put(root, "u1/survey_answers/s1/2021-02-07 09_00_00+00_00.csv", ["question id,question type,question text,question answer options,answer", "q1,radio_button,?,[a;b],b", "q2,slider,?,,7"])
    put(root, "u2/calls/2021-02-05 10_00_00+00_00.csv", ["timestamp,UTC time", "damaged"])
    return str(root)


def test_communication_and_command_line(spark, study, tmp_path):
    found = P.communication(spark, study, str(tmp_path), zone="America/New_York")
    assert set(found) == {"hourly", "daily"} and found["daily"].agg({"num_in_call": "sum"}).first()[0] == 29  # the last file ends the window
    main(["communication", study, str(tmp_path / "b"), "--frequency", "daily"], spark)
    assert len(list((tmp_path / "b/daily/participant=u1").glob("*.csv"))) == 1


def test_walking(spark, study, tmp_path):
    daily = P.walking(spark, study, str(tmp_path))["daily"].collect()
    assert len(daily) == 1 and daily[0].date == "2021-02-05" and 60 <= daily[0].steps <= 75


def test_mobility(spark, study, tmp_path):
    found = P.mobility(spark, study, str(tmp_path), (Frequency.DAILY, Frequency.HOURLY), with_rhythm=True)
    path = found["trajectory"].orderBy("t0").collect()
    assert all(abs(a.t1 - b.t0) < 1e-6 for a, b in zip(path, path[1:])) and {r.obs for r in path} == {0, 1}
    day = found["daily"].orderBy("day").first()
    assert (day.year, day.month, day.day) == (2021, 2, 5) and 10 <= day.obs_duration <= 24 and 35 < day.dist_traveled < 60
    assert found["hourly"].count() == 28 and found["states"].count() == 4
    again = P.mobility(spark, study, str(tmp_path / "b"), (), earlier_states=found["states"])
    assert again["states"].count() == 4
    with pytest.raises(ValueError, match="accuracy"):
        P.mobility(spark, study, str(tmp_path / "c"), accuracy_limit=5)


def test_surveys(spark, study, tmp_path):
    survey = {"content": [{"question_id": "q1", "question_text": "?", "question_type": "radio_button"}, {"question_id": "q2", "question_text": "?", "question_type": "slider"}], "survey_type": "tracking_survey", "timings": [[], [], [], [], [], [36_000], [36_000]], "absolute_timings": [], "relative_timings": []}
    (tmp_path / "c.json").write_text(json.dumps({"surveys": [survey]}))
    found = P.surveys(spark, study, str(tmp_path / "out"), "UTC", str(tmp_path / "c.json"), start="2021-02-01", end="2021-02-10")
    wide = found["by_survey"].orderBy("instance").collect()
    assert [(r.question_1, r.question_2) for r in wide] == [("a", "0"), ("a", "1"), ("b", "7")]
    got = found["submits_and_deliveries"].orderBy("delivery_ms").collect()
    assert [(r.delivery_ms.day, r.submit_flg, r.opened_flg, r.num_questions_answered) for r in got] == [(5, 1, 1, 2), (6, 1, 1, 2), (6, 1, 1, 2)]
    assert got[0].time_to_submit == 620.0 and got[0].time_to_open == 600.0 and got[0].survey_duration == 20.0 and got[2].survey_duration is None
    (total,) = found["submits_summary"].collect()
    assert (total.num_surveys, total.num_complete_surveys, total.num_opened_surveys) == (2, 3, 3)
    times = {(r.question_id, r.question_index): r.time_to_answer for r in found["answers_data"].where("t_ms IS NULL" if "t_ms" in found["answers_data"].columns else "true").collect()}
    assert times["q1", 1] == 5.0 and times["q2", 2] == 4.0
    assert len(list((tmp_path / "out/by_survey/survey_id=s1").glob("*.csv"))) == 1


def test_simulated_study_and_documents(spark, tmp_path, caplog):
    fixes = P.simulate_study(spark, str(tmp_path / "sim"), 1, 1, {"User 1": {"vehicle": "car"}})
    hours = list((tmp_path / "sim").glob("participant=user0/hour=*"))
    assert 20 <= len(hours) <= 25 and fixes.count() > 1000 and simulate.people_of({}) == {}
    assert sinks.write_json({"a": [1]}, str(tmp_path / "d/x.json")) and sinks.read_json(str(tmp_path / "d/x.json")) == {"a": [1]}
    assert sinks.read_json(str(tmp_path / "d/x.json"), ordered=True) == [("a", [1])]
    with caplog.at_level(logging.WARNING):
        assert sinks.read_json(str(tmp_path / "none.json")) is None and not sinks.write_json({1, 2}, str(tmp_path / "y.json"))
    handler = sinks.log_to_csv(str(tmp_path / "log.csv"))
    logging.getLogger("tracelode.x").info('a "b", c')
    logging.getLogger("tracelode").removeHandler(handler)
    handler.close()
    assert (tmp_path / "log.csv").read_text().splitlines()[1].endswith(',INFO,tracelode.x,"a ""b"", c"')
    df = spark.createDataFrame([("u", 1)], "participant string, n int")
    sinks.append_rows(df, str(tmp_path / "t"))
    sinks.append_rows(df, str(tmp_path / "t"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "t")).count() == 2
