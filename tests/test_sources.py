from __future__ import annotations

import json
import wave

from pyspark.sql import functions as F

from tracelode.functions import lists, timebins
from tracelode.operators import schedule
from tracelode.operators.sessions import sessions
from tracelode.operators.survey_reports import audio_prompts, audio_rows, real_answer
from tracelode.sources import study_folder as R
from tracelode.sources.sinks import write_summaries
from tracelode.streaming.live import live_collapse, live_counts, live_sessions


def study(root):
    def put(path, text):
        at = root / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(text if isinstance(text, bytes) else text.encode())

    head = "timestamp,UTC time,latitude,longitude,altitude,accuracy\n"
    put("u1/gps/2021-02-05 00_00_00+00_00.csv", head + "1,a,1.5,2,3,4\n2,b,x,2,3,4\n")
    put("u1/gps/2021-02-05 01_00_00+00_00.csv", "UTC time,timestamp,latitude\nz,7,9\n")
    put("u1/gps/2021-02-05 02_00_00+00_00.csv", b"\xff\xfe\x00broken")
    put("u1/identifiers/2021-02-05 01_30_00+00_00.csv", "timestamp,UTC time\n1,a\n")
    put("registry/gps/2021-02-05 00_00_00+00_00.csv", head + "1,a,1,2,3,4\n")
    put(".hidden/gps/2021-02-05 00_00_00+00_00.csv", head + "1,a,1,2,3,4\n")
    answers = "question id,question type,question text,question answer options,answer\n"
    put("u1/survey_answers/s1/2021-02-05 03_00_00+00_00.csv", answers + "q,t,x,,yes\n")
    put("u1/survey_answers/s1/2021-02-05 04_00_00+00_00.csv", answers + "q,t,x,,NOT_PRESENTED\n")
    sound = root / "u1/audio_recordings/s1/2021-02-05 05_00_10+00_00.wav"
    sound.parent.mkdir(parents=True)
    with wave.open(str(sound), "wb") as out:
        out.setparams((1, 2, 8000, 0, "NONE", ""))
        out.writeframes(b"\0\0" * 8000 * 4)
    return str(root)


def test_study_folder(spark, tmp_path):
    folder = study(tmp_path / "study")
    assert R.participants(spark, folder) == ["u1"]
    files = R.stream_files(spark, folder)
    assert files.count() == 7 and {r.participant for r in files.collect()} == {"u1"}
    (limits,) = R.read_windows(files, "gps", 0, 2**40).collect()
    assert (limits.start_s, limits.end_s) == (1612486800, 1612490400)
    windows = R.read_windows(files, "gps", enrolled=R.enrolments(R.read_stream(spark, folder, "identifiers")))
    assert windows.first().start_s == 0.001 and sorted(r.timestamp for r in R.read_stream(spark, folder, "gps", windows=windows).where("latitude > 1").collect()) == [1, 7]
    assert [r.n_files for r in R.file_days(files).collect()] == [7] and R.files_between(files, "2021-02-05 01:00:00", "2021-02-05 02:00:00").count() == 3
    rows = {r.timestamp: r for r in R.read_stream(spark, folder, "gps").collect()}
    assert {1, 2, 7} <= set(rows) and rows[1].latitude == 1.5 and rows[2].latitude is None and rows[7]["UTC time"] == "z" and rows[7].accuracy is None
    assert [r.timestamp for r in R.read_stream(spark, folder, "gps", 1612486800, 1612490400).collect()] == [7]
    assert R.folder_size(files).first().n_files == 7
    answered = R.survey_answer_files(R.read_stream(spark, folder, "survey_answers"), "America/New_York").collect()
    assert sorted(str(r.event) for r in answered) == ["None", "None", "submitted"] and {(r.local_time.hour, r.file_number) for r in answered} == {(22, 1), (23, 2)}
    heard = R.audio_recordings(spark, folder).orderBy("local_time", "submit_line").collect()
    assert [(r.local_time.second, r.event, r.seconds) for r in heard] == [(6, "present", 4.0), (10, "present", 4.0), (10, "submitted", 4.0)]
    assert R.audio_seconds(b"none") is None


def test_config_and_schedule(spark, tmp_path):
    survey = {"content": [{"question_id": "q", "question_text": "?", "question_type": "slider"}], "survey_type": "tracking_survey", "timings": [[], [36000], [], [], [], [], [3600, 7200]], "absolute_timings": [[2021, 3, 2, 60]], "relative_timings": [["i", 1, 30]]}
    (tmp_path / "c.json").write_text(json.dumps({"surveys": [survey], "x": 1}))
    (tmp_path / "i.json").write_text(json.dumps({"u": {"s": {"i": "2021-03-05"}}, "v": {"s": {"i": None}}}))
    config, people = schedule.read_config(spark, str(tmp_path / "c.json")), spark.createDataFrame([("u",), ("v",)], "participant string")
    assert schedule.questions(config).first().ordinal == 1
    got = schedule.delivery_times(config, people, "2021-03-01", "2021-03-14", schedule.read_interventions(spark, str(tmp_path / "i.json"))).orderBy("participant", "delivery_time").collect()
    times = [str(r.delivery_time) for r in got if r.participant == "u"]
    assert times == ["2021-03-01 10:00:00", "2021-03-02 00:01:00", "2021-03-06 00:00:30", "2021-03-06 01:00:00", "2021-03-06 02:00:00", "2021-03-08 10:00:00", "2021-03-13 01:00:00", "2021-03-13 02:00:00"]
    assert len(got) == 15 and (got[7].next_delivery_time - got[7].delivery_time).days == 7


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("u", 1, None), ("v", 2, "x")], "participant string, n int, t string")
    write_summaries({"daily": df}, str(tmp_path))
    assert len(list((tmp_path / "daily/participant=u").glob("*.csv"))) == 1
    assert (next((tmp_path / "daily/participant=v").glob("*.csv"))).read_text() == "n,t\n2,x\n"


def test_streams_agree_with_batches(spark, tmp_path):
    times = [0, 5, 900, 1801, 4000, 4100, 9000, 20, 90_000]
    rows = spark.createDataFrame([("a", t * 1000, "k") for t in times], "who string, t long, kind string").withColumn("at", F.timestamp_millis("t"))
    rows.withColumn("lat", F.lit(1.0)).withColumn("lon", F.lit(2.0)).withColumn("participant", F.lit("a")).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))

    def drain(df, name):
        query = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return spark.table(name).collect()

    live = sorted((r.start_ms, r.end_ms, r.n_events) for r in drain(live_sessions(stream(), ["who"], "at"), "s1"))
    batch = sorted((r.start_ms, r.end_ms, r.n_events) for r in sessions(rows, ["who"], F.col("t")).collect())
    assert live == batch[:-1]  # the last session is still open
    assert sum(r.n for r in drain(live_counts(stream(), ["who"], "at", "kind"), "s2")) == len(times) - 1
    assert len(drain(live_collapse(stream()), "s3")) == len(times) - 2


def test_audio_surveys_are_known_by_their_prompts(spark, tmp_path):
    prompt = lambda p: json.dumps([{"prompt": p}])
    rows = [("s1", 1, prompt("old")), ("s1", 2, prompt("Describe your day")), ("s2", 1, prompt("x")), ("s2", 2, None), ("s3", 1, "[]"), ("s4", 1, "{broken")]
    prompts = audio_prompts(spark.createDataFrame(rows, "survey_id string, version int, survey_json string"))
    assert sorted(map(tuple, prompts.collect())) == [("Describe your day", "s1")]  # the latest version of s2 has none
    heard = R.audio_recordings(spark, study(tmp_path / "study"))
    config = spark.createDataFrame([("Describe your day", 4)], "prompt string, config_id int")
    assert {(r.survey_folder, r.prompt, r.config_id) for r in audio_rows(heard, prompts, config).collect()} == {("s1", "Describe your day", 4)}
    assert {r.config_id for r in audio_rows(heard, prompts, config.limit(0)).collect()} == {None}


def test_real_answers_and_sampled_rows(spark):
    df = spark.createDataFrame([("",), ("[]",), ("NO_ANSWER_SELECTED",), (None,), ("yes",)], "answer string")
    assert [r.answer for r in df.where(real_answer(F.col("answer"))).collect()] == ["yes"]
    rows = spark.range(1000)
    some = lists.sample_rows(rows, 100, 3)
    assert some.count() == some.distinct().count() == 100 and sorted(some.collect()) == sorted(lists.sample_rows(rows.repartition(7), 100, 3).collect())
    assert spark.range(1).select(timebins.local_now("UTC").alias("a"), timebins.month_from_today().alias("b")).where("a IS NOT NULL AND datediff(b, current_date()) = 31").count() == 1
