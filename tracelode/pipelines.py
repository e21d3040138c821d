"""From a study folder to the tables of each analysis, written as CSV by participant or survey.

Every pipeline is one plan over all participants; damaged files give no rows and stop nobody
else's. What is written twice over is computed once, from Parquet below the output folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.functions.geo import wrap_longitude
from tracelode.functions.instants import epoch_ms, stamp_ms
from tracelode.functions.timebins import Frequency
from tracelode.operators import comm_logs, gait, gps_reports, imputation, schedule, simulate
from tracelode.operators import survey_reports as R
from tracelode.operators import surveys as S
from tracelode.session import pin
from tracelode.sources import sinks
from tracelode.sources import study_folder as folder


def _stream(spark: SparkSession, study: str, stream: str, start_s: int | None, end_s: int | None) -> DataFrame:
    """A stream's rows from the files of each participant's window."""
    return folder.read_stream(spark, study, stream, windows=folder.read_windows(folder.stream_files(spark, study), stream, start_s, end_s))


def _kept(df: DataFrame, place: str) -> DataFrame:
    """The table, written as Parquet and read again."""
    df.write.mode("overwrite").parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def communication(spark: SparkSession, study: str, out: str, frequency: Frequency = Frequency.HOURLY_AND_DAILY, zone: str = "UTC", start_s: int | None = None, end_s: int | None = None) -> dict[str, DataFrame]:
    """Call and text summaries of a study; gives the tables it writes by frequency."""
    pin(spark)
    calls = _stream(spark, study, "calls", start_s, end_s).select("participant", "timestamp", F.col("hashed phone number").alias("phone"), F.col("call type").alias("call_type"), F.col("duration in seconds").alias("duration_s"))
    texts = _stream(spark, study, "texts", start_s, end_s).select("participant", "timestamp", F.col("hashed phone number").alias("phone"), F.col("sent vs received").alias("direction"), F.col("message length").alias("message_length"))
    found = comm_logs.communication_summaries(calls, texts, frequency, zone)
    sinks.write_summaries(found, out)
    return found


def walking(spark: SparkSession, study: str, out: str, frequencies: tuple[Frequency, ...] = (Frequency.DAILY, Frequency.HOURLY), zone: str = "UTC", start_s: int | None = None, end_s: int | None = None) -> dict[str, DataFrame]:
    """Walking time, steps and cadence of a study."""
    pin(spark)
    readings = _stream(spark, study, "accelerometer", start_s, end_s)
    seconds = _kept(gait.walking_seconds(readings, "participant", F.col("timestamp"), zone=zone).withColumnRenamed("source", "participant"), f"{out}/seconds").withColumnRenamed("participant", "source")
    found = {f.name.lower(): gait.gait_report(seconds, int(f) * 60, zone).withColumnRenamed("source", "participant") for f in frequencies}
    sinks.write_summaries(found, out)
    return found


def mobility(
    spark: SparkSession, study: str, out: str, frequencies: tuple[Frequency, ...] = (Frequency.DAILY,), zone: str = "UTC", start_s: int | None = None, end_s: int | None = None,
    accuracy_limit: float = 51.0, interval: int = 10, r: float | None = None, w: float = 20.0, h: float | None = None, least_share: float = 0.05,
    kernel: imputation.Kernel = imputation.Kernel(), with_rhythm: bool = False, earlier_states: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Trajectories, model states and mobility summaries of a study; an error where no fix is accurate enough.

    The pause radius ``r`` is the interval's number in metres unless stated, the step limit ``h`` the pause radius.
    """
    pin(spark)
    rows = _stream(spark, study, "gps", start_s, end_s)
    rows = _kept(rows.select("participant", F.floor(F.col("timestamp") / 1000).alias("t"), F.col("latitude").alias("lat"), wrap_longitude(F.col("longitude")).alias("lon"), "accuracy").dropna(subset=["participant", "t"]), f"{out}/rows")
    fixes = rows.where((F.col("accuracy") < accuracy_limit) & F.col("lat").between(-90, 90)).select("participant", "t", "lat", "lon").dropna().distinct()
    if fixes.isEmpty():
        raise ValueError(f"no fix has an accuracy below {accuracy_limit} m")
    r = float(interval) if r is None else r
    path = gps_reports.gps_reports(rows, fixes, (), zone, interval, r, w, r if h is None else h, least_share, kernel)["trajectory"]
    path = _kept(path, f"{out}/trajectory")
    observed = path.where("obs = 1")
    found = {"states": _kept(imputation.model_states(observed, earlier_states, kernel), f"{out}/states")}
    reports = {}
    for f in frequencies:
        daily = f == Frequency.DAILY
        rhythm = gps_reports.routine(path, zone) if daily and with_rhythm else None
        reports[f.name.lower()] = gps_reports.report(gps_reports.summary(path, int(f) * 60, zone), daily, zone, rhythm)
    sinks.write_summaries(reports, out)
    return found | reports | {"trajectory": path}


def surveys(
    spark: SparkSession, study: str, out: str, zone: str = "UTC", config_path: str | None = None, interventions_path: str | None = None, start: str | None = None, end: str | None = None, width: int = 50,
) -> dict[str, DataFrame]:
    """Survey tables of a study: all rows, answers, their summary, submissions, the wide form, and with a configuration the deliveries.

    Answers files that the timings lack are taken in as submissions of their own. ``start`` and
    ``end`` (dates) bound the files read, both excluded, and the schedule; a survey with more
    than ``width`` questions is an error.
    """
    pin(spark)
    limits = [None if x is None else int(_midnight(spark, x)) for x in (start, end)]
    timings = folder.read_stream(spark, study, "survey_timings", *limits, strict=True)
    named = timings.select("participant", F.coalesce("survey id", "survey_folder").alias("survey_id"), "timestamp", F.try_to_timestamp("UTC time").alias("utc_time"), F.col("question id").alias("question_id"), F.col("question type").alias("question_type"), F.col("question text").alias("question_text"), F.col("question answer options").alias("answer_options"), "answer", "event")
    files = folder.survey_answer_files(folder.read_stream(spark, study, "survey_answers", *limits, strict=True), "UTC")
    answers = files.select("participant", F.col("survey_folder").alias("survey_id"), stamp_ms(F.col("local_time")).alias("answers_ms"), F.col("question id").alias("question_id"), F.col("question type").alias("question_type"), "answer", "event")
    seen = named.select("participant", "survey_id", F.coalesce(epoch_ms(F.col("timestamp")), stamp_ms(F.col("utc_time"))).alias("t_ms"))
    submitted = answers.where("event = 'submitted'").select("participant", "survey_id", "answers_ms").distinct()
    missing = S.without_neighbour(submitted, seen, ["participant", "survey_id"], "answers_ms", "t_ms", 1_800_000)
    filled = answers.join(missing, ["participant", "survey_id", "answers_ms"], "left_semi").where(F.col("answer").isNull() | (F.col("answer") != "NOT_PRESENTED"))
    # A file's submission stands a millisecond after its answers, which all have the file's time.
    rows = named.withColumn("data_stream", F.lit("survey_timings")).unionByName(
        filled.withColumn("timestamp", F.col("answers_ms") + (F.coalesce(F.col("event") == "submitted", F.lit(False))).cast("int")).withColumn("data_stream", F.lit("survey_answers")).drop("answers_ms"), allowMissingColumns=True
    )
    numbered = _kept(S.number_events(S.survey_events(rows)), f"{out}/events")
    local = lambda c: F.from_utc_timestamp(F.timestamp_millis(c), zone)
    config = schedule.read_config(spark, config_path) if config_path else None
    if config is not None:
        listed = schedule.questions(config).where(F.col("question_id").isNotNull())
        ordinals = numbered.select("survey_id", "question_id").distinct().join(listed.groupBy("question_id").agg(F.min("ordinal").alias("ordinal")), "question_id")
    else:
        ordinals = spark.createDataFrame([], "survey_id string, question_id string, ordinal int")
    changed = R.answer_times(S.changed_answers(numbered), ordinals)
    positions = S.question_positions(spark.createDataFrame([], "survey_id string, question_id string"), numbered)
    fits = F.when(F.col("position") <= width, F.col("position")).otherwise(F.raise_error(F.lit(f"a survey has more than {width} questions")).cast("int"))
    wide = S.responses_wide(numbered, positions.withColumn("position", fits), width)
    found = {
        "agg_survey_data": numbered.withColumn("local_time", local("t_ms")),
        "answers_data": changed.withColumns({"all_answers": F.to_json("all_answers"), "first_time": local("first_time"), "last_time": local("last_time")}),
        "answers_summary": S.answer_summary(changed),
        "submits_only": S.submits_only(numbered),
        "by_survey": wide.withColumns({"start_time": local("start_time"), "end_time": local("end_time")}),
    }
    if config is not None and start and end:
        known = schedule.read_interventions(spark, interventions_path) if interventions_path else None
        deliveries = schedule.delivery_times(config, numbered.select("participant").distinct(), start, end, known)
        of = listed.select("config_id", "question_id").join(numbered.select("survey_id", "question_id").distinct(), "question_id").select("config_id", "survey_id").distinct()
        utc = lambda c: F.unix_millis(F.to_utc_timestamp(F.col(c).cast("timestamp"), zone))
        planned = deliveries.join(of, "config_id").select("participant", "survey_id", utc("delivery_time").alias("delivery_ms"), utc("next_delivery_time").alias("next_delivery_ms"))
        answered = R.deliveries_answered(planned, R.opened_lines(numbered), ["participant", "survey_id"])
        answered = _kept(answered.withColumn("survey_duration", F.when(F.col("survey_duration") > 0.001, F.col("survey_duration"))), f"{out}/deliveries")
        found["submits_and_deliveries"] = answered.withColumns({c: local(c) for c in ("delivery_ms", "submit_ms", "start_ms")})
        for name, unit in (("submits_summary", None), ("submits_summary_daily", "DAY"), ("submits_summary_hourly", "HOUR")):
            found[name] = R.summarise_deliveries(answered, ["participant", "survey_id"], unit)
    for name, df in found.items():
        sinks.write_by_key(df, f"{out}/{name}", "survey_id" if name == "by_survey" else "participant")
    return found


def _midnight(spark: SparkSession, day: str) -> int:
    """Epoch seconds of a date at midnight UTC."""
    return spark.sql("SELECT unix_timestamp(to_timestamp(:day)) AS s", args={"day": day}).first().s


def simulate_study(spark: SparkSession, out: str, users: int = 2, days: int = 2, document: dict | None = None, seed: int = 1) -> DataFrame:
    """Pings of simulated people, written as uploads are: one CSV per participant and hour."""
    fixes = simulate.simulate_gps(spark, users, days, seed=seed, people=simulate.people_of(document) if document else None)
    sinks.write_hourly(fixes, out)
    return fixes
