"""Survey queries over the survey tables, orders and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.functions.instants import stamp_ms, survey_instant
from tracelode.operators import survey_reports as R
from tracelode.operators import surveys as S
from tracelode.operators.packed import listed_choices
from tracelode.operators.schedule import delivery_times
from tracelode.sources.tables import load


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.number_events(S.survey_events(load(spark, sf_dir, "survey_timings")))


def survey_question_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(spark, sf_dir).drop("question_type", "instance")


def survey_sessionize_2h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(spark, sf_dir).drop("question_type", "question_index")


def survey_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``survey_id, question_id, config_id``: the surveys that list a question, numbered by id."""
    schema = "array<struct<question_id:string>>"
    rows = load(spark, sf_dir, "survey_history").select("survey_id", F.explode(F.from_json("survey_json", schema)).alias("q")).select("survey_id", "q.question_id").distinct()
    listed = rows.groupBy(F.lit(1)).agg(F.array_sort(F.collect_set("survey_id")).alias("ids"))  # one id per survey of a study
    return rows.join(listed.select(F.posexplode("ids").alias("config_id", "survey_id")), "survey_id").select("survey_id", "question_id", "config_id")


def survey_config_ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = S.survey_events(load(spark, sf_dir, "survey_timings"))
    config = survey_config(spark, sf_dir).groupBy("question_id").agg(F.min("config_id").alias("config_id"))
    return S.with_config(events, config).select("participant", "survey_id", "t_ms", "question_id", "event", "answer", "config_id", "submit_line")


def submits_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.submits_only(_numbered(spark, sf_dir))


def _answer_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.answer_times(S.changed_answers(_numbered(spark, sf_dir)), R.question_ordinals(load(spark, sf_dir, "survey_history")))


def changed_answers_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer_times(spark, sf_dir).withColumn("all_answers", F.concat_ws("|", "all_answers"))


def most_common_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = S.answer_summary(_answer_times(spark, sf_dir))
    return summary.withColumns({c: F.round(F.col(c) + 0.000013, 3) for c in ("average_time_to_answer", "average_number_of_answers")})


def responses_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every survey's instances in one table; question_k is the k-th question of the row's own survey."""
    events = S.survey_events(load(spark, sf_dir, "survey_timings"))
    return S.responses_wide(S.number_events(events), *_positions(spark, sf_dir, events))


def _positions(spark: SparkSession, sf_dir: str, events: DataFrame) -> tuple[DataFrame, int]:
    """Places of the surveys' questions and how many the longest has; the columns can't be known without."""
    positions = S.question_positions(survey_config(spark, sf_dir), events)
    return positions, positions.agg(F.max("position")).first()[0] or 0


def responses_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The header rows above each survey's part of ``responses_wide``."""
    events = S.survey_events(load(spark, sf_dir, "survey_timings"))
    positions, width = _positions(spark, sf_dir, events)
    return R.header_rows(positions, R.listed_questions(load(spark, sf_dir, "survey_history")), width)


def survey_opened_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.opened_lines(_numbered(spark, sf_dir)).select("participant", "survey_id", "t_ms", "question_id", "event", "answer", "submit_line", "opened_line", "start_ms", "num_questions_answered")


def _study(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Surveys with weekly, absolute and relative timings made from their numbers, people, interventions, question lists."""
    questions = survey_config(spark, sf_dir)
    config = questions.select("survey_id", "config_id").distinct()
    slots = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda d: F.when(d == F.col("config_id") % 7, F.array(F.lit(32_400).cast("long") + F.col("config_id") * 60)).otherwise(F.array().cast("array<bigint>")))
    absolute = F.when(F.col("config_id") % 3 == 0, F.array(F.array(*[F.lit(x).cast("long") for x in (2021, 3, 10, 3600)])))
    relative = F.when(F.col("config_id") % 4 == 1, F.array(F.array(F.lit("start"), F.lit("2"), F.lit("7200"))))
    config = config.select("survey_id", "config_id", slots.alias("timings"), absolute.alias("absolute_timings"), relative.alias("relative_timings"))
    events = S.survey_events(load(spark, sf_dir, "survey_timings"))
    people = events.select("participant").distinct()
    begun = events.groupBy("participant").agg(F.date_format(F.min(F.timestamp_millis("t_ms")), "yyyy-MM-dd").alias("day")).select("participant", F.lit("start").alias("intervention"), "day")
    return config, people, begun, questions


def _schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    config, people, begun, _ = _study(spark, sf_dir)
    return delivery_times(config, people, "2021-03-01", "2021-03-29", begun)


def survey_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries with the questions of their surveys."""
    return R.questions_of_schedule(_schedule(spark, sf_dir), survey_config(spark, sf_dir))


def submits_and_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = survey_config(spark, sf_dir).select("survey_id", "config_id").distinct()
    deliveries = _schedule(spark, sf_dir).join(ids, "config_id").select("participant", "survey_id", stamp_ms(F.col("delivery_time")).alias("delivery_ms"), stamp_ms(F.col("next_delivery_time")).alias("next_delivery_ms"))
    return R.deliveries_answered(deliveries, R.opened_lines(_numbered(spark, sf_dir)), ["participant", "survey_id"])


def _overview(unit: str | None):
    return lambda spark, sf_dir: R.summarise_deliveries(submits_and_deliveries(spark, sf_dir), ["participant", "survey_id"], unit)


def _seps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.separator_choices(R.listed_questions(load(spark, sf_dir, "survey_history")))


def survey_choices_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "survey_timings").select("question_id", "question_type", "answer_options", "answer").distinct()
    return R.repaired_choices(rows, _seps(spark, sf_dir)).withColumn("answer_options", F.concat_ws("|", "answer_options"))


def survey_answer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.answer_rows(load(spark, sf_dir, "survey_answers"), _seps(spark, sf_dir))
    return rows.select("participant", "survey_id", stamp_ms(F.col("file_time")).alias("answers_ms"), "question_id", "question_type", F.concat_ws("|", "answer_options").alias("answer_options"), "answer", "file_number", "question_index")


def survey_rows_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with configuration, local time and blanked answers."""
    config = survey_config(spark, sf_dir).groupBy("question_id").agg(F.min("config_id").alias("config_id"))
    rows = R.configured_rows(S.with_config(S.survey_events(load(spark, sf_dir, "survey_timings")), config), "America/New_York")
    return rows.select("participant", "survey_id", "question_id", "event", "answer", "config_id", "submit_line", F.unix_millis(F.col("local_time").cast("timestamp")).alias("local_ms"))


def missing_submissions_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = load(spark, sf_dir, "survey_answers").select("participant", "survey_id", stamp_ms(F.col("file_time")).alias("answers_ms")).distinct()
    timings = load(spark, sf_dir, "survey_timings").select("participant", "survey_id", survey_instant().alias("t_ms"))
    return S.without_neighbour(files, timings, ["participant", "survey_id"], "answers_ms", "t_ms", 1_800_000)


def _deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("participant"), F.col("o_orderdate").alias("delivery_time"))
    return S.next_deliveries(orders, ["participant"])


def _submits(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    submissions = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("participant"), F.col("l_shipdate").alias("local_time"), F.col("o_orderdate").alias("start_time")
    )
    return S.delivery_submits(_deliveries(spark, sf_dir), submissions, ["participant"])


def _summary(unit: str | None):
    return lambda spark, sf_dir: S.summarise_submits(_submits(spark, sf_dir), ["participant"], unit)


def answers_fill_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of answers files that the timings stream lacks, with types standardised and absent answers nulled."""
    rows = load(spark, sf_dir, "survey_answers").select("participant", "survey_id", stamp_ms(F.col("file_time")).alias("answers_ms"), "question_id", S.standard_question_type(F.col("question_type")).alias("question_type"), F.nullif("answer", F.lit("NO_ANSWER_SELECTED")).alias("answer")).distinct()
    missing = missing_submissions_antijoin(spark, sf_dir)
    return rows.join(missing, ["participant", "survey_id", "answers_ms"], "left_semi").where(F.col("answer").isNull() | (F.col("answer") != "NOT_PRESENTED"))


def choices_with_separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Choices of each question that hold a list separator themselves."""
    listed = listed_choices(load(spark, sf_dir, "survey_history")).select("question_id", F.explode("choices").alias("choice"))
    return listed.where(F.col("choice").contains(";") | F.col("choice").contains(","))


QUERIES = {
    "survey_question_index": survey_question_index,
    "survey_sessionize_2h": survey_sessionize_2h,
    "survey_config_ffill": survey_config_ffill,
    "submits_only": submits_only,
    "changed_answers_detail": changed_answers_detail,
    "most_common_answer": most_common_answer,
    "responses_wide": responses_wide,
    "responses_headers": responses_headers,
    "survey_opened_lines": survey_opened_lines,
    "survey_schedule": survey_schedule,
    "submits_and_deliveries": submits_and_deliveries,
    "submits_overview_total": _overview(None),
    "submits_overview_daily": _overview("DAY"),
    "survey_choices_repaired": survey_choices_repaired,
    "survey_answer_rows": survey_answer_rows,
    "survey_rows_config": survey_rows_config,
    "missing_submissions_antijoin": missing_submissions_antijoin,
    "answers_fill_in": answers_fill_in,
    "choices_with_separators": choices_with_separators,
    "schedule_lead_sentinel": _deliveries,
    "delivery_band_join": _submits,
    "submits_summary_total": _summary(None),
    "submits_summary_daily": _summary("DAY"),
    "submits_summary_hourly": _summary("HOUR"),
}

_T = """coalesce(CASE WHEN abs("timestamp") < 100000000000 THEN "timestamp" * 1000 WHEN abs("timestamp") < 100000000000000 THEN "timestamp"
 WHEN abs("timestamp") < 100000000000000000 THEN "timestamp" // 1000 ELSE "timestamp" // 1000000 END, epoch_us(utc_time) // 1000)"""
_TYPE = """CASE question_type WHEN 'radio_button' THEN 'Radio Button Question' WHEN 'checkbox' THEN 'Checkbox Question' WHEN 'slider' THEN 'Slider Question'
 WHEN 'free_response' THEN 'Open Response Question' WHEN 'info_text_box' THEN 'Info Text Box' ELSE question_type END"""
_EVENTS = f"""
WITH r AS (SELECT DISTINCT participant, survey_id, {_T} AS t_ms, question_id, {_TYPE} AS question_type, answer,
   CASE WHEN question_id IN ('Survey first rendered and displayed to user', 'User hit submit') THEN question_id
   WHEN lower(trim(event)) IN ('submitted', 'notified', 'changed', 'present', 'unpresent', 'expired') THEN lower(trim(event)) ELSE trim(event) END AS event FROM survey_timings),
 k AS (SELECT * FROM r WHERE participant IS NOT NULL AND survey_id IS NOT NULL AND t_ms IS NOT NULL),
 f AS (SELECT DISTINCT ON (survey_id) survey_id, question_id AS first_question FROM k WHERE question_id IS NOT NULL AND question_id IS DISTINCT FROM event ORDER BY survey_id, participant, t_ms, question_id),
 e AS (SELECT participant, survey_id, t_ms, CASE WHEN question_id = event THEN coalesce(first_question, '') ELSE question_id END AS question_id, question_type, event, answer FROM k LEFT JOIN f USING (survey_id)),
 p AS (SELECT *, CASE WHEN question_id = lag(question_id) OVER g THEN 0 ELSE 1 END AS c,
   CASE WHEN row_number() OVER g = 1 OR coalesce(lag(event) OVER g IN ('submitted', 'User hit submit', 'notified'), false)
   OR coalesce(event = 'Survey first rendered and displayed to user', false) OR coalesce(t_ms - lag(t_ms) OVER g > 7200000, false) THEN 1 ELSE 0 END AS o
   FROM e WINDOW g AS (PARTITION BY survey_id ORDER BY participant, t_ms, question_id NULLS FIRST, event NULLS FIRST, answer NULLS FIRST)),
 n AS (SELECT participant, survey_id, t_ms, question_id, question_type, event, answer, sum(c) OVER w AS question_index, sum(o) OVER w AS instance FROM p
   WINDOW w AS (PARTITION BY survey_id, participant ORDER BY t_ms, question_id NULLS FIRST, event NULLS FIRST, answer NULLS FIRST ROWS UNBOUNDED PRECEDING))"""
_CONFIG = """,
 h AS (SELECT DISTINCT survey_id, unnest(from_json(survey_json, '[{"question_id": "VARCHAR"}]')).question_id AS question_id FROM survey_history WHERE survey_json IS NOT NULL),
 ci AS (SELECT survey_id, row_number() OVER (ORDER BY survey_id) - 1 AS config_id FROM (SELECT DISTINCT survey_id FROM h WHERE true)),
 cf AS (SELECT question_id, min(config_id) AS config_id FROM h JOIN ci USING (survey_id) GROUP BY question_id)"""
_CHANGED = (
    _EVENTS
    + """,
 cl AS (SELECT survey_id, participant, question_id, question_type, question_index, list(answer ORDER BY t_ms, event NULLS FIRST, answer NULLS FIRST) AS r, min(t_ms) AS first_time, max(t_ms) AS last_time FROM n GROUP BY ALL),
 c2 AS (SELECT *, CASE WHEN r[1] IS NULL THEN r[2:] ELSE r END AS a FROM cl),
 ch AS (SELECT *, CASE WHEN len(a) > 1 AND a[len(a)] IS NOT DISTINCT FROM a[len(a) - 1] THEN a[:len(a) - 1] ELSE a END AS l FROM c2)"""
)
_TIMES = (
    _CHANGED
    + """,
 hq AS (SELECT survey_id, from_json(survey_json, '[{"question_id": "VARCHAR", "question_text": "VARCHAR", "question_type": "VARCHAR", "answers": [{"text": "VARCHAR"}]}]') AS qs FROM survey_history WHERE survey_json IS NOT NULL),
 hu AS (SELECT survey_id, unnest(range(1, len(qs) + 1)) AS o, unnest(qs) AS q FROM hq),
 od AS (SELECT survey_id, q.question_id AS question_id, min(o) AS ordinal FROM hu WHERE q.question_id IS NOT NULL GROUP BY ALL),
 at0 AS (SELECT ch.*, ordinal, len(l) AS num_answers FROM ch LEFT JOIN od USING (survey_id, question_id)),
 at1 AS (SELECT *, sum(CASE WHEN ordinal = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY survey_id, participant ORDER BY question_index, first_time, question_id NULLS FIRST, question_type NULLS FIRST ROWS UNBOUNDED PRECEDING) AS passage FROM at0),
 at2 AS (SELECT *, lag(last_time) OVER (PARTITION BY survey_id, participant, passage ORDER BY question_index, first_time, question_id NULLS FIRST, question_type NULLS FIRST) AS bef FROM at1),
 tt AS (SELECT *, (last_time - CASE WHEN num_answers = 1 AND first_time = last_time AND coalesce(ordinal, 0) <> 1 THEN bef ELSE first_time END) / 1000 AS time_to_answer FROM at2)"""
)
_OPENED = _EVENTS + """,
 ow AS (SELECT n.*, CASE WHEN coalesce(instance <> lag(instance) OVER g, true) THEN 1 ELSE 0 END AS op, CASE WHEN coalesce(event IN ('submitted', 'User hit submit'), false) THEN 1 ELSE 0 END AS submit_line FROM n
   WINDOW g AS (PARTITION BY survey_id ORDER BY participant, t_ms, question_id NULLS FIRST, event NULLS FIRST, answer NULLS FIRST)),
 qa AS (SELECT survey_id, participant, instance, min(t_ms) AS start_ms, count(DISTINCT CASE WHEN answer NOT IN ('', '[]', 'NO_ANSWER_SELECTED') THEN question_id END) AS num_questions_answered FROM n GROUP BY ALL),
 ol AS (SELECT ow.*, max(op) OVER (PARTITION BY participant, t_ms) AS opened_line, start_ms, num_questions_answered FROM ow JOIN qa USING (survey_id, participant, instance))"""
_PLAN = """,
 pc AS (SELECT DISTINCT survey_id, dense_rank() OVER (ORDER BY survey_id) - 1 AS cid FROM (SELECT DISTINCT survey_id, unnest(from_json(survey_json, '[{"question_id": "VARCHAR"}]')).question_id AS question_id FROM survey_history WHERE survey_json IS NOT NULL)),
 pp AS (SELECT participant, min(t_ms) AS begun FROM e GROUP BY participant),
 wk AS (SELECT participant, cid, TIMESTAMP '2021-03-01' + to_days(CAST(w * 7 + (cid % 7 + 6) % 7 AS INT)) + to_seconds(32400 + cid * 60) AS d FROM pc, pp, range(4) r(w)
   UNION SELECT participant, cid, TIMESTAMP '2021-03-10 01:00:00' FROM pc, pp WHERE cid % 3 = 0
   UNION SELECT participant, cid, epoch_ms(begun)::DATE + to_days(2) + to_seconds(7200) FROM pc, pp WHERE cid % 4 = 1),
 wn AS (SELECT *, coalesce(lead(d) OVER (PARTITION BY participant, cid ORDER BY d), d + INTERVAL 7 DAYS) AS nx FROM wk),
 sd AS (SELECT * FROM wn WHERE d > TIMESTAMP '2021-03-01' AND d < TIMESTAMP '2021-03-29')"""
_ANSWERED = _OPENED + _PLAN + """,
 ln AS (SELECT DISTINCT participant, survey_id, t_ms, submit_line, opened_line, start_ms, num_questions_answered FROM ol WHERE submit_line = 1 OR opened_line = 1),
 da AS (SELECT sd.participant, pc.survey_id, epoch_ms(d) AS delivery_ms, epoch_ms(nx) AS nx FROM sd JOIN pc USING (cid)),
 jn AS (SELECT da.*, t_ms, submit_line, opened_line, start_ms, num_questions_answered, t_ms >= delivery_ms AND t_ms < nx AS hit FROM da JOIN ln USING (participant, survey_id)),
 fl AS (SELECT *, CASE WHEN hit AND submit_line = 1 THEN 1 ELSE 0 END AS sf, CASE WHEN hit AND (submit_line = 1 OR opened_line = 1) THEN 1 ELSE 0 END AS of FROM jn),
 mx AS (SELECT *, max(sf) OVER p AS submit_flg, max(of) OVER p AS opened_flg FROM fl WINDOW p AS (PARTITION BY participant, survey_id, delivery_ms)),
 an AS (SELECT DISTINCT participant, survey_id, delivery_ms, submit_flg, opened_flg, CASE WHEN submit_flg = 1 THEN t_ms END AS submit_ms, CASE WHEN opened_flg = 1 THEN start_ms END AS start_ms,
   CASE WHEN opened_flg = 1 THEN num_questions_answered END AS num_questions_answered FROM mx WHERE sf = submit_flg AND of = opened_flg),
 af AS (SELECT *, (submit_ms - delivery_ms) / 1000 AS time_to_submit, (start_ms - delivery_ms) / 1000 AS time_to_open, nullif((submit_ms - start_ms) / 1000, 0) AS survey_duration FROM an)"""
_SEPS = """
 lq AS (SELECT unnest(from_json(survey_json, '[{"question_id": "VARCHAR", "question_type": "VARCHAR", "answers": [{"text": "VARCHAR"}]}]')) AS q FROM survey_history WHERE survey_json IS NOT NULL),
 lc AS (SELECT q.question_id AS question_id, unnest(q.answers).text AS c FROM lq WHERE q.question_type = 'radio_button'),
 sp AS (SELECT question_id, list_sort(list(DISTINCT replace(replace(c, ',', ';'), '; ', ';'))) AS seps FROM lc WHERE regexp_matches(c, '[,;]') AND question_id IS NOT NULL GROUP BY question_id),"""


def _mended(options: str) -> str:
    tight = f"replace({options}, '; ', ';')"
    mended = f"CASE WHEN question_type IN ('radio_button', 'Radio Button Question') AND seps IS NOT NULL THEN list_reduce(list_prepend({tight}, seps), lambda a, s: replace(a, s, replace(s, ';', ', '))) ELSE {tight} END"
    return f"string_split(regexp_replace({mended}, '^\\[|\\]$|^nan$', '', 'g'), ';')"


_SUBMITS = """
WITH d0 AS (SELECT DISTINCT o_custkey AS participant, o_orderdate AS delivery_time FROM orders),
 d AS (SELECT *, coalesce(lead(delivery_time) OVER (PARTITION BY participant ORDER BY delivery_time), delivery_time + INTERVAL 7 DAYS) AS next_delivery_time FROM d0),
 s AS (SELECT o_custkey AS participant, l_shipdate AS local_time, o_orderdate AS start_time FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
 j AS (SELECT d.participant, d.delivery_time, local_time, start_time FROM d LEFT JOIN s ON d.participant = s.participant AND local_time >= delivery_time AND local_time < next_delivery_time),
 b AS (SELECT participant, delivery_time, CASE WHEN count(local_time) > 0 THEN 1 ELSE 0 END AS submit_flg, min(local_time) AS submit_time,
   min(struct_pack(a := local_time, b := start_time)) FILTER (local_time IS NOT NULL) AS q FROM j GROUP BY ALL),
 u AS (SELECT participant, delivery_time, submit_flg, submit_time, q.b AS start_time, (epoch_us(submit_time) - epoch_us(delivery_time)) / 1e6 AS time_to_submit,
   (epoch_us(q.b) - epoch_us(delivery_time)) / 1e6 AS time_to_open, nullif((epoch_us(submit_time) - epoch_us(q.b)) / 1e6, 0) AS survey_duration FROM b)"""


def _summary_sql(clock: str) -> str:
    return f"{_SUBMITS} SELECT participant{clock}, count(DISTINCT delivery_time) AS num_surveys, sum(submit_flg)::BIGINT AS num_complete_surveys, avg(time_to_submit) AS avg_time_to_submit, avg(time_to_open) AS avg_time_to_open, avg(survey_duration) AS avg_duration FROM u GROUP BY ALL"


_DAY = ", year(delivery_time) AS year, month(delivery_time) AS month, day(delivery_time) AS day"
_MISSING = f"""
WITH a AS (SELECT DISTINCT participant, survey_id, epoch_us(file_time) // 1000 AS answers_ms FROM survey_answers),
 t AS (SELECT participant, survey_id, {_T} AS t_ms FROM survey_timings),
 m AS (SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.participant = a.participant AND t.survey_id = a.survey_id AND abs(t_ms - answers_ms) <= 1800000))"""

ORACLE = {
    "survey_question_index": _EVENTS + " SELECT participant, survey_id, t_ms, question_id, event, answer, question_index::BIGINT AS question_index FROM n",
    "survey_sessionize_2h": _EVENTS + " SELECT participant, survey_id, t_ms, question_id, event, answer, instance::BIGINT AS instance FROM n",
    "survey_config_ffill": _EVENTS + _CONFIG + """
 SELECT participant, survey_id, t_ms, question_id, event, answer, CASE WHEN coalesce(event IN ('submitted', 'User hit submit'), false)
   THEN last_value(config_id IGNORE NULLS) OVER (PARTITION BY survey_id, participant ORDER BY t_ms, question_id NULLS FIRST, event NULLS FIRST, answer NULLS FIRST ROWS UNBOUNDED PRECEDING) ELSE config_id END AS config_id,
   CASE WHEN coalesce(event IN ('submitted', 'User hit submit'), false) THEN 1 ELSE 0 END AS submit_line FROM e LEFT JOIN cf USING (question_id)""",
    "submits_only": _EVENTS + " SELECT survey_id, participant, instance::BIGINT AS instance, min(t_ms) AS min_time, max(t_ms) AS max_time, (max(t_ms) - min(t_ms)) // 1000 % 86400 AS time_to_complete FROM n GROUP BY survey_id, participant, instance",
    "changed_answers_detail": _TIMES + """ SELECT survey_id, participant, question_id, question_type, question_index::BIGINT AS question_index, list_filter(r, lambda x: x IS NOT NULL)[-1] AS last_answer,
   coalesce(array_to_string(l, '|'), '') AS all_answers, num_answers, first_time, last_time, ordinal::INT AS ordinal, time_to_answer FROM tt""",
    "most_common_answer": _TIMES + """,
 tot AS (SELECT survey_id, participant, question_id, question_type, count(*) AS num_answers, round(avg(time_to_answer) + 0.000013, 3) AS average_time_to_answer, round(avg(len(l)) + 0.000013, 3) AS average_number_of_answers FROM tt GROUP BY ALL),
 sg AS (SELECT survey_id, participant, question_id, question_type, answer, count(*) AS c FROM (SELECT *, unnest(l) AS answer FROM ch) WHERE answer IS NOT NULL GROUP BY ALL),
 mc AS (SELECT *, row_number() OVER (PARTITION BY survey_id, participant, question_id, question_type ORDER BY c DESC, answer) AS q FROM sg)
 SELECT tot.*, coalesce(mc.answer, '0') AS most_common_answer FROM tot LEFT JOIN mc ON q = 1 AND tot.survey_id = mc.survey_id AND tot.participant = mc.participant
   AND tot.question_id IS NOT DISTINCT FROM mc.question_id AND tot.question_type IS NOT DISTINCT FROM mc.question_type""",
    "survey_opened_lines": _OPENED + " SELECT participant, survey_id, t_ms, question_id, event, answer, submit_line, opened_line, start_ms, num_questions_answered::INT AS num_questions_answered FROM ol",
    "survey_schedule": _EVENTS + _PLAN + """,
 sq AS (SELECT DISTINCT cid, q.question_id FROM (SELECT survey_id, unnest(from_json(survey_json, '[{"question_id": "VARCHAR"}]')) AS q FROM survey_history WHERE survey_json IS NOT NULL) JOIN pc USING (survey_id))
 SELECT participant, sd.cid::INT AS config_id, d AS delivery_time, nx AS next_delivery_time, question_id FROM sd LEFT JOIN sq USING (cid)""",
    "submits_and_deliveries": _ANSWERED + " SELECT participant, survey_id, delivery_ms, submit_flg, opened_flg, submit_ms, start_ms, num_questions_answered::INT AS num_questions_answered, time_to_submit, time_to_open, survey_duration FROM af",
    "survey_choices_repaired": "WITH" + _SEPS + f"""
 r AS (SELECT DISTINCT question_id, question_type, answer_options, answer FROM survey_timings)
SELECT question_id, question_type, coalesce(array_to_string({_mended("answer_options")}, '|'), '') AS answer_options, replace(replace(answer, '; ', ';'), ';', ', ') AS answer FROM r LEFT JOIN sp USING (question_id)""",
    "survey_answer_rows": "WITH" + _SEPS + f"""
 d AS (SELECT DISTINCT * FROM survey_answers),
 r AS (SELECT *, dense_rank() OVER (PARTITION BY participant, survey_id ORDER BY file_time) AS file_number,
   row_number() OVER (PARTITION BY participant, survey_id, file_time ORDER BY question_id NULLS FIRST, question_type NULLS FIRST, question_text NULLS FIRST, answer_options NULLS FIRST, answer NULLS FIRST) AS question_index FROM d),
 m AS (SELECT r.* EXCLUDE (answer), {_mended("answer_options")} AS ops, replace(replace(answer, '; ', ';'), ';', ', ') AS a FROM r LEFT JOIN sp USING (question_id)),
 k AS (SELECT *, CASE WHEN question_type = 'Radio Button Question' AND file_time > TIMESTAMP '2016-12-06' AND regexp_full_match(a, '[0-9]+') THEN ops[try_cast(a AS BIGINT) + 1] ELSE a END AS answer FROM m WHERE a IS NULL OR a <> 'NOT_PRESENTED')
SELECT participant, survey_id, epoch_us(file_time) // 1000 AS answers_ms, question_id, {_TYPE} AS question_type, coalesce(array_to_string(ops, '|'), '') AS answer_options, nullif(answer, 'NO_ANSWER_SELECTED') AS answer,
 file_number::INT AS file_number, question_index::INT AS question_index FROM k""",
    "survey_rows_config": _EVENTS + _CONFIG + """,
 wc AS (SELECT e.*, CASE WHEN coalesce(event IN ('submitted', 'User hit submit'), false)
   THEN last_value(config_id IGNORE NULLS) OVER (PARTITION BY survey_id, participant ORDER BY t_ms, question_id NULLS FIRST, event NULLS FIRST, answer NULLS FIRST ROWS UNBOUNDED PRECEDING) ELSE config_id END AS config_id,
   CASE WHEN coalesce(event IN ('submitted', 'User hit submit'), false) THEN 1 ELSE 0 END AS submit_line FROM e LEFT JOIN cf USING (question_id))
SELECT participant, survey_id, question_id, event, nullif(answer, 'NO_ANSWER_SELECTED') AS answer, config_id::INT AS config_id, submit_line,
 t_ms - CASE WHEN t_ms < 1615705200000 THEN 18000000 ELSE 14400000 END AS local_ms FROM wc WHERE question_id IS NOT NULL OR config_id IS NOT NULL""",
    "missing_submissions_antijoin": _MISSING + " SELECT * FROM m",
    "answers_fill_in": _MISSING + f"""
 SELECT DISTINCT x.participant, x.survey_id, m.answers_ms, question_id, {_TYPE} AS question_type, nullif(answer, 'NO_ANSWER_SELECTED') AS answer FROM survey_answers x
   JOIN m ON x.participant = m.participant AND x.survey_id = m.survey_id AND epoch_us(file_time) // 1000 = m.answers_ms WHERE answer IS NULL OR answer <> 'NOT_PRESENTED'""",
    "choices_with_separators": """
WITH q AS (SELECT unnest(from_json(survey_json, '[{"question_id": "VARCHAR", "answers": [{"text": "VARCHAR"}]}]')) AS q FROM survey_history WHERE survey_json IS NOT NULL),
 c AS (SELECT DISTINCT q.question_id AS question_id, unnest(q.answers).text AS choice FROM q)
SELECT * FROM c WHERE choice LIKE '%;%' OR choice LIKE '%,%'""",
    "schedule_lead_sentinel": _SUBMITS + " SELECT * FROM d",
    "delivery_band_join": _SUBMITS + " SELECT * FROM u",
    "submits_summary_total": _summary_sql(""),
    "submits_summary_daily": _summary_sql(_DAY),
    "submits_summary_hourly": _summary_sql(_DAY + ", hour(delivery_time) AS hour"),
}

for _name, _clock in {"total": "", "daily": ", year(epoch_ms(delivery_ms)) AS year, month(epoch_ms(delivery_ms)) AS month, day(epoch_ms(delivery_ms)) AS day"}.items():
    ORACLE[f"submits_overview_{_name}"] = _ANSWERED + f""" SELECT participant, survey_id{_clock}, count(DISTINCT delivery_ms) AS num_surveys, sum(submit_flg)::BIGINT AS num_complete_surveys, sum(opened_flg)::BIGINT AS num_opened_surveys,
 avg(time_to_submit) AS avg_time_to_submit, avg(time_to_open) AS avg_time_to_open, avg(survey_duration) AS avg_duration FROM af GROUP BY ALL"""

_PLACES = """,
 qp AS (SELECT survey_id, question_id, min(late) AS late FROM (SELECT DISTINCT survey_id, unnest(from_json(survey_json, '[{"question_id": "VARCHAR"}]')).question_id AS question_id, 0 AS late FROM survey_history WHERE survey_json IS NOT NULL
   UNION ALL SELECT survey_id, question_id, 1 FROM e WHERE answer IS NOT NULL) WHERE survey_id IS NOT NULL AND question_id IS NOT NULL GROUP BY ALL),
 po AS (SELECT survey_id, question_id, row_number() OVER (PARTITION BY survey_id ORDER BY late, question_id) AS position FROM qp)"""
#: The longest survey of the fixed history has seven questions; SQL has to name its columns.
_WIDTH = 7
_COLUMNS = ", ".join(f"max(v) FILTER (position = {i}) AS question_{i}" for i in range(1, _WIDTH + 1))
ORACLE["responses_wide"] = _EVENTS + _PLACES + f""",
 fa AS (SELECT survey_id, participant, instance, question_id, max(struct_pack(t := t_ms, a := answer)).a AS v FROM n WHERE answer IS NOT NULL GROUP BY ALL),
 wd AS (SELECT survey_id, participant, instance, {_COLUMNS} FROM fa JOIN po USING (survey_id, question_id) GROUP BY ALL),
 ss AS (SELECT survey_id, participant, instance, min(t_ms) AS start_time, max(t_ms) AS end_time, (max(t_ms) - min(t_ms)) / 1000 AS survey_duration FROM n GROUP BY ALL)
SELECT survey_id, participant, instance::BIGINT AS instance, start_time, end_time, survey_duration, {", ".join(f"question_{i}" for i in range(1, _WIDTH + 1))} FROM ss LEFT JOIN wd USING (survey_id, participant, instance)"""
ORACLE["responses_headers"] = _EVENTS + _PLACES + f""",
 hq AS (SELECT survey_id, unnest(from_json(survey_json, '[{{"question_id": "VARCHAR", "question_text": "VARCHAR", "question_type": "VARCHAR", "answers": [{{"text": "VARCHAR"}}]}}]')) AS q FROM survey_history WHERE survey_json IS NOT NULL),
 ab AS (SELECT survey_id, q.question_id AS question_id, max(q.question_text) AS x, max(q.question_type) AS y, max(coalesce(array_to_string(list_transform(q.answers, lambda a: a.text), ';'), '')) AS z FROM hq WHERE q.question_id IS NOT NULL GROUP BY ALL),
 hr AS (SELECT survey_id, position, unnest([{{'r': 1, 'p': 'Question Text', 'v': x}}, {{'r': 2, 'p': 'Question Type', 'v': y}}, {{'r': 3, 'p': 'Question Options', 'v': z}}, {{'r': 4, 'p': 'Question ID', 'v': question_id}}]) AS h FROM po LEFT JOIN ab USING (survey_id, question_id)),
 hv AS (SELECT survey_id, position, h.r AS row, h.p AS participant, h.v AS v FROM hr)
SELECT survey_id, row::INT AS "row", participant, {_COLUMNS} FROM hv GROUP BY survey_id, row, participant"""
