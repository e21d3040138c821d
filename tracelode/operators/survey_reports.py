"""Survey tables beyond the numbered events: openings, deliveries answered, times to answer, repaired choices.

Columns follow ``surveys.survey_events``; times are epoch ms unless a name says ``_time`` of a
delivery, which is local wall time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.functions.ordered import with_neighbour
from tracelode.operators.surveys import NO_ANSWER, ORDER, SUBMITTED, standard_question_type

#: Android's name of a radio question, and the day after which it stores the place of a choice instead of its text.
ANDROID_RADIO, ANDROID_PLACES_SINCE = "Radio Button Question", "2016-12-06"
RADIO = ("radio_button", ANDROID_RADIO)
LISTED = "array<struct<question_id:string,question_text:string,question_type:string,prompt:string,answers:array<struct<text:string>>>>"


def real_answer(answer: Column) -> Column:
    """Whether an answer says something: neither null, empty, an empty list nor "nothing selected"."""
    return F.coalesce(~answer.isin(*NO_ANSWER), F.lit(False))


def opened_lines(numbered: DataFrame) -> DataFrame:
    """Adds ``submit_line, opened_line, start_ms, num_questions_answered`` to ``number_events``.

    A row opens a survey where its instance number differs from the row before in the order
    (survey, participant, time); all rows of that participant and instant are marked. The start
    is the first instant of the row's instance; questions count once and only with a real answer.
    """
    rows = with_neighbour(numbered, "survey_id", "participant", ORDER, ["instance"], "prev")
    opens = F.coalesce(F.col("instance") != F.col("prev.instance"), F.lit(True)).cast("int")
    instance = Window.partitionBy("survey_id", "participant", "instance")
    answered = F.collect_set(F.when(real_answer(F.col("answer")), F.col("question_id"))).over(instance)  # at most a survey's questions
    return (
        rows.withColumn("_opens", opens)
        .drop("prev")
        .withColumn("submit_line", F.coalesce(F.col("event").isin(*SUBMITTED), F.lit(False)).cast("int"))
        .withColumn("opened_line", F.max("_opens").over(Window.partitionBy("participant", "t_ms")))
        .withColumn("start_ms", F.min("t_ms").over(instance))
        .withColumn("num_questions_answered", F.size(answered))
        .drop("_opens")
    )


def deliveries_answered(deliveries: DataFrame, lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What came of each delivery before the next one: ``*keys, delivery_ms, submit_flg, opened_flg, submit_ms, start_ms, num_questions_answered, time_to_submit, time_to_open, survey_duration``.

    ``deliveries``: keys, delivery_ms, next_delivery_ms; ``lines``: keys, t_ms, submit_line,
    opened_line, start_ms, num_questions_answered. A submitted survey was opened. A delivery has
    a row for each submission in its span, else for each opening, else one with nulls; deliveries
    of keys without any line are left out. Seconds; a duration of zero (only the answers were
    found) is null. Lines fall to the delivery before them by one window over both tables, so a
    key's deliveries and lines are never paired with each other.
    """
    nothing = F.lit(None).cast("long")
    one = deliveries.select(*keys, F.col("delivery_ms").alias("_t"), F.lit(0).alias("_kind"), "delivery_ms", "next_delivery_ms", F.lit(0).alias("submit_line"), F.lit(0).alias("opened_line"), nothing.alias("start_ms"), F.lit(None).cast("int").alias("num_questions_answered"))
    two = lines.where("submit_line = 1 OR opened_line = 1").select(*keys, F.col("t_ms").alias("_t"), F.lit(1).alias("_kind"), nothing.alias("delivery_ms"), nothing.alias("next_delivery_ms"), "submit_line", "opened_line", "start_ms", "num_questions_answered").distinct()
    running = Window.partitionBy(*keys).orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(c, ignorenulls=True).over(running)
    both = one.unionByName(two).withColumn("_d", last("delivery_ms")).withColumn("_n", last("next_delivery_ms")).withColumn("_any", F.max("_kind").over(Window.partitionBy(*keys)))
    both = both.where((F.col("_any") == 1) & F.col("_d").isNotNull() & ((F.col("_kind") == 0) | (F.col("_t") < F.col("_n"))))
    span = Window.partitionBy(*keys, "_d")
    both = both.withColumn("submit_flg", F.max("submit_line").over(span)).withColumn("opened_flg", F.greatest("submit_flg", F.max("opened_line").over(span)))
    kept = both.where(F.when(F.col("submit_flg") == 1, F.col("submit_line") == 1).when(F.col("opened_flg") == 1, F.col("opened_line") == 1).otherwise(F.col("_kind") == 0))
    submit = F.when(F.col("submit_flg") == 1, F.col("_t"))
    return kept.select(
        *keys, F.col("_d").alias("delivery_ms"), "submit_flg", "opened_flg", submit.alias("submit_ms"), "start_ms", "num_questions_answered",
        ((submit - F.col("_d")) / 1000).alias("time_to_submit"), ((F.col("start_ms") - F.col("_d")) / 1000).alias("time_to_open"),
        F.nullif((submit - F.col("start_ms")) / 1000, F.lit(0.0)).alias("survey_duration"),
    ).distinct()


def summarise_deliveries(answered: DataFrame, keys: Sequence[str], unit: str | None = None) -> DataFrame:
    """Deliveries, those completed and opened, and mean times per key, or per key and UNIT ("DAY", "HOUR") of delivery."""
    at = F.date_trunc(unit, F.timestamp_millis("delivery_ms")) if unit else None
    clock = {} if unit is None else {"year": F.year(at), "month": F.month(at), "day": F.dayofmonth(at)} | ({"hour": F.hour(at)} if unit == "HOUR" else {})
    return answered.groupBy(*keys, *[c.alias(n) for n, c in clock.items()]).agg(
        F.countDistinct("delivery_ms").alias("num_surveys"), F.sum("submit_flg").alias("num_complete_surveys"), F.sum("opened_flg").alias("num_opened_surveys"),
        F.avg("time_to_submit").alias("avg_time_to_submit"), F.avg("time_to_open").alias("avg_time_to_open"), F.avg("survey_duration").alias("avg_duration"),
    )


def listed_questions(history: DataFrame) -> DataFrame:
    """``survey_id, question_id, question_text, question_type, ordinal, answers`` of every version of every survey; ordinals count from 1."""
    rows = history.select("survey_id", F.posexplode(F.from_json("survey_json", LISTED)).alias("p", "q"))
    return rows.select("survey_id", "q.question_id", "q.question_text", "q.question_type", (F.col("p") + 1).alias("ordinal"), F.col("q.answers.text").alias("answers")).where(F.col("question_id").isNotNull())


def question_ordinals(history: DataFrame) -> DataFrame:
    """``survey_id, question_id, ordinal``: the first place that any version gives a question."""
    return listed_questions(history).groupBy("survey_id", "question_id").agg(F.min("ordinal").alias("ordinal"))


def answer_times(changed: DataFrame, ordinals: DataFrame) -> DataFrame:
    """Adds ``ordinal, time_to_answer`` (seconds) to ``changed_answers``.

    A question answered once, in one moment, took the time since the answer before it, unless it
    is the survey's first: a passage through the survey begins wherever the question of ordinal
    1 is answered. The first answers of a passage without that have no time. Never across
    participants or surveys.
    """
    joined = changed.join(ordinals, ["survey_id", "question_id"], "left")
    order = ["question_index", "first_time", "question_id", "question_type"]
    own = Window.partitionBy("survey_id", "participant").orderBy(*order)
    passage = F.sum(F.when(F.col("ordinal") == 1, 1).otherwise(0)).over(own.rowsBetween(Window.unboundedPreceding, 0))
    within = Window.partitionBy("survey_id", "participant", "_passage").orderBy(*order)
    at_once = (F.col("num_answers") == 1) & (F.col("first_time") == F.col("last_time")) & (F.coalesce("ordinal", F.lit(0)) != 1)
    rows = joined.withColumn("_passage", passage).withColumn("_before", F.lag("last_time").over(within))
    began = F.when(at_once, F.col("_before")).otherwise(F.col("first_time"))
    return rows.withColumn("time_to_answer", (F.col("last_time") - began) / 1000).drop("_passage", "_before")


def separator_choices(listed: DataFrame) -> DataFrame:
    """``question_id, seps``: the choices of radio questions that hold a comma or semicolon, as ";" without a blank after it.

    ``listed``: question_id, question_type, answers, from a configuration, a history or the union of both.
    """
    rows = listed.where(F.col("question_type") == "radio_button").select("question_id", F.explode("answers").alias("c")).where(F.col("c").rlike("[,;]"))
    return rows.groupBy("question_id").agg(F.array_sort(F.collect_set(F.replace(F.replace("c", F.lit(","), F.lit(";")), F.lit("; "), F.lit(";")))).alias("seps"))


def repaired_choices(rows: DataFrame, seps: DataFrame) -> DataFrame:
    """``answer_options`` as an array and ``answer`` with ", " where a separator belonged to a choice.

    "; " and ";" both part choices. Choices that hold separators themselves (``separator_choices``)
    are found in the options of radio questions and get ", " there; then brackets at the ends go
    and the rest is split. Null options stay null; brackets alone give one empty choice.
    """
    tight = lambda c: F.replace(F.col(c), F.lit("; "), F.lit(";"))
    joined = rows.join(seps, "question_id", "left")
    comma = lambda text: F.replace(text, F.lit(";"), F.lit(", "))
    mended = F.aggregate(F.col("seps"), tight("answer_options"), lambda whole, choice: F.replace(whole, choice, comma(choice)))
    options = F.when(F.col("question_type").isin(*RADIO) & F.col("seps").isNotNull(), mended).otherwise(tight("answer_options"))
    return joined.withColumns({"answer_options": F.split(F.regexp_replace(options, r"^\[|\]$|^nan$", ""), ";"), "answer": comma(tight("answer"))}).drop("seps")


def chosen_answer(answer: Column, options: Column, kind: Column, at: Column) -> Column:
    """The text of a choice that Android stored as its place (from 0) among the options; null beyond them."""
    placed = (kind == ANDROID_RADIO) & (at > F.lit(ANDROID_PLACES_SINCE).cast("timestamp")) & answer.rlike("^[0-9]+$")
    return F.when(F.coalesce(placed, F.lit(False)), F.get(options, answer.try_cast("int"))).otherwise(answer)


def answer_rows(answers: DataFrame, seps: DataFrame) -> DataFrame:
    """Rows of answers files made like events: numbered, standard types, choices as arrays, absent answers dropped or nulled.

    ``answers``: participant, survey_id, file_time, question_id, question_type, question_text,
    answer_options, answer. Adds ``file_number`` (per participant and survey in order of time) and
    ``question_index`` (of the file's questions in order of id); repeated rows count once.
    """
    rows = answers.distinct()
    file = Window.partitionBy("participant", "survey_id").orderBy("file_time")
    within = Window.partitionBy("participant", "survey_id", "file_time").orderBy("question_id", "question_type", "question_text", "answer_options", "answer")
    rows = rows.withColumn("file_number", F.dense_rank().over(file)).withColumn("question_index", F.row_number().over(within))
    rows = repaired_choices(rows, seps).where(F.col("answer").isNull() | (F.col("answer") != "NOT_PRESENTED"))
    chosen = chosen_answer(F.col("answer"), F.col("answer_options"), F.col("question_type"), F.col("file_time"))
    return rows.withColumn("answer", F.nullif(chosen, F.lit("NO_ANSWER_SELECTED"))).withColumn("question_type", standard_question_type(F.col("question_type")))


def configured_rows(with_config: DataFrame, zone: str) -> DataFrame:
    """Rows of ``surveys.with_config`` with local wall time; rows with neither a question nor a configuration are left out."""
    kept = with_config.where(F.col("question_id").isNotNull() | F.col("config_id").isNotNull())
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.timestamp_millis("t_ms").cast("timestamp_ntz"))
    return kept.withColumn("local_time", local).withColumn("answer", F.nullif("answer", F.lit("NO_ANSWER_SELECTED")))


def header_rows(positions: DataFrame, questions: DataFrame, width: int) -> DataFrame:
    """The four rows that stand above a survey's wide table: ``survey_id, row, participant, question_1..``.

    ``positions``: survey_id, question_id, position; ``questions``: survey_id, question_id,
    question_text, question_type, answers (of several versions the greatest texts count). The
    rows are "Question Text", "Question Type", "Question Options" and "Question ID".
    """
    about = questions.groupBy("survey_id", "question_id").agg(F.max("question_text").alias("question_text"), F.max("question_type").alias("question_type"), F.max(F.concat_ws(";", "answers")).alias("options"))
    rows = positions.where(F.col("position") <= width).join(about, ["survey_id", "question_id"], "left")
    kinds = F.array(*[F.struct(F.lit(k).alias("row"), F.lit(name).alias("participant"), F.col(c).alias("v")) for k, (name, c) in enumerate([("Question Text", "question_text"), ("Question Type", "question_type"), ("Question Options", "options"), ("Question ID", "question_id")], 1)])
    spread = rows.select("survey_id", "position", F.inline(kinds))
    return spread.groupBy("survey_id", "row", "participant").agg(*[F.max(F.when(F.col("position") == i, F.col("v"))).alias(f"question_{i}") for i in range(1, width + 1)])


def audio_prompts(history: DataFrame) -> DataFrame:
    """``prompt, survey_id`` of audio surveys: the prompt that a survey's latest version begins with; of several surveys with one prompt the greatest id counts.

    ``history``: survey_id, survey_json and version (greater is later); null and empty versions
    as the latest give no prompt.
    """
    latest = history.groupBy("survey_id").agg(F.max_by("survey_json", "version").alias("j"))
    rows = latest.select("survey_id", F.get(F.from_json("j", LISTED), F.lit(0))["prompt"].alias("prompt"))
    return rows.where(F.col("prompt").isNotNull()).groupBy("prompt").agg(F.max("survey_id").alias("survey_id"))


def audio_rows(recordings: DataFrame, prompts: DataFrame, config_prompts: DataFrame) -> DataFrame:
    """Recordings' rows with ``prompt`` and ``config_id`` of their survey, both null where it isn't listed; config_prompts: prompt, config_id."""
    known = prompts.join(config_prompts, "prompt", "left")
    return recordings.join(known, recordings.survey_folder == known.survey_id, "left").drop(known.survey_id)


def questions_of_schedule(deliveries: DataFrame, questions: DataFrame) -> DataFrame:
    """A row per delivery and question of its survey; surveys without questions keep a row with a null question_id."""
    lists = questions.groupBy("config_id").agg(F.array_sort(F.collect_set("question_id")).alias("_q"))
    return deliveries.join(lists, "config_id", "left").select(*deliveries.columns, F.explode_outer("_q").alias("question_id"))
