"""Survey streams: event repair, question and instance numbers, submissions, answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.functions.instants import survey_instant
from tracelode.functions.ordered import with_neighbour

RENDERED, SUBMIT = "Survey first rendered and displayed to user", "User hit submit"
SUBMITTED = ("submitted", SUBMIT)
ENDS = (*SUBMITTED, "notified")
#: Android names of question types and the common ones.
QUESTION_TYPES = {
    "radio_button": "Radio Button Question", "checkbox": "Checkbox Question", "slider": "Slider Question",
    "free_response": "Open Response Question", "info_text_box": "Info Text Box",
}
NO_ANSWER = ("", "[]", "NO_ANSWER_SELECTED")
ORDER = ["t_ms", "question_id", "event", "answer"]


def standard_question_type(kind: Column) -> Column:
    """Android names of question types as iOS writes them; others stay."""
    table = F.create_map(*[F.lit(x) for pair in QUESTION_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, kind), kind)


def survey_events(timings: DataFrame) -> DataFrame:
    """Distinct, repaired rows: ``participant, survey_id, t_ms, question_id, question_type, event, answer``.

    Android control rows carry their event in ``question_id``: it moves to ``event``, and the
    first other question of the survey (by participant and time, else "") takes its place. Rows
    without participant, survey or instant are left out; repeated rows count once.
    """
    control = F.col("question_id").isin(RENDERED, SUBMIT)
    named = F.trim("event")
    lower = F.lower(named)
    rows = (
        timings.select("participant", "survey_id", survey_instant().alias("t_ms"), "question_id", "question_type", "answer", F.when(control, F.col("question_id")).otherwise(F.when(lower.isin("submitted", "notified", "changed", "present", "unpresent", "expired"), lower).otherwise(named)).alias("event"))
        .where(F.col("participant").isNotNull() & F.col("survey_id").isNotNull() & F.col("t_ms").isNotNull())
        .withColumn("question_type", standard_question_type(F.col("question_type")))
        .distinct()
    )
    others = rows.where(F.col("question_id").isNotNull() & ~F.coalesce(F.col("question_id") == F.col("event"), F.lit(False)))
    first = others.groupBy("survey_id").agg(F.min(F.struct("participant", "t_ms", "question_id")).alias("f")).select("survey_id", F.col("f.question_id").alias("first_question"))
    repaired = F.when(F.col("question_id") == F.col("event"), F.coalesce("first_question", F.lit(""))).otherwise(F.col("question_id"))
    return rows.join(first, "survey_id", "left").select("participant", "survey_id", "t_ms", repaired.alias("question_id"), "question_type", "event", "answer")


def number_events(events: DataFrame, gap_ms: int = 7_200_000) -> DataFrame:
    """Adds ``question_index`` and ``instance`` to the rows of ``survey_events``.

    Both run per survey and participant. A question begins where its id differs from the row
    before, an instance after a submission or notification, where a survey's rows begin, where
    the survey was first rendered and after a step of more than ``gap_ms``. The row before is
    that in the order (survey, participant, time), so it may be another participant's; ties go
    by question, event and answer.
    """
    rows = with_neighbour(events, "survey_id", "participant", ORDER, ["question_id", "event", "t_ms"], "prev")
    changed = F.coalesce(F.col("question_id") != F.col("prev.question_id"), F.lit(True))
    opens = (
        F.col("prev").isNull()
        | F.coalesce(F.col("prev.event").isin(*ENDS), F.lit(False))
        | F.coalesce(F.col("event") == RENDERED, F.lit(False))
        | F.coalesce(F.col("t_ms") - F.col("prev.t_ms") > gap_ms, F.lit(False))
    )
    running = Window.partitionBy("survey_id", "participant").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumn("question_index", F.sum(changed.cast("long")).over(running))
        .withColumn("instance", F.sum(opens.cast("long")).over(running))
        .drop("prev")
    )


def with_config(events: DataFrame, config: DataFrame) -> DataFrame:
    """Adds ``config_id`` from ``question_id, config_id``; submit rows take the last one before them."""
    running = Window.partitionBy("survey_id", "participant").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    joined = events.join(config.select("question_id", "config_id").distinct(), "question_id", "left")
    carried = F.last("config_id", ignorenulls=True).over(running)
    submit = F.coalesce(F.col("event").isin(*SUBMITTED), F.lit(False))
    return joined.withColumn("config_id", F.when(submit, carried).otherwise(F.col("config_id"))).withColumn("submit_line", submit.cast("int"))


def submits_only(numbered: DataFrame) -> DataFrame:
    """Per instance its first and last time and the seconds between, whole days left out."""
    span = F.max("t_ms") - F.min("t_ms")
    return numbered.groupBy("survey_id", "participant", "instance").agg(
        F.min("t_ms").alias("min_time"), F.max("t_ms").alias("max_time"), F.floor(span / 1000 % 86_400).cast("long").alias("time_to_complete")
    )


def changed_answers(numbered: DataFrame) -> DataFrame:
    """One row per answered question: last answer, all answers, their number and times.

    A null first answer is left out, as is the last one if it repeats the one before.
    """
    keys = ["survey_id", "participant", "question_id", "question_type", "question_index"]
    rows = numbered.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("t_ms", "event", "answer"))).alias("r"))
    answers = F.transform("r", lambda x: x["answer"])
    rows = rows.withColumn("a", F.when(F.element_at(answers, 1).isNull(), F.slice(answers, 2, F.size("r"))).otherwise(answers))
    n = F.size("a")
    repeated = (n > 1) & (F.get("a", n - 1).eqNullSafe(F.get("a", n - 2)))
    kept = F.when(repeated, F.slice("a", 1, n - 1)).otherwise(F.col("a"))
    return rows.select(
        *keys,
        F.try_element_at(F.filter(answers, lambda x: x.isNotNull()), F.lit(-1)).alias("last_answer"),
        kept.alias("all_answers"),
        F.size(kept).cast("long").alias("num_answers"),
        F.get("r", F.lit(0))["t_ms"].alias("first_time"),
        F.element_at("r", -1)["t_ms"].alias("last_time"),
    )


def answer_summary(changed: DataFrame) -> DataFrame:
    """Per participant and question: answers, mean time and number, most common answer (ties: the least).

    ``changed``: rows of ``changed_answers`` with ``time_to_answer``.
    """
    keys = ["survey_id", "participant", "question_id", "question_type"]
    totals = changed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_answers"),
        F.avg("time_to_answer").alias("average_time_to_answer"),
        F.avg("num_answers").alias("average_number_of_answers"),
    )
    single = changed.select(*keys, F.explode("all_answers").alias("answer")).where(F.col("answer").isNotNull()).groupBy(*keys, "answer").agg(F.count(F.lit(1)).alias("n"))
    common = single.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), "answer")).alias("m")).select(*keys, F.col("m.answer").alias("most_common_answer"))
    same = [F.col(f"t.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
    return totals.alias("t").join(common.alias("c"), same, "left").select("t.*", F.coalesce("c.most_common_answer", F.lit("0")).alias("most_common_answer"))


def question_positions(config: DataFrame, events: DataFrame) -> DataFrame:
    """``survey_id, question_id, position``: each survey's questions from 1 on.

    Questions that ``config`` lists come first, those that only answers show follow, each in the
    order of their ids.
    """
    listed = config.select("survey_id", "question_id", F.lit(0).alias("_late"))
    answered = events.where(F.col("answer").isNotNull()).select("survey_id", "question_id", F.lit(1).alias("_late"))
    questions = listed.unionByName(answered).where(F.col("survey_id").isNotNull() & F.col("question_id").isNotNull()).groupBy("survey_id", "question_id").agg(F.min("_late").alias("_late"))
    return questions.select("survey_id", "question_id", F.row_number().over(Window.partitionBy("survey_id").orderBy("_late", "question_id")).alias("position"))


def responses_wide(numbered: DataFrame, positions: DataFrame, width: int) -> DataFrame:
    """One row per instance of every survey with the last answer of each of its questions as question_1 .. question_``width``.

    ``positions``: survey_id, question_id, position; columns beyond a survey's questions are null.
    """
    final = numbered.where(F.col("answer").isNotNull()).groupBy("survey_id", "participant", "instance", "question_id").agg(F.max(F.struct("t_ms", "answer")).alias("m"))
    spans = numbered.groupBy("survey_id", "participant", "instance").agg(F.min("t_ms").alias("start_time"), F.max("t_ms").alias("end_time"))
    placed = final.join(positions, ["survey_id", "question_id"])
    columns = [F.max(F.when(F.col("position") == i, F.col("m.answer"))).alias(f"question_{i}") for i in range(1, width + 1)]
    wide = placed.groupBy("survey_id", "participant", "instance").agg(F.count(F.lit(1)).alias("_n"), *columns).drop("_n")
    return spans.withColumn("survey_duration", (F.col("end_time") - F.col("start_time")) / 1000).join(wide, ["survey_id", "participant", "instance"], "left")


def without_neighbour(left: DataFrame, right: DataFrame, keys: Sequence[str], left_ms: str, right_ms: str, tolerance_ms: int) -> DataFrame:
    """Left records without any right record of the same keys at most ``tolerance_ms`` away.

    Per key and tick of the tolerance's width only the least and greatest right time matter: a
    record in the same tick is near enough, of the tick before only the last, of the tick after
    only the first. One equi-join of such ticks decides, whatever the number of rows. Left
    records with a null key or time are kept as having no neighbour.
    """
    keys = list(keys)
    tick = lambda c: F.floor(c / F.lit(tolerance_ms)).cast("long")
    edges = right.select(*keys, F.col(right_ms).alias("_r")).dropna().groupBy(*keys, tick(F.col("_r")).alias("_at")).agg(F.min("_r").alias("_lo"), F.max("_r").alias("_hi"))
    reach = edges.withColumn("_tick", F.explode(F.array(F.col("_at") - 1, F.col("_at"), F.col("_at") + 1)))
    kept = reach.groupBy(*keys, "_tick").agg(
        F.max(F.when(F.col("_at") < F.col("_tick"), F.col("_hi"))).alias("_before"),
        F.max(F.col("_at") == F.col("_tick")).alias("_same"),
        F.min(F.when(F.col("_at") > F.col("_tick"), F.col("_lo"))).alias("_after"),
    )
    t = F.col(left_ms)
    near = F.col("_same") | F.coalesce(t - F.col("_before") <= tolerance_ms, F.lit(False)) | F.coalesce(F.col("_after") - t <= tolerance_ms, F.lit(False))
    joined = left.withColumn("_tick", tick(t)).join(kept, [*keys, "_tick"], "left")
    return joined.where(~F.coalesce(near, F.lit(False))).select(*left.columns)


def next_deliveries(schedule: DataFrame, keys: Sequence[str], at: str = "delivery_time") -> DataFrame:
    """Adds ``next_delivery_time``: the next distinct delivery of the keys, a week after the last one."""
    distinct = schedule.select(*keys, at).distinct()
    window = Window.partitionBy(*keys).orderBy(at)
    return distinct.withColumn("next_delivery_time", F.coalesce(F.lead(at).over(window), F.col(at) + F.expr("INTERVAL 7 DAYS")))


def delivery_submits(deliveries: DataFrame, submissions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Whether and when each delivery was answered before the next one.

    ``deliveries``: keys, delivery_time, next_delivery_time; ``submissions``: keys, local_time,
    start_time. Submissions are sorted into the delivery they follow by one window over both, so
    a key's deliveries and submissions are never paired with each other. Durations of zero and
    of deliveries without a submission are null.
    """
    one = deliveries.select(*keys, F.col("delivery_time").alias("_t"), F.lit(0).alias("_kind"), "delivery_time", "next_delivery_time", F.lit(None).cast("timestamp_ntz").alias("start_time"))
    two = submissions.select(*keys, F.col("local_time").alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast("timestamp_ntz").alias("delivery_time"), F.lit(None).cast("timestamp_ntz").alias("next_delivery_time"), "start_time").where(F.col("_t").isNotNull())
    order = Window.partitionBy(*keys).orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = one.unionByName(two)
    both = both.withColumn("_d", F.last("delivery_time", ignorenulls=True).over(order)).withColumn("_n", F.last("next_delivery_time", ignorenulls=True).over(order))
    hit = (F.col("_kind") == 1) & (F.col("_t") < F.col("_n"))
    found = both.where(F.col("_d").isNotNull()).groupBy(*keys, "_d").agg(
        F.max(hit.cast("int")).alias("submit_flg"), F.min(F.when(hit, F.col("_t"))).alias("submit_time"), F.min(F.when(hit, F.struct("_t", "start_time"))).alias("_s")
    )
    seconds = lambda a, b: (F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / 1_000_000
    start = F.col("_s.start_time")
    return found.select(
        *keys, F.col("_d").alias("delivery_time"), "submit_flg", "submit_time", start.alias("start_time"),
        seconds(F.col("submit_time"), F.col("_d")).alias("time_to_submit"), seconds(start, F.col("_d")).alias("time_to_open"),
        F.nullif(seconds(F.col("submit_time"), start), F.lit(0.0)).alias("survey_duration"),
    )


def summarise_submits(submits: DataFrame, keys: Sequence[str], unit: str | None = None) -> DataFrame:
    """Deliveries, submissions and mean times per key, or per key and UNIT ("DAY", "HOUR") of delivery."""
    at = F.date_trunc(unit, "delivery_time") if unit else None
    clock = {} if unit is None else {"year": F.year(at), "month": F.month(at), "day": F.dayofmonth(at)} | ({"hour": F.hour(at)} if unit == "HOUR" else {})
    return submits.groupBy(*keys, *[c.alias(n) for n, c in clock.items()]).agg(
        F.countDistinct("delivery_time").alias("num_surveys"),
        F.sum("submit_flg").alias("num_complete_surveys"),
        F.avg("time_to_submit").alias("avg_time_to_submit"),
        F.avg("time_to_open").alias("avg_time_to_open"),
        F.avg("survey_duration").alias("avg_duration"),
    )
