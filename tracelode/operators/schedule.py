"""Survey schedules and study configuration documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.operators.surveys import next_deliveries
from tracelode.session import pin

_SURVEY = (
    "content array<struct<question_id:string,question_text:string,question_type:string,text_field_type:string,answers:array<struct<text:string>>>>, survey_type string, "
    "timings array<array<bigint>>, absolute_timings array<array<bigint>>, relative_timings array<array<string>>"
)


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """``config_id`` and the fields of each survey of a configuration document, in its order."""
    schema = "surveys array<struct<" + _SURVEY.replace(" array", ":array").replace(" string,", ":string,") + ">>"
    return pin(spark).read.schema(schema).option("multiLine", "true").json(path).select(F.posexplode("surveys").alias("config_id", "s")).select("config_id", "s.*")


def questions(config: DataFrame) -> DataFrame:
    """``config_id, ordinal, question_id, question_text, question_type, text_field_type, answers``, information texts included."""
    rows = config.select("config_id", F.posexplode("content").alias("ordinal", "q"))
    return rows.select("config_id", (F.col("ordinal") + 1).alias("ordinal"), "q.question_id", "q.question_text", "q.question_type", "q.text_field_type", F.col("q.answers.text").alias("answers"))


def read_interventions(spark: SparkSession, path: str) -> DataFrame:
    """``participant, intervention, day`` of ``{participant: {survey: {name: date}}}``; of several surveys the last in order counts."""
    text = pin(spark).read.text(path, wholetext=True)
    users = text.select(F.explode(F.from_json("value", "map<string,map<string,map<string,string>>>")).alias("participant", "by"))
    rows = users.select("participant", F.explode("by").alias("survey", "m")).select("participant", "survey", F.explode("m").alias("intervention", "day"))
    return rows.groupBy("participant", "intervention").agg(F.max_by("day", "survey").alias("day"))


def delivery_times(config: DataFrame, people: DataFrame, start: str, end: str, interventions: DataFrame | None = None) -> DataFrame:
    """``participant, config_id, delivery_time, next_delivery_time`` strictly between ``start`` and ``end``.

    Weekly timings hold the seconds of the day of each weekday from Sunday on, for every week
    begun between start and end; absolute ones year, month, day and second; relative ones an
    intervention's name, days after it and second, for participants that have it. The next
    delivery of the last one is a week later.
    """
    first, last = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    weeks = F.ceil(F.datediff(F.lit(end).cast("date"), F.lit(start).cast("date")) / 7)
    monday = F.date_add(F.lit(start).cast("date"), -F.weekday(F.lit(start).cast("date")))
    at = lambda day, seconds: F.timestamp_seconds(F.unix_timestamp(day.cast("timestamp")) + seconds).cast("timestamp_ntz")
    weekly = config.select("config_id", F.posexplode("timings").alias("slot", "times")).select("config_id", ((F.col("slot") + 6) % 7).alias("weekday"), F.explode("times").alias("s"))
    weekly = weekly.withColumn("week", F.explode(F.sequence(F.lit(0), F.greatest(weeks.cast("int") - 1, F.lit(0))))).where(weeks > 0)
    weekly = weekly.select("config_id", at(F.date_add(monday, (F.col("week") * 7 + F.col("weekday")).cast("int")), F.col("s")).alias("delivery_time"))
    part = lambda k: F.get(F.col("a"), F.lit(k))
    absolute = config.select("config_id", F.explode("absolute_timings").alias("a")).select("config_id", at(F.make_date(part(0).cast("int"), part(1).cast("int"), part(2).cast("int")), part(3)).alias("delivery_time"))
    timetable = weekly.unionByName(absolute).groupBy(F.lit(1).alias("_study")).agg(F.collect_list(F.struct("config_id", "delivery_time")).alias("_t"))  # bounded by the study's weeks
    common = people.select("participant", F.lit(1).alias("_study")).join(timetable, "_study").select("participant", F.inline("_t"))  # every participant gets the study's timetable
    if interventions is not None:
        relative = config.select("config_id", F.explode("relative_timings").alias("a")).select("config_id", part(0).alias("intervention"), part(1).cast("int").alias("days"), part(2).cast("long").alias("s"))
        timed = interventions.where(F.col("day").isNotNull()).join(relative, "intervention").join(people.select("participant"), "participant", "left_semi")
        common = common.unionByName(timed.select("participant", "config_id", at(F.date_add(F.to_date("day"), F.col("days")), F.col("s")).alias("delivery_time")))
    return next_deliveries(common, ["participant", "config_id"]).where((F.col("delivery_time") > first) & (F.col("delivery_time") < last))
