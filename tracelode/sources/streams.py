"""Domain streams presented from the generic event table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.functions.instants import stamp_ms

#: event_type -> call type, and event_type -> direction of a text; every fifth text is an MMS.
CALLS = {"click": "Incoming Call", "view": "Outgoing Call", "error": "Missed Call"}
TEXTS = {"signup": "received", "purchase": "sent"}


def _base(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("participant"), stamp_ms(F.col("ts")).alias("timestamp"), F.get_json_object("props", "$.k").alias("phone"), "event_type", "value", "event_id"
    )


def calls_of(events: DataFrame) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for pair in CALLS.items() for x in pair])
    return _base(events).where(F.col("event_type").isin(*CALLS)).select("participant", "timestamp", "phone", kinds[F.col("event_type")].alias("call_type"), F.floor("value").cast("double").alias("duration_s"))


def texts_of(events: DataFrame) -> DataFrame:
    mms = F.col("event_id") % 5 == 0
    kinds = F.create_map(*[F.lit(x) for pair in TEXTS.items() for x in pair])
    direction = F.concat(kinds[F.col("event_type")], F.when(mms, " MMS").otherwise(" SMS"))
    length = F.when(mms, "MMS").otherwise(F.floor("value").cast("string"))
    return _base(events).where(F.col("event_type").isin(*TEXTS)).select("participant", "timestamp", "phone", direction.alias("direction"), length.alias("message_length"))
