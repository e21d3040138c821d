"""Summaries of call and text logs per participant and time bin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.functions.timebins import Frequency, epoch_to_civil, local_floor

CALL_TYPES = {"in": "Incoming Call", "out": "Outgoing Call", "mis": "Missed Call"}
TEXT_TYPES = {"s": "sent SMS", "r": "received SMS", "mms_s": "sent MMS", "mms_r": "received MMS"}
CALL_COLUMNS = ["num_in_call", "num_out_call", "num_mis_call", "num_in_caller", "num_out_caller", "num_mis_caller", "total_mins_in_call", "total_mins_out_call"]
TEXT_COLUMNS = ["num_s", "num_r", "num_mms_s", "num_mms_r", "num_s_tel", "num_r_tel", "total_char_s", "total_char_r"]
JOINT_COLUMN = "num_uniq_individuals_call_or_text"
RECIPROCITY_COLUMNS = ["text_reciprocity_incoming", "text_reciprocity_outgoing"]


def _stacked(calls: DataFrame, texts: DataFrame) -> DataFrame:
    length = F.when((F.col("message_length") == "MMS") | F.col("message_length").isNull(), 0).otherwise(F.col("message_length").try_cast("double").cast("long"))
    one = calls.select("participant", "timestamp", "phone", F.col("call_type").alias("kind"), F.coalesce("duration_s", F.lit(0.0)).alias("amount"), F.lit(True).alias("is_call"))
    two = texts.select("participant", "timestamp", "phone", F.col("direction").alias("kind"), F.coalesce(length, F.lit(0)).cast("double").alias("amount"), F.lit(False).alias("is_call"))
    return one.unionByName(two).where(F.col("participant").isNotNull() & F.col("timestamp").isNotNull())


def communication_summary(calls: DataFrame, texts: DataFrame, frequency: Frequency, zone: str = "UTC") -> DataFrame:
    """One row per participant and bin, from the local day (or hour) of the first event to that of the last.

    ``calls``: participant, timestamp (ms), phone, call_type, duration_s; ``texts``: participant,
    timestamp, phone, direction, message_length (a number or "MMS"). Bins have a fixed width of
    ``frequency`` minutes; bins without events show zeros; the columns of a stream that a
    participant lacks altogether are null. Distinct phones are counted from one row per
    (participant, bin, phone), so no distinct set is gathered. Null phones count as no phone,
    null lengths and durations as 0; rows without participant or time don't count. Daily
    summaries add the texts from (to) phones that were never written to (from) in the bin.
    """
    if frequency == Frequency.HOURLY_AND_DAILY:
        raise ValueError("call once per frequency")
    daily = frequency == Frequency.DAILY
    step = int(frequency) * 60
    unit = "DAY" if daily else "HOUR"
    kinds = {**{f"call_{k}": v for k, v in CALL_TYPES.items()}, **{f"text_{k}": v for k, v in TEXT_TYPES.items()}}
    counts = [F.count_if(F.col("kind") == v).alias(f"n_{k}") for k, v in kinds.items()]
    sums = [F.sum(F.when(F.col("kind") == kinds[k], F.col("amount")).otherwise(0.0)).alias(f"sum_{k}") for k in ("call_in", "call_out", "text_s", "text_r")]
    sums += [F.max("is_call").alias("calls"), F.max(~F.col("is_call")).alias("texts")]
    slot = min(900, step)  # local hours and days begin at whole quarters of an hour in every zone, so slots fall into bins as wholes
    quarters = _stacked(calls, texts).groupBy("participant", "phone", F.floor(F.col("timestamp") / 1000 / slot).alias("quarter")).agg(*counts, *sums)
    spans = quarters.groupBy("participant").agg(
        local_floor(F.min("quarter") * slot, unit, zone).alias("first"),
        local_floor(F.max("quarter") * slot, unit, zone).alias("last"),
        F.max("calls").alias("has_calls"),
        F.max("texts").alias("has_texts"),
    )
    binned = quarters.join(spans.select("participant", "first"), "participant").withColumn("bin", F.floor((F.col("quarter") * slot - F.col("first")) / step).cast("long"))
    again = [c for c in quarters.columns if c.startswith(("n_", "sum_"))]
    by_phone = binned.groupBy("participant", "bin", "phone").agg(*[F.sum(c).alias(c) for c in again])
    n = lambda k: F.col(f"n_{k}")
    known = F.col("phone").isNotNull()
    phones = lambda cond: F.count_if(known & cond)
    per_bin = by_phone.groupBy("participant", "bin").agg(
        *[F.sum(n(f"call_{k}")).alias(f"num_{k}_call") for k in CALL_TYPES],
        *[phones(n(f"call_{k}") > 0).alias(f"num_{k}_caller") for k in CALL_TYPES],
        *[(F.sum(f"sum_call_{k}") / 60).alias(f"total_mins_{k}_call") for k in ("in", "out")],
        phones((n("call_in") + n("call_out") + n("call_mis") + n("text_s") + n("text_r")) > 0).alias(JOINT_COLUMN),
        *[F.sum(n(f"text_{k}")).alias(f"num_{k}") for k in TEXT_TYPES],
        *[phones(n(f"text_{k}") > 0).alias(f"num_{k}_tel") for k in ("s", "r")],
        *[F.sum(f"sum_text_{k}").cast("long").alias(f"total_char_{k}") for k in ("s", "r")],
        F.sum(F.when(known & (n("text_s") == 0), n("text_r")).otherwise(0)).alias(RECIPROCITY_COLUMNS[0]),
        F.sum(F.when(known & (n("text_r") == 0), n("text_s")).otherwise(0)).alias(RECIPROCITY_COLUMNS[1]),
    )
    spine = spans.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("last") - F.col("first")) / step).cast("long"))))
    joined = spine.join(per_bin, ["participant", "bin"], "left").withColumn("at", epoch_to_civil(F.col("first") + F.col("bin") * step, zone))
    shown = [c for c in [*CALL_COLUMNS, JOINT_COLUMN, *TEXT_COLUMNS, *(RECIPROCITY_COLUMNS if daily else [])]]

    def value(name: str):
        filled = F.coalesce(F.col(name), F.lit(0))
        if name in CALL_COLUMNS:
            return F.when(F.col("has_calls"), filled).alias(name)
        return (filled if name == JOINT_COLUMN else F.when(F.col("has_texts"), filled)).alias(name)

    clock = ["year", "month", "day"] + ([] if daily else ["hour"])
    return joined.select("participant", *[F.col(f"at.{c}").alias(c) for c in clock], *map(value, shown))


def text_reciprocity(texts: DataFrame, step_s: int = 86_400) -> DataFrame:
    """Texts per participant and UTC bin with phones that only wrote or were only written to."""
    rows = texts.where(F.col("participant").isNotNull() & F.col("timestamp").isNotNull() & F.col("phone").isNotNull())
    by_phone = rows.groupBy("participant", F.floor(F.col("timestamp") / 1000 / step_s).cast("long").alias("bin"), "phone").agg(
        F.count_if(F.col("direction") == TEXT_TYPES["s"]).alias("s"), F.count_if(F.col("direction") == TEXT_TYPES["r"]).alias("r")
    )
    return by_phone.groupBy("participant", "bin").agg(
        F.sum(F.when(F.col("s") == 0, F.col("r")).otherwise(0)).alias("text_reciprocity_incoming"),
        F.sum(F.when(F.col("r") == 0, F.col("s")).otherwise(0)).alias("text_reciprocity_outgoing"),
    )


def contact_union(calls: DataFrame, texts: DataFrame) -> DataFrame:
    """Distinct phones of each participant over all calls and SMS (MMS don't count)."""
    sms = texts.where(F.col("direction").isin(TEXT_TYPES["s"], TEXT_TYPES["r"])).select("participant", "phone")
    both = calls.where(F.col("call_type").isin(*CALL_TYPES.values())).select("participant", "phone").unionByName(sms)
    return both.dropna().distinct().groupBy("participant").agg(F.count(F.lit(1)).alias("n_contacts"))


def communication_summaries(calls: DataFrame, texts: DataFrame, frequency: Frequency, zone: str = "UTC") -> dict[str, DataFrame]:
    """The tables of a frequency by name; HOURLY_AND_DAILY gives both, and a participant without events has no rows in any."""
    asked = (Frequency.HOURLY, Frequency.DAILY) if frequency == Frequency.HOURLY_AND_DAILY else (frequency,)
    return {f.name.lower(): communication_summary(calls, texts, f, zone) for f in asked}


def summary_checks(summary: DataFrame) -> DataFrame:
    """Rows per participant in which a count can't be: more phones than calls or texts of a kind, or characters without texts."""
    wrong = (F.col("num_in_caller") > F.col("num_in_call")) | (F.col("num_out_caller") > F.col("num_out_call")) | (F.col("num_mis_caller") > F.col("num_mis_call"))
    wrong = wrong | (F.col("num_s_tel") > F.col("num_s")) | (F.col("num_r_tel") > F.col("num_r")) | ((F.col("total_char_s") > 0) & (F.col("num_s") == 0))
    return summary.groupBy("participant").agg(F.count_if(F.coalesce(wrong, F.lit(False))).alias("n_wrong"), F.count(F.lit(1)).alias("n_rows"))
