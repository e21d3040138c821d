"""Activity sessions by merging interval state.

Every event opens the interval ``[t, t + gap]``; intervals of one key that touch or overlap
merge. Merging runs in two levels so that no key is ever gathered in one task: within
(key, time bucket) first, then only the runs that reach a bucket's edge - two per bucket at
most, whatever the number of events - are merged per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MINUTE_MS = 60_000


def merge_intervals(df: DataFrame, group: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Merge rows (lo, hi, first_ms, last_ms, n) whose closed intervals meet, within ``group``.

    ``keep`` names the columns of ``group`` that the result carries. Ties and repeats merge.
    """
    order = Window.partitionBy(*group).orderBy("lo", "hi")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    opened = F.max("hi").over(before)
    runs = df.withColumn("_new", F.when(opened.isNull() | (F.col("lo") > opened), 1).otherwise(0)).withColumn(
        "_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    return (
        runs.groupBy(*group, "_run")
        .agg(
            F.min("lo").alias("lo"),
            F.max("hi").alias("hi"),
            F.min("first_ms").alias("first_ms"),
            F.max("last_ms").alias("last_ms"),
            F.sum("n").alias("n"),
        )
        .select(*keep, "lo", "hi", "first_ms", "last_ms", "n")
    )


def sessions(
    df: DataFrame, keys: Sequence[str], instant: Column, gap_ms: int = 15 * MINUTE_MS, bucket_ms: int | None = None
) -> DataFrame:
    """Sessions of each key: ``*keys, start_ms, end_ms, duration_ms, n_events``.

    A step of more than ``gap_ms`` begins a new session, one of exactly ``gap_ms`` doesn't.
    Rows with a null key or instant don't count; repeated rows count as events; a session may
    be a single event. An empty input gives an empty result; other columns of ``df`` are
    ignored, so they may have any name.
    """
    bucket_ms = bucket_ms or max(24 * gap_ms, 6 * 60 * MINUTE_MS)
    if bucket_ms <= 2 * gap_ms:
        raise ValueError("bucket_ms must be more than twice gap_ms")
    keys = list(keys)
    events = df.select(*keys, instant.cast("long").alias("_t"))
    for name in [*keys, "_t"]:
        events = events.where(F.col(name).isNotNull())
    events = events.select(
        *keys,
        F.floor(F.col("_t") / F.lit(bucket_ms)).cast("long").alias("_bucket"),
        F.col("_t").alias("lo"),
        (F.col("_t") + F.lit(gap_ms)).alias("hi"),
        F.col("_t").alias("first_ms"),
        F.col("_t").alias("last_ms"),
        F.lit(1).cast("long").alias("n"),
    )
    local = merge_intervals(events, [*keys, "_bucket"], [*keys, "_bucket"])
    edge = F.col("_bucket") * F.lit(bucket_ms)
    reaches = (F.col("lo") < edge + F.lit(gap_ms)) | (F.col("hi") >= edge + F.lit(bucket_ms))
    columns = [*keys, "lo", "hi", "first_ms", "last_ms", "n"]
    inner = local.where(~reaches).select(*columns)
    across = merge_intervals(local.where(reaches).select(*columns), keys, keys)
    return inner.unionByName(across).select(
        *keys,
        F.col("first_ms").alias("start_ms"),
        F.col("last_ms").alias("end_ms"),
        (F.col("last_ms") - F.col("first_ms")).alias("duration_ms"),
        F.col("n").alias("n_events"),
    )
