"""Nearest record in time by tick expansion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nearest_by_ticks(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_ms: str, right_ms: str, tolerance_ms: int, tick_ms: int = 300_000
) -> DataFrame:
    """Pair each distinct left record with the nearest right one of the same keys.

    Returns ``*keys, left_ms, right_ms``; left records without a partner at most
    ``tolerance_ms`` away give no row; of two equally near right records the earlier counts; a
    right record may serve several left ones. Null keys or times never match; repeated rows
    count once; an empty side gives an empty result; other columns are ignored.

    Every right record is exploded to the ticks that its tolerance reaches. Per key and tick
    one row is kept that answers every left time of the tick: the last right time before the
    tick, the first one after it, and the sorted distinct ones inside (at most ``tick_ms`` of
    them, whatever the number of rows). Left records then meet it in one equi-join on key and
    tick that yields one row per left record. A hot key spreads over its ticks.
    """
    keys = list(keys)
    tick = lambda c: F.floor(c / F.lit(tick_ms)).cast("long")
    lefts = left.select(*keys, F.col(left_ms).cast("long").alias("_l")).dropna().distinct()
    rights = right.select(*keys, F.col(right_ms).cast("long").alias("_r")).dropna().distinct()
    spread = rights.select(
        *keys, "_r", F.explode(F.sequence(tick(F.col("_r") - tolerance_ms), tick(F.col("_r") + tolerance_ms))).alias("_tick")
    )
    at = tick(F.col("_r"))
    kept = spread.groupBy(*keys, "_tick").agg(
        F.max(F.when(at < F.col("_tick"), F.col("_r"))).alias("_before"),
        F.min(F.when(at > F.col("_tick"), F.col("_r"))).alias("_after"),
        F.sort_array(F.collect_set(F.when(at == F.col("_tick"), F.col("_r")))).alias("_inside"),
    )
    met = lefts.withColumn("_tick", tick(F.col("_l"))).join(kept, [*keys, "_tick"], "inner")
    at_or_before = F.coalesce(F.array_max(F.filter("_inside", lambda r: r <= F.col("_l"))), F.col("_before"))
    after = F.coalesce(F.array_min(F.filter("_inside", lambda r: r > F.col("_l"))), F.col("_after"))
    met = met.withColumn("_b", at_or_before).withColumn("_a", after)
    to_b, to_a = F.col("_l") - F.col("_b"), F.col("_a") - F.col("_l")
    nearest = F.when(F.col("_a").isNull() | (to_b <= to_a), F.col("_b")).otherwise(F.col("_a"))
    return (
        met.withColumn("_n", nearest)
        .where(F.abs(F.col("_n") - F.col("_l")) <= tolerance_ms)
        .select(*keys, F.col("_l").alias(left_ms), F.col("_n").alias(right_ms))
    )
