"""Irregular readings onto a regular grid by a sorted as-of merge with both neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def regular_grid(
    df: DataFrame,
    source: str,
    instant: Column,
    axes: Sequence[str],
    step_ms: int = 1000,
    bout_gap_ms: int = 60_000,
    fill_gap_ms: int | None = None,
    bucket_ticks: int = 3600,
) -> DataFrame:
    """One row for each whole tick of ``step_ms`` of each bout.

    Returns ``source, tick, n_readings, filled, *axes``. A bout is a maximal run of usable
    readings of a source with steps of at most ``bout_gap_ms``; usable means that source,
    instant and all axes are neither null nor NaN. The grid runs from the tick of a bout's
    first reading to that of its last. The value at a grid instant is interpolated by time
    between the last reading before it and the first one from it on; it is null (marked) where
    these are more than ``fill_gap_ms`` apart (default: ``bout_gap_ms``). The first tick of a
    bout takes the first reading. Of readings with one instant the least values are the first,
    the greatest the last. ``filled`` tells the ticks in which no reading lies.

    Readings are reduced to one row per (source, tick) before any sort. Then grid and readings
    are merged within (source, bucket of ``bucket_ticks``); the last ticks of a bucket are
    copied to the next one, as far as a bout can reach across, so no source is gathered in one
    task. Empty input gives an empty result; extra columns are ignored.
    """
    halo = bout_gap_ms // step_ms + 1
    if bucket_ticks <= halo:
        raise ValueError("bucket_ticks must exceed the reach of a bout's gap")
    limit = bout_gap_ms if fill_gap_ms is None else fill_gap_ms
    usable = df.select(F.col(source).alias("_source"), instant.cast("long").alias("_t"), *[F.col(a).cast("double").alias(a) for a in axes])
    usable = usable.where(F.col("_source").isNotNull() & F.col("_t").isNotNull())
    for axis in axes:
        usable = usable.where(F.col(axis).isNotNull() & ~F.isnan(axis))
    values = [F.col(a) for a in axes]
    ticks = (
        usable.groupBy("_source", F.floor(F.col("_t") / F.lit(step_ms)).cast("long").alias("_tick"))
        .agg(
            F.count(F.lit(1)).alias("n_readings"),
            F.min("_t").alias("_first_t"),
            F.max("_t").alias("_last_t"),
            F.min(F.struct("_t", *values)).alias("_first"),
            F.max(F.struct("_t", *values)).alias("_last"),
        )
        .withColumn("_bucket", F.floor(F.col("_tick") / F.lit(bucket_ticks)).cast("long"))
    )
    near_end = F.col("_tick") >= (F.col("_bucket") + 1) * bucket_ticks - halo
    spread = ticks.withColumn("_own", F.col("_bucket")).withColumn(
        "_bucket", F.explode(F.when(near_end, F.array("_bucket", F.col("_bucket") + 1)).otherwise(F.array("_bucket")))
    )
    order = Window.partitionBy("_source", "_bucket").orderBy("_tick")
    merged = (
        spread.withColumn("_left_t", F.lag("_last_t").over(order))
        .withColumn("_left_tick", F.lag("_tick").over(order))
        .withColumn("_left", F.lag("_last").over(order))
        .where(F.col("_own") == F.col("_bucket"))
        .withColumn("_joined", F.coalesce(F.col("_first_t") - F.col("_left_t") <= bout_gap_ms, F.lit(False)))
        .withColumn("tick", F.explode(F.sequence(F.when(F.col("_joined"), F.col("_left_tick") + 1).otherwise(F.col("_tick")), F.col("_tick"))))
    )
    span = F.col("_first_t") - F.col("_left_t")
    share = F.try_divide((F.col("tick") * step_ms - F.col("_left_t")).cast("double"), span.cast("double"))
    filled = F.col("tick") < F.col("_tick")

    def value(axis: str) -> Column:
        left, right = F.col(f"_left.{axis}"), F.col(f"_first.{axis}")
        return F.when(~F.col("_joined"), right).when(span <= limit, left + (right - left) * share)

    return merged.select(
        F.col("_source").alias(source),
        "tick",
        F.when(filled, F.lit(0).cast("long")).otherwise(F.col("n_readings")).alias("n_readings"),
        filled.alias("filled"),
        *[value(a).alias(a) for a in axes],
    )
