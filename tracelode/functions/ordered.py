"""Neighbours and running totals in an order, with no group sorted as a whole but its buckets.

``outer`` names a group (a participant, a survey), ``inner`` a bucket of it (a day, a participant)
that grows along the order. Rows are sorted within (outer, inner); what crosses a bucket's edge is
handed over through the rows at its edges, a few per bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_neighbour(df: DataFrame, outer: str, inner: str, order: Sequence[str], columns: Sequence[str], name: str, ahead: bool = False) -> DataFrame:
    """Adds ``name``: ``columns`` of the row before (or ``ahead``) in the order (outer, inner, *order), null at an outer's edge.

    The first and last rows of the buckets, two each, are ordered once more by their outer alone.
    """
    step, back = (F.lead, F.lag) if ahead else (F.lag, F.lead)
    window = Window.partitionBy(outer, inner).orderBy(*order)
    here = F.struct(*columns)
    rows = df.withColumn(name, step(here).over(window)).withColumn("_open", F.col(name).isNull()).withColumn("_end", back(F.lit(1)).over(window).isNull())
    edges = rows.where("_open OR _end").withColumn(name, F.when(F.col("_open"), step(here).over(Window.partitionBy(outer).orderBy(inner, *order))).otherwise(F.col(name)))
    return rows.where("NOT _open AND NOT _end").unionByName(edges).drop("_open", "_end")


def with_running_total(df: DataFrame, outer: str, inner: str, order: Sequence[str], value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the outer's rows up to and with this one.

    Buckets are summed as they are sorted; the last row of each gives what the later ones begin with.
    """
    window = Window.partitionBy(outer, inner).orderBy(*order)
    rows = df.withColumn("_own", F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.lead(F.lit(1)).over(window).isNull()
    # Always true, but it reads every column: so both uses of the rows have one shuffle in common.
    whole = F.xxhash64(*df.columns).between(F.lit(-(1 << 63)), F.lit((1 << 63) - 1))
    before = Window.partitionBy(outer).orderBy(inner).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.withColumn("_last", last).where(F.col("_last") & whole).select(outer, inner, F.coalesce(F.sum("_own").over(before), F.lit(0)).alias("_offset"))
    return rows.join(sums, [outer, inner]).withColumn(name, F.col("_own") + F.col("_offset")).drop("_own", "_offset")
