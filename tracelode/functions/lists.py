"""Lists, samples and blends as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sorted_by(values: Column, ranks: Column) -> Column:
    """The values in the order of their ranks (ties by value), cut to the shorter of both lists; null lists give null."""
    n = F.least(F.size(values), F.size(ranks))
    pairs = F.arrays_zip(F.slice(ranks, 1, n).alias("r"), F.slice(values, 1, n).alias("v"))
    return F.when(values.isNotNull() & ranks.isNotNull(), F.transform(F.array_sort(pairs), lambda p: p["v"]))


def joined(lists: Column) -> Column:
    """One list of the members of all lists; null lists are passed over."""
    return F.flatten(F.filter(lists, lambda x: x.isNotNull()))


def blend(start: Column, end: Column, at: Column, first: Column, last: Column) -> Column:
    """Value at ``at`` on the line from (first, start) to (last, end); null where those are one instant."""
    return start + (end - start) * F.try_divide(at - first, last - first)


def fitted_step(step: Column, seconds: Column, left: Column) -> Column:
    """A displacement cut in proportion where it would take longer than what is left."""
    return F.when(seconds > left, step * F.try_divide(left, seconds)).otherwise(step)


def sample_rows(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows without replacement, the same for the same rows and seed; equal rows count apart."""
    return df.withColumn("_rank", F.xxhash64(F.lit(seed), *df.columns)).orderBy("_rank").limit(n).drop("_rank")
