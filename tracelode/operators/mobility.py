"""Location averages, segments and mobility statistics in built-in expressions.

Times are epoch seconds, distances metres. Fixes are reduced to one average per interval before
any ordered step, so the rows that a participant's window sorts are bounded by observed time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.functions.geo import great_circle_m
from tracelode.functions.ordered import with_neighbour, with_running_total


def quality_gate(fixes: DataFrame, rows_per_file: int = 60, least_share: float = 0.05, file_s: int = 3600) -> DataFrame:
    """Share of a participant's hourly files with more than ``rows_per_file`` rows as uploaded; ``passes`` above ``least_share``."""
    files = fixes.groupBy("participant", F.floor(F.col("t") / file_s).alias("file")).agg(F.count(F.lit(1)).alias("n"))
    share = F.count_if(F.col("n") > rows_per_file) / (F.count(F.lit(1)) + 0.0001)
    return files.groupBy("participant").agg(F.count(F.lit(1)).alias("n_files"), share.alias("quality")).withColumn("passes", F.col("quality") > least_share)


def _day(t: str = "t") -> Column:
    return F.floor(F.col(t) / 86_400).cast("long")


def collapse(fixes: DataFrame, interval: int = 10, keep_last: bool = False) -> DataFrame:
    """Mean position per interval: ``participant, day, bin, t, lat, lon, next_bin, origin``.

    Intervals are anchored at a participant's first fix; ``t`` is the middle of one. The last
    interval is left out unless ``keep_last``, but ends the gap before it. ``day`` (UTC) is the
    bucket in which this and the following steps sort; no participant is sorted as a whole.
    """
    origins = fixes.groupBy("participant").agg(F.min("t").alias("origin"))
    binned = fixes.join(origins, "participant").withColumn("bin", F.floor((F.col("t") - F.col("origin")) / interval).cast("long"))
    means = binned.groupBy("participant", "origin", "bin").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    timed = means.withColumn("t", F.col("origin") + (F.col("bin") + 0.5) * interval).withColumn("day", _day())
    ahead = with_neighbour(timed, "participant", "day", ["bin"], ["bin"], "_next", ahead=True).withColumn("next_bin", F.col("_next.bin"))
    rows = ahead if keep_last else ahead.where(F.col("next_bin").isNotNull())
    return rows.select("participant", "day", "bin", "t", "lat", "lon", "next_bin", "origin")


def gap_rows(collapsed: DataFrame, interval: int = 10) -> DataFrame:
    """``participant, gap_start, gap_end`` of each run of empty intervals."""
    return collapsed.where(F.col("next_bin") - F.col("bin") > 1).select(
        "participant", (F.col("origin") + (F.col("bin") + 1) * interval).alias("gap_start"), (F.col("origin") + F.col("next_bin") * interval).alias("gap_end")
    )


def chunks(collapsed: DataFrame) -> DataFrame:
    """Adds ``chunk``: how many gaps lie before the row."""
    gap = F.when(F.col("next_bin") - F.col("bin") > 1, 1).otherwise(0)
    total = with_running_total(collapsed.withColumn("_gap", gap), "participant", "day", ["bin"], "_gap", "_upto")
    return total.withColumn("chunk", F.col("_upto") - F.col("_gap")).drop("_gap", "_upto")


def segments(collapsed: DataFrame, pause_m: float = 10.0) -> DataFrame:
    """Steps between neighbouring intervals: ``participant, status, t0, lat0, lon0, t1, lat1, lon1`` (1 flight, 2 pause)."""
    near = with_neighbour(collapsed, "participant", "day", ["bin"], ["bin", "t", "lat", "lon"], "_n", ahead=True)
    rows = near.where(F.col("_n.bin") == F.col("bin") + 1).select(
        "participant", F.col("t").alias("t0"), F.col("lat").alias("lat0"), F.col("lon").alias("lon0"), F.col("_n.t").alias("t1"), F.col("_n.lat").alias("lat1"), F.col("_n.lon").alias("lon1")
    )
    step = great_circle_m(F.col("lat0"), F.col("lon0"), F.col("lat1"), F.col("lon1"))
    return rows.withColumn("status", F.when(step < pause_m, 2).otherwise(1))


def merge_pauses(segs: DataFrame) -> DataFrame:
    """Runs of touching pauses as one: mean start position, first start, last end."""
    rows = with_neighbour(segs.withColumn("_day", _day("t0")), "participant", "_day", ["t0"], ["status", "t1"], "_p")
    opens = F.when((F.col("status") == 2) & (F.col("_p.status") == 2) & (F.col("_p.t1") == F.col("t0")), 0).otherwise(1)
    runs = with_running_total(rows.withColumn("_o", opens), "participant", "_day", ["t0"], "_o", "_run")
    pauses = runs.where("status = 2").groupBy("participant", "_run").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.avg("lat0").alias("lat"), F.avg("lon0").alias("lon"), F.count(F.lit(1)).alias("n_merged"))
    return pauses.drop("_run")


def clip_to_bins(segs: DataFrame, width_s: int = 3600) -> DataFrame:
    """Cuts segments at bin edges, ends placed in proportion: ``participant, bin, status, t0, ..., lon1``.

    Every segment is exploded to the bins it overlaps, so no range join is needed.
    """
    spread = segs.where("t1 > t0").withColumn("bin", F.explode(F.sequence(F.floor(F.col("t0") / width_s), F.ceil(F.col("t1") / width_s) - 1)))
    low, high = F.greatest(F.col("t0"), F.col("bin") * width_s), F.least(F.col("t1"), (F.col("bin") + 1) * width_s)
    at = lambda a, b, t: F.col(a) + (F.col(b) - F.col(a)) * (t - F.col("t0")) / (F.col("t1") - F.col("t0"))
    return spread.select(
        "participant", "bin", "status", low.alias("t0"), at("lat0", "lat1", low).alias("lat0"), at("lon0", "lon1", low).alias("lon0"),
        high.alias("t1"), at("lat0", "lat1", high).alias("lat1"), at("lon0", "lon1", high).alias("lon1"),
    )


def flight_pause_stats(clipped: DataFrame) -> DataFrame:
    """Per bin: means and population deviations of flights and pauses, 0 where there are none, and totals."""
    length = F.bround(great_circle_m(F.col("lat0"), F.col("lon0"), F.col("lat1"), F.col("lon1")), 0)
    rows = clipped.withColumn("d", length).withColumn("s", F.col("t1") - F.col("t0"))
    flight, pause = F.col("status") == 1, F.col("status") == 2
    of = lambda f, cond, c: F.coalesce(f(F.when(cond, F.col(c))), F.lit(0.0))
    return rows.groupBy("participant", "bin").agg(
        of(F.avg, flight, "d").alias("av_flight_length"), of(F.stddev_pop, flight, "d").alias("sd_flight_length"),
        of(F.avg, flight, "s").alias("av_flight_duration"), of(F.stddev_pop, flight, "s").alias("sd_flight_duration"),
        of(F.avg, pause, "s").alias("av_pause_duration"), of(F.stddev_pop, pause, "s").alias("sd_pause_duration"),
        of(F.sum, flight, "s").alias("total_flight_time"), of(F.sum, pause, "s").alias("total_pause_time"),
        F.sum("d").alias("dist_traveled"), F.sum("s").alias("obs_duration"),
    )


def radius_of_gyration(pauses: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Duration-weighted centroid of pauses and mean distance from it."""
    w = F.col("t1") - F.col("t0")
    centres = pauses.groupBy(*keys).agg((F.sum(w * F.col("lat")) / F.sum(w)).alias("clat"), (F.sum(w * F.col("lon")) / F.sum(w)).alias("clon"))
    away = great_circle_m(F.col("clat"), F.col("clon"), F.col("lat"), F.col("lon"))
    return pauses.join(centres, list(keys)).groupBy(*keys).agg((F.sum(w * away) / F.sum(w)).alias("radius_m"), F.first("clat").alias("centre_lat"), F.first("clon").alias("centre_lon"))


def place_entropy(pauses: DataFrame, keys: Sequence[str], cells_per_degree: int = 1000, least_s: int = 900) -> DataFrame:
    """Significant cells (more than ``least_s`` of pauses) and the entropy of their shares, 0 for a single one."""
    cells = pauses.groupBy(*keys, F.floor(F.col("lat") * cells_per_degree).alias("cy"), F.floor(F.col("lon") * cells_per_degree).alias("cx")).agg(F.sum(F.col("t1") - F.col("t0")).alias("s")).where(F.col("s") > least_s)
    totals = cells.groupBy(*keys).agg(F.sum("s").alias("total"), F.count(F.lit(1)).alias("num_sig_places"))
    share = F.col("s") / F.col("total")
    entropy = -F.sum(share * F.log(share + 0.00001))
    return cells.join(totals, list(keys)).groupBy(*keys, "num_sig_places").agg(entropy.alias("_e")).select(*keys, "num_sig_places", F.when(F.col("num_sig_places") == 1, 0.0).otherwise(F.col("_e")).alias("entropy"))


def day_night(clipped: DataFrame, hour_from: int = 8, hour_to: int = 19) -> DataFrame:
    """Observed seconds of each UTC day by day (mid-hour 8 to 19) and night."""
    middle = (F.col("t0") + F.col("t1")) / 2
    day = F.floor(middle % 86_400 / 3600).between(hour_from, hour_to)
    s = F.col("t1") - F.col("t0")
    return clipped.groupBy("participant", F.floor(middle / 86_400).cast("long").alias("day")).agg(
        F.sum(s).alias("obs_duration"), F.sum(F.when(day, s).otherwise(0.0)).alias("obs_day"), F.sum(F.when(~day, s).otherwise(0.0)).alias("obs_night")
    )


def mobility_trace(path: DataFrame, step_s: int = 1) -> DataFrame:
    """``participant, t, lat, lon``: where a participant rests at every whole multiple of ``step_s`` from the start to before the end of its pauses; of several pauses the first counts."""
    first, last = F.ceil(F.col("t0") / step_s), F.ceil(F.col("t1") / step_s) - 1
    rows = path.where((F.col("status") == 2) & (first <= last)).select("participant", "t0", "lat0", "lon0", F.explode(F.sequence(first, last)).alias("k"))
    best = rows.groupBy("participant", "k").agg(F.min(F.struct("t0", "lat0", "lon0")).alias("b"))
    return best.select("participant", (F.col("k") * step_s).alias("t"), F.col("b.lat0").alias("lat"), F.col("b.lon0").alias("lon"))


def trace_agreement(trace: DataFrame, shifts: Sequence[int], within_m: float = 10.0, step_s: int = 10) -> DataFrame:
    """Share of a participant's instants within ``within_m`` of where it was ``shift`` days before.

    ``trace``: participant, slot (instant in steps of ``step_s``), lat, lon. An equi-join on the
    shifted slot; every shift is one copy of the slots.
    """
    per_day = 86_400 // step_s
    moved = trace.select("participant", F.explode(F.array(*[F.lit(d) for d in shifts])).alias("shift"), "slot", F.col("lat").alias("lat1"), F.col("lon").alias("lon1")).withColumn("slot", F.col("slot") + F.col("shift") * per_day)
    near = great_circle_m(F.col("lat"), F.col("lon"), F.col("lat1"), F.col("lon1")) <= within_m
    return trace.join(moved, ["participant", "slot"]).groupBy("participant", "shift").agg(F.count(F.lit(1)).alias("n_common"), F.avg(near.cast("double")).alias("agreement"))
