"""From pings to the tables that a study is handed: gate, trajectory, filling, summary, units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.functions.timebins import Frequency, epoch_to_civil
from tracelode.operators.imputation import Kernel, impute
from tracelode.operators.mobility import quality_gate
from tracelode.operators.trajectory import routine, summary, trajectories

#: Statistic -> unit by which it is divided; lengths in km, times in hours or minutes.
_LENGTHS = ("dist_traveled", "max_dist_home", "radius", "diameter", "av_flight_length", "sd_flight_length")
_TIMES = ("obs_duration", "obs_day", "obs_night", "home_time", "total_flight_time", "av_flight_duration", "sd_flight_duration", "total_pause_time", "av_pause_duration", "sd_pause_duration")
DAILY_COLUMNS = ("obs_duration", "obs_day", "obs_night", "home_time", "dist_traveled", "max_dist_home", "radius", "diameter", "num_sig_places", "entropy", "total_flight_time", "av_flight_length", "sd_flight_length", "av_flight_duration", "sd_flight_duration", "total_pause_time", "av_pause_duration", "sd_pause_duration")
HOURLY_COLUMNS = ("obs_duration", "home_time", "dist_traveled", "max_dist_home", "total_flight_time", "av_flight_length", "sd_flight_length", "av_flight_duration", "sd_flight_duration", "total_pause_time", "av_pause_duration", "sd_pause_duration")


def report(summarised: DataFrame, daily: bool, zone: str = "UTC", rhythm: DataFrame | None = None) -> DataFrame:
    """``trajectory.summary`` with civil columns and the units of the published tables.

    Daily: year, month, day, hours and km. Hourly: also hour, minutes and km, flight lengths in
    metres. Bins without observed time hold nulls but for the observed durations. ``rhythm``
    (``trajectory.routine``) adds ``physical_circadian_rhythm`` and its stratified form by day.
    """
    names = DAILY_COLUMNS if daily else HOURLY_COLUMNS
    seen = F.col("obs_duration") > 0

    def value(name: str) -> Column:
        kept = F.col(name)
        if name in _TIMES:
            kept = kept / (3600 if daily else 60)
        elif name in _LENGTHS and (daily or not name.endswith("flight_length")):
            kept = kept / 1000
        return (kept if name.startswith("obs_") else F.when(seen, kept)).alias(name)

    rows = summarised
    extra = []
    if rhythm is not None:
        rows = rows.join(rhythm, ["participant", "bin_start"], "left")
        extra = [F.col("routine").alias("physical_circadian_rhythm"), F.col("routine_stratified").alias("physical_circadian_rhythm_stratified")]
    rows = rows.withColumn("_at", epoch_to_civil(F.col("bin_start"), zone))
    clock = ["year", "month", "day"] + ([] if daily else ["hour"])
    return rows.select("participant", *[F.col(f"_at.{c}").alias(c) for c in clock], *map(value, names), *extra)


def asserted_positions(trajectory: DataFrame) -> DataFrame:
    """The trajectory; a position off the globe is an error, as it can only come of a fault."""
    lats, lons = [F.col(c).between(-90, 90) for c in ("lat0", "lat1")], [F.col(c).between(-180.0001, 180.0001) for c in ("lon0", "lon1")]
    fine = lats[0] & lats[1] & lons[0] & lons[1]
    return trajectory.withColumn("status", F.when(fine, F.col("status")).otherwise(F.raise_error(F.concat(F.lit("position off the globe: "), "participant")).cast("int")))


def gated(fixes: DataFrame, raw: DataFrame, least_share: float = 0.05) -> DataFrame:
    """The fixes of participants whose ``raw`` rows (participant, t) pass the quality gate."""
    return fixes.join(quality_gate(raw, least_share=least_share).where("passes").select("participant"), "participant", "left_semi")


def gps_reports(
    raw: DataFrame, fixes: DataFrame, frequencies: tuple[Frequency, ...] = (Frequency.DAILY,), zone: str = "UTC", interval: int = 10, r: float = 10.0, w: float = 20.0, h: float = 10.0,
    least_share: float = 0.05, kernel: Kernel = Kernel(), with_rhythm: bool = False,
) -> dict[str, DataFrame]:
    """The whole way from pings to reports: ``trajectory`` and one table per frequency ("daily", "hourly").

    ``raw``: participant, t (seconds) of all rows as uploaded, for the gate; ``fixes``:
    participant, t, lat, lon of the accurate ones. Participants below the gate or without a home
    have no rows. The trajectory is computed once per table that is asked for: write it first
    where several are.
    """
    path = asserted_positions(impute(trajectories(gated(fixes, raw, least_share), interval, r, w, h), zone, kernel))
    out = {"trajectory": path}
    for frequency in frequencies:
        daily = frequency == Frequency.DAILY
        rhythm = routine(path, zone) if daily and with_rhythm else None
        out["daily" if daily else "hourly" if frequency == Frequency.HOURLY else f"{int(frequency)}_minutes"] = report(summary(path, int(frequency) * 60, zone), daily, zone, rhythm)
    return out
