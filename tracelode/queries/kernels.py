"""Queries whose steps depend on each other in order: trajectories, places and gait."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.functions.instants import sensor_instant
from tracelode.operators import gait, gps_reports, imputation, mobility, places, simulate, trajectory
from tracelode.operators.imputation import impute
from tracelode.queries import trajectory_sql
from tracelode.queries.mobility import fixes, raw_rows, rounded
from tracelode.sources.tables import load

#: Averages of a minute suit the sampling of these pings; pauses within 50 m.
_RULE = {"interval": 60, "r": 50.0, "w": 50.0, "h": 30.0}
_SPOTS = ("lat0", "lon0", "lat1", "lon1")


def _trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory.trajectories(fixes(spark, sf_dir), **_RULE)


def _summary(df: DataFrame) -> DataFrame:
    """Rounded: to metres where many small distances are summed, as their last digits depend on the library."""
    coarse = [c for c in df.columns if c.split("_daytime")[0].split("_nighttime")[0] in ("radius", "diameter", "max_dist_home")]
    return rounded(rounded(df, 0, *coarse), 3, *[c for c in df.columns if c not in ("participant", "bin_start", *coarse)])


def flights_from_knots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trajectory.flights(fixes(spark, sf_dir), **_RULE), 6, *_SPOTS)


def mobility_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_trajectory(spark, sf_dir), 6, *_SPOTS)


def gps_daily_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(trajectory.summary(_trajectory(spark, sf_dir)))


def gps_hourly_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(trajectory.summary(_trajectory(spark, sf_dir), 3600))


def gps_daily_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published daily table, circadian columns included."""
    path = _trajectory(spark, sf_dir)
    return _published(gps_reports.report(trajectory.summary(path), True, "UTC", trajectory.routine(path)))


def gps_hourly_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _published(gps_reports.report(trajectory.summary(_trajectory(spark, sf_dir), 3600), False))


def _published(df: DataFrame) -> DataFrame:
    coarse = [c for c in df.columns if c in ("radius", "diameter", "max_dist_home")]
    return rounded(rounded(df, 3, *coarse), 5, *[c for c, kind in df.dtypes if kind == "double" and c not in coarse])


def gps_full_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From pings to the daily table: quality gate, trajectory, filled gaps, summary."""
    found = gps_reports.gps_reports(raw_rows(spark, sf_dir), fixes(spark, sf_dir), interval=60, r=50.0, w=50.0, h=30.0, least_share=0.0)
    return _published(found["daily"])


def pause_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(trajectory.pause_places(_trajectory(spark, sf_dir)), 6, "lat", "lon"), 3, "minutes")


def model_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the fitted models that a later part of the study would be carried on from."""
    return imputation.model_states(_trajectory(spark, sf_dir)).select("participant", "fit", F.size("t").alias("n_vectors"), "last_t")


def gps_day_night_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(trajectory.split_summary(_trajectory(spark, sf_dir)))


def routine_index_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trajectory.routine(_trajectory(spark, sf_dir)), 6, "routine", "routine_stratified")


def home_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trajectory.homes(_trajectory(spark, sf_dir)), 6, "lat", "lon")


def significant_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(trajectory.places(_trajectory(spark, sf_dir)), 6, "lat", "lon"), 3, "seconds")


def _seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gait.walking_seconds(load(spark, sf_dir, "accelerometer"), "participant", sensor_instant())


def walking_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seconds(spark, sf_dir)


def bout_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range of the resampled magnitude in each second of each bout, as the walking test takes it."""
    return rounded(_seconds(spark, sf_dir).select("source", "second", "pp"), 6, "pp")


def _paced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds with a cadence made from their number where the x axis moves, for tables that SQL can follow."""
    moving = bout_peak_to_peak(spark, sf_dir).select(F.col("participant").alias("source"), "second", (F.col("range_x") >= 0.3).alias("m"))
    return moving.select("source", "second", F.when(F.col("m"), 1.375 + F.col("second") % 19 * 0.0625).otherwise(0.0).alias("cadence"))


def _gait_table(width: int):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(gait.gait_report(_paced(spark, sf_dir), width, "America/New_York"), 6, "cadence")

    return query


def gait_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gait.gait_bins(_seconds(spark, sf_dir), 60)


def gait_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gait.gait_bins(_seconds(spark, sf_dir), 3600)


def gait_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gait.gait_bins(_seconds(spark, sf_dir), 86_400)


def bout_peak_to_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range of each axis within each second of raw readings."""
    rows = load(spark, sf_dir, "accelerometer").select("participant", F.floor(sensor_instant() / 1000).alias("second"), "x", "y", "z").dropna()
    ranges = [F.round(F.max(a) - F.min(a) + 13e-9, 6).alias(f"range_{a}") for a in ("x", "y", "z")]
    return rows.where("NOT isnan(x) AND NOT isnan(y) AND NOT isnan(z)").groupBy("participant", "second").agg(*ranges)


def impute_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impute(_trajectory(spark, sf_dir))


def _interest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pauses, and squares and points of interest put beside every visited place."""
    path = _trajectory(spark, sf_dir).where("status = 2")
    pauses = path.select("participant", F.xxhash64("participant", "t0").alias("pause_id"), F.col("lat0").alias("lat"), F.col("lon0").alias("lon"), (F.col("t1") - F.col("t0")).alias("seconds"), "t0")
    seen = trajectory.places(_trajectory(spark, sf_dir)).select(F.xxhash64("participant", "place").alias("place_id"), "place", "lat", "lon")
    kind = F.array(*map(F.lit, ("cafe", "park", "office", "shop")))[(F.col("place") % 4).cast("int")]
    corner = lambda a, b: F.array(F.col("lat") + a * 0.0004, F.col("lon") + b * 0.0004)
    square = F.array(corner(0, 0), corner(0, 1), corner(1, 1), corner(1, 0))
    shape = F.when(F.col("place") % 3 == 0, F.array(corner(0, 0))).otherwise(square)
    return pauses, seen.select("place_id", kind.alias("kind"), shape.alias("shape"), F.create_map(F.lit("kind"), kind).alias("tags"))


def poi_time_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    pauses, interest = _interest(spark, sf_dir)
    return rounded(places.place_times(pauses, places.place_overlaps(pauses, interest)), 2, "minutes", "minutes_adjusted")


def poi_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    pauses, interest = _interest(spark, sf_dir)
    rows = places.places_log(pauses, places.place_overlaps(pauses, interest), interest).withColumn("tags", F.to_json("tags"))
    return rows.groupBy("participant", "day", "tags").agg(F.count(F.lit(1)).alias("n_places"))


def mobility_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(mobility.mobility_trace(_trajectory(spark, sf_dir), 30), 6, "lat", "lon")


def sim_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simulated calls and texts by ``kind``; the tables of the directory aren't read."""
    calls, texts = simulate.simulate_logs(spark)
    return calls.withColumn("kind", F.lit("call")).unionByName(texts.withColumn("kind", F.lit("text")), allowMissingColumns=True)


def sim_gps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simulated pings; the tables of the directory aren't read."""
    return simulate.simulate_gps(spark)


QUERIES = {f.__name__: f for f in (flights_from_knots, mobility_infer, gps_daily_summary, gps_hourly_summary, gps_daily_report, gps_hourly_report, gps_full_report, pause_places, model_states, gps_day_night_summary, routine_index_daily, home_location, significant_places, walking_cadence, gait_minute, gait_hourly, gait_daily, bout_peak_to_peak, bout_intensity, impute_trajectory, poi_time_share, poi_log, mobility_trace, sim_logs, sim_gps)}

QUERIES |= {"gait_table_minute": _gait_table(60), "gait_table_three_hourly": _gait_table(10_800), "gait_table_daily": _gait_table(86_400)}

_USABLE = """
WITH e AS (SELECT participant AS source, coalesce("timestamp", epoch_us(try_cast(utc_time AS TIMESTAMP)) // 1000) AS ms, x, y, z FROM accelerometer),
 u AS (SELECT * FROM e WHERE source IS NOT NULL AND ms IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND NOT isnan(x) AND NOT isnan(y) AND NOT isnan(z))"""


def _gait_sql(width: int) -> str:
    unit = width if width in (60, 86_400) else 3600
    rate = "max(mean)" if unit == 86_400 else "coalesce(sum(steps) / nullif(sum(walked), 0), 0)"
    return _USABLE + f""",
 r AS (SELECT source, ms // 1000 AS second, max(x) - min(x) + 13e-9 AS d FROM u GROUP BY ALL),
 c AS (SELECT source, second - CASE WHEN second < 1615705200 THEN 18000 ELSE 14400 END AS local, CASE WHEN round(d, 6) >= 0.3 THEN 1.375 + second % 19 * 0.0625 ELSE 0.0 END AS cadence FROM r),
 i AS (SELECT source, local // {unit} AS k, count(*) FILTER (cadence > 0) AS walked, floor(sum(cadence))::BIGINT AS steps, avg(cadence) FILTER (cadence > 0) AS mean FROM c GROUP BY ALL),
 b AS (SELECT source, k * {unit} // {width} AS bin, sum(walked)::BIGINT AS walking_time, sum(steps)::BIGINT AS steps, {rate} AS cadence FROM i GROUP BY ALL),
 s AS (SELECT source, unnest(range(min(bin) * {width} // 86400 * {86_400 // width}, (max(bin) * {width} // 86400 + 1) * {86_400 // width})) AS bin FROM b GROUP BY source)
SELECT source, strftime(make_timestamp(bin * {width} * 1000000), '{"%Y-%m-%d" if width == 86_400 else "%Y-%m-%d %H:%M:%S"}') AS date, walking_time, steps, round(cadence + 13e-9, 6) AS cadence FROM s LEFT JOIN b USING (source, bin)"""


ORACLE = {
    **trajectory_sql.ORACLE,
    "gait_table_minute": _gait_sql(60),
    "gait_table_three_hourly": _gait_sql(10_800),
    "gait_table_daily": _gait_sql(86_400),
    "bout_intensity": _USABLE + """,
 d AS (SELECT *, row_number() OVER (PARTITION BY source, ms ORDER BY x, y, z) AS r FROM u),
 t AS (SELECT source, ms // 86400000 AS day, ms / 1000 AS t, x, y, z FROM d WHERE r = 1),
 g AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 1 THEN 0 ELSE 1 END AS o, lead(t) OVER w AS t2, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(z) OVER w AS z2 FROM t WINDOW w AS (PARTITION BY source, day ORDER BY t)),
 b AS (SELECT *, sum(o) OVER (PARTITION BY source, day ORDER BY t ROWS UNBOUNDED PRECEDING) AS b FROM g),
 n AS (SELECT source, day, b, min(t) AS a, max(t) AS z, ceil((max(t) - min(t)) / 0.1)::BIGINT AS n FROM b GROUP BY ALL HAVING count(*) >= 2),
 p AS (SELECT source, day, b, a, n, n // 10 * 10 + CASE WHEN n % 10 >= 7 THEN 10 ELSE 0 END AS m, unnest(range(n)) AS k FROM n),
 f AS (SELECT p.*, p.a + k * 0.1 AS ta FROM p WHERE k < m),
 j AS (SELECT f.*, (x2 - x) / (t2 - b.t) * (ta - b.t) + x AS vx, (y2 - y) / (t2 - b.t) * (ta - b.t) + y AS vy, (z2 - z) / (t2 - b.t) * (ta - b.t) + z AS vz FROM f ASOF JOIN b ON f.source = b.source AND f.day = b.day AND f.b = b.b AND f.ta >= b.t),
 q AS (SELECT *, sqrt(vx * vx + vy * vy + vz * vz) AS size FROM j),
 l AS (SELECT source, day, b, (sum(size) + (any_value(m) - count(*)) * arg_max(size, k)) / any_value(m) AS mean FROM q GROUP BY ALL),
 v AS (SELECT q.*, CASE WHEN mean > 5 THEN size / 9.80665 ELSE size END - 1 AS v FROM q JOIN l USING (source, day, b))
SELECT source, floor(min(ta))::BIGINT AS second, round(max(v) - min(v) + 13e-9, 6) AS pp FROM v GROUP BY source, day, b, k // 10""",
    "bout_peak_to_peak": """
WITH e AS (SELECT participant, coalesce("timestamp", epoch_us(try_cast(utc_time AS TIMESTAMP)) // 1000) // 1000 AS second, x, y, z FROM accelerometer)
SELECT participant, second, round(max(x) - min(x) + 13e-9, 6) AS range_x, round(max(y) - min(y) + 13e-9, 6) AS range_y, round(max(z) - min(z) + 13e-9, 6) AS range_z FROM e
WHERE participant IS NOT NULL AND second IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND NOT isnan(x) AND NOT isnan(y) AND NOT isnan(z) GROUP BY ALL""",
}
