"""Mobility queries over the pings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.functions import geo
from tracelode.functions.instants import sensor_instant
from tracelode.functions.ordered import with_neighbour
from tracelode.operators import mobility as M
from tracelode.operators.stops import clean_fixes
from tracelode.sources.tables import load


def fixes(spark: SparkSession, sf_dir: str, limit_m: float = 51.0) -> DataFrame:
    """Distinct usable pings with a known accuracy below ``limit_m``: ``participant, t, lat, lon``."""
    rows = clean_fixes(load(spark, sf_dir, "gps")).where(F.col("accuracy") < limit_m)
    return rows.select("participant", F.floor(F.col("t") / 1000).alias("t"), "lat", "lon").distinct()


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``participant, t`` (seconds) of all rows with both, as uploaded."""
    return load(spark, sf_dir, "gps").select("participant", F.floor(sensor_instant() / 1000).alias("t")).dropna()


def _collapsed(spark, sf_dir):
    return M.collapse(fixes(spark, sf_dir))


def _pauses(spark, sf_dir):
    return M.merge_pauses(M.segments(M.collapse(fixes(spark, sf_dir), 60)))


def _clipped(spark, sf_dir):
    return M.clip_to_bins(M.segments(M.collapse(fixes(spark, sf_dir), 60)))


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    """Rounds for comparison; the nudge keeps exact halves from falling either way with the last bit."""
    return df.withColumns({n: F.round(F.col(n) + F.lit(13 * 10.0 ** -(digits + 3)), digits) for n in names})


def gps_accuracy_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.quality_gate(raw_rows(spark, sf_dir)), 6, "quality")


def gps_collapse_10s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_collapsed(spark, sf_dir).select("participant", "bin", "t", "lat", "lon"), 6, "lat", "lon")


def gps_gap_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.gap_rows(_collapsed(spark, sf_dir))


def gps_chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.chunks(_collapsed(spark, sf_dir)).select("participant", "bin", "chunk")


def lon_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "gps").where("longitude IS NOT NULL").select("participant", "timestamp", geo.wrap_longitude(F.col("longitude")).alias("lon")).distinct()
    return rounded(rows, 6, "lon")


def gc_distance_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_neighbour(_collapsed(spark, sf_dir), "participant", "day", ["bin"], ["lat", "lon"], "p").where("p IS NOT NULL")
    return rows.select("participant", "bin", F.round(geo.great_circle_m(F.col("p.lat"), F.col("p.lon"), F.col("lat"), F.col("lon")), 0).alias("step_m"))


def great_circle_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = with_neighbour(_collapsed(spark, sf_dir), "participant", "day", ["bin"], ["lat", "lon"], "p")
    rows = with_neighbour(before, "participant", "day", ["bin"], ["lat", "lon"], "q", ahead=True).where("p IS NOT NULL AND q IS NOT NULL")
    away = geo.great_circle_offset_m(*[F.col(c) for c in ("lat", "lon", "p.lat", "p.lon", "q.lat", "q.lon")])
    return rows.select("participant", "bin", F.round(away, 0).alias("offset_m"))


def pause_merge_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_pauses(spark, sf_dir), 6, "lat", "lon")


def bin_overlap_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_clipped(spark, sf_dir), 5, "lat0", "lon0", "lat1", "lon1")


def flight_pause_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = M.flight_pause_stats(_clipped(spark, sf_dir))
    return rounded(stats, 3, *[c for c in stats.columns if c not in ("participant", "bin")])


def radius_of_gyration(spark: SparkSession, sf_dir: str) -> DataFrame:
    pauses = _pauses(spark, sf_dir).withColumn("day", F.floor(F.col("t0") / 86_400).cast("long"))
    found = M.radius_of_gyration(pauses, ["participant", "day"]).drop("centre_lat", "centre_lon")
    return rounded(found, 1, "radius_m")


def place_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.place_entropy(_pauses(spark, sf_dir), ["participant"]), 5, "entropy")


def day_night_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.day_night(_clipped(spark, sf_dir))


def _trace(spark, sf_dir):
    slots = fixes(spark, sf_dir).groupBy("participant", F.floor(F.col("t") / 600).alias("slot"))
    return slots.agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


def routine_index_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.trace_agreement(_trace(spark, sf_dir), range(1, 15), 100.0, 600), 6, "agreement")


QUERIES = {f.__name__: f for f in (gps_accuracy_quality, gps_collapse_10s, gps_gap_rows, gps_chunk_ids, lon_wrap, gc_distance_steps, great_circle_offset, pause_merge_islands, bin_overlap_clip, flight_pause_stats, radius_of_gyration, place_entropy, day_night_split, routine_index_shift)}

_FIX = """
WITH g AS (SELECT participant, coalesce("timestamp", epoch_us(try_cast(replace(utc_time, 'Z', '') AS TIMESTAMP)) // 1000) AS ms, latitude AS lat, longitude AS lon, accuracy FROM gps),
 x AS (SELECT DISTINCT participant, ms // 1000 AS t, lat, ((lon + 180) % 360 + 360) % 360 - 180 AS lon FROM g WHERE participant IS NOT NULL AND ms >= 946684800000
   AND lat BETWEEN -90 AND 90 AND lon BETWEEN -360 AND 360 AND NOT (lat = 0 AND lon = 0) AND accuracy < 51)"""


def _col(interval: int) -> str:
    return (
        _FIX
        + f""",
 o AS (SELECT participant, min(t) AS origin FROM x GROUP BY participant),
 c0 AS (SELECT participant, origin, (t - origin) // {interval} AS bin, avg(lat) AS lat, avg(lon) AS lon FROM x JOIN o USING (participant) GROUP BY ALL),
 c1 AS (SELECT *, lead(bin) OVER (PARTITION BY participant ORDER BY bin) AS next_bin FROM c0),
 c AS (SELECT participant, bin, origin + (bin + 0.5) * {interval} AS t, lat, lon, next_bin, origin FROM c1 WHERE next_bin IS NOT NULL)"""
    )


def _gc(a: str, b: str, c: str, d: str) -> str:
    return f"6371000 * acos(greatest(-1, least(1, cos(radians({a})) * cos(radians({c})) * cos(radians({b}) - radians({d})) + sin(radians({a})) * sin(radians({c})))))"


def _off(y: str, x: str, a: str, b: str, c: str, d: str) -> str:
    """Distance of (y, x) from the great circle through (a, b) and (c, d)."""
    xyz = lambda p, q: (f"cos(radians({p})) * cos(radians({q}))", f"cos(radians({p})) * sin(radians({q}))", f"sin(radians({p}))")
    u, v, w = xyz(a, b), xyz(c, d), xyz(y, x)
    n = [f"(({u[i]}) * ({v[j]}) - ({u[j]}) * ({v[i]}))" for i, j in ((1, 2), (2, 0), (0, 1))]
    size = f"(sqrt({' + '.join(f'{k} * {k}' for k in n)}) + 1e-6)"
    cosine = " + ".join(f"{k} / {size} * ({m})" for k, m in zip(n, w, strict=True))
    return f"CASE WHEN abs({a} - {c}) < 1e-6 AND abs({b} - {d}) < 1e-6 THEN 0 ELSE abs(pi() / 2 - acos(greatest(-1, least(1, {cosine})))) * 6371000 END"


_SEG = _col(60) + f""",
 s0 AS (SELECT participant, bin, t AS t0, lat AS lat0, lon AS lon0, lead(t) OVER w AS t1, lead(lat) OVER w AS lat1, lead(lon) OVER w AS lon1, lead(bin) OVER w AS b FROM c WINDOW w AS (PARTITION BY participant ORDER BY bin)),
 s AS (SELECT participant, t0, lat0, lon0, t1, lat1, lon1, CASE WHEN {_gc("lat0", "lon0", "lat1", "lon1")} < 10 THEN 2 ELSE 1 END AS status FROM s0 WHERE b = bin + 1)"""
_PAUSE = _SEG + """,
 r0 AS (SELECT *, CASE WHEN status = 2 AND lag(status) OVER w = 2 AND lag(t1) OVER w = t0 THEN 0 ELSE 1 END AS o FROM s WINDOW w AS (PARTITION BY participant ORDER BY t0)),
 r AS (SELECT *, sum(o) OVER (PARTITION BY participant ORDER BY t0 ROWS UNBOUNDED PRECEDING) AS run FROM r0),
 p AS (SELECT participant, min(t0) AS t0, max(t1) AS t1, avg(lat0) AS lat, avg(lon0) AS lon, count(*) AS n_merged FROM r WHERE status = 2 GROUP BY participant, run)"""
_CLIP = _SEG + """,
 k0 AS (SELECT *, unnest(range(floor(t0 / 3600)::BIGINT, ceil(t1 / 3600)::BIGINT)) AS bin FROM s),
 k1 AS (SELECT *, greatest(t0, bin * 3600) AS a, least(t1, (bin + 1) * 3600) AS b FROM k0),
 k AS (SELECT participant, bin, status, a AS t0, lat0 + (lat1 - lat0) * (a - t0) / (t1 - t0) AS lat0, lon0 + (lon1 - lon0) * (a - t0) / (t1 - t0) AS lon0,
   b AS t1, lat0 + (lat1 - lat0) * (b - t0) / (t1 - t0) AS lat1, lon0 + (lon1 - lon0) * (b - t0) / (t1 - t0) AS lon1 FROM k1)"""

ORACLE = {
    "gps_accuracy_quality": _FIX + """,
 f AS (SELECT participant, ms // 3600000 AS f, count(*) AS n FROM g WHERE participant IS NOT NULL AND ms IS NOT NULL GROUP BY ALL)
SELECT participant, count(*) AS n_files, round(count(*) FILTER (n > 60) / (count(*) + 0.0001), 6) AS quality, count(*) FILTER (n > 60) / (count(*) + 0.0001) > 0.05 AS passes FROM f GROUP BY participant""",
    "gps_collapse_10s": _col(10) + " SELECT participant, bin, t::DOUBLE AS t, round(lat + 13e-9, 6) AS lat, round(lon + 13e-9, 6) AS lon FROM c",
    "gps_gap_rows": _col(10) + " SELECT participant, origin + (bin + 1) * 10 AS gap_start, origin + next_bin * 10 AS gap_end FROM c WHERE next_bin - bin > 1",
    "gps_chunk_ids": _col(10) + " SELECT participant, bin, coalesce(sum(CASE WHEN next_bin - bin > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY participant ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS chunk FROM c",
    "lon_wrap": """SELECT DISTINCT participant, "timestamp", round(((longitude + 180) % 360 + 360) % 360 - 180 + 13e-9, 6) AS lon FROM (SELECT DISTINCT participant, "timestamp", longitude FROM gps WHERE longitude IS NOT NULL)""",
    "gc_distance_steps": _col(10) + f", l AS (SELECT *, lag(lat) OVER w AS la, lag(lon) OVER w AS lo FROM c WINDOW w AS (PARTITION BY participant ORDER BY bin)) SELECT participant, bin, round({_gc('la', 'lo', 'lat', 'lon')}, 0) AS step_m FROM l WHERE la IS NOT NULL",
    "great_circle_offset": _col(10) + f""",
 l AS (SELECT participant, bin, lat, lon, lag(lat) OVER w AS la, lag(lon) OVER w AS lo, lead(lat) OVER w AS na, lead(lon) OVER w AS no FROM c WINDOW w AS (PARTITION BY participant ORDER BY bin))
SELECT participant, bin, round({_off("lat", "lon", "la", "lo", "na", "no")}, 0) AS offset_m FROM l WHERE la IS NOT NULL AND na IS NOT NULL""",
    "pause_merge_islands": _PAUSE + " SELECT participant, t0::DOUBLE AS t0, t1::DOUBLE AS t1, round(lat + 13e-9, 6) AS lat, round(lon + 13e-9, 6) AS lon, n_merged FROM p",
    "bin_overlap_clip": _CLIP + " SELECT participant, bin, status, t0::DOUBLE AS t0, t1::DOUBLE AS t1, round(lat0 + 13e-8, 5) AS lat0, round(lon0 + 13e-8, 5) AS lon0, round(lat1 + 13e-8, 5) AS lat1, round(lon1 + 13e-8, 5) AS lon1 FROM k",
    "flight_pause_stats": _CLIP + f""",
 m AS (SELECT participant, bin, status, round_even({_gc("lat0", "lon0", "lat1", "lon1")}, 0) AS d, (t1 - t0)::DOUBLE AS s FROM k)
SELECT participant, bin, round(coalesce(avg(d) FILTER (status=1), 0) + 13e-6, 3) AS av_flight_length, round(coalesce(stddev_pop(d) FILTER (status=1), 0) + 13e-6, 3) AS sd_flight_length,
 round(coalesce(avg(s) FILTER (status=1), 0) + 13e-6, 3) AS av_flight_duration, round(coalesce(stddev_pop(s) FILTER (status=1), 0) + 13e-6, 3) AS sd_flight_duration,
 round(coalesce(avg(s) FILTER (status=2), 0) + 13e-6, 3) AS av_pause_duration, round(coalesce(stddev_pop(s) FILTER (status=2), 0) + 13e-6, 3) AS sd_pause_duration,
 round(coalesce(sum(s) FILTER (status=1), 0) + 13e-6, 3) AS total_flight_time, round(coalesce(sum(s) FILTER (status=2), 0) + 13e-6, 3) AS total_pause_time, round(sum(d) + 13e-6, 3) AS dist_traveled, round(sum(s) + 13e-6, 3) AS obs_duration
FROM m GROUP BY participant, bin""",
    "radius_of_gyration": _PAUSE + f""",
 q AS (SELECT *, floor(t0 / 86400)::BIGINT AS day, (t1 - t0)::DOUBLE AS w FROM p),
 z AS (SELECT participant, day, sum(w * lat) / sum(w) AS cy, sum(w * lon) / sum(w) AS cx FROM q GROUP BY ALL)
SELECT participant, day, round(sum(w * {_gc("cy", "cx", "lat", "lon")}) / sum(w) + 13e-4, 1) AS radius_m FROM q JOIN z USING (participant, day) GROUP BY participant, day""",
    "place_entropy": _PAUSE + """,
 e AS (SELECT participant, floor(lat * 1000) AS cy, floor(lon * 1000) AS cx, sum(t1 - t0)::DOUBLE AS s FROM p GROUP BY ALL HAVING sum(t1 - t0) > 900),
 u AS (SELECT *, sum(s) OVER (PARTITION BY participant) AS total FROM e)
SELECT participant, count(*) AS num_sig_places, CASE WHEN count(*) = 1 THEN 0 ELSE round(-sum(s / total * ln(s / total + 0.00001)), 5) END AS entropy FROM u GROUP BY participant""",
    "day_night_split": _CLIP + """,
 d AS (SELECT participant, (t0 + t1) / 2 AS m, (t1 - t0)::DOUBLE AS s FROM k)
SELECT participant, floor(m / 86400)::BIGINT AS day, sum(s) AS obs_duration, coalesce(sum(s) FILTER (floor(m % 86400 / 3600) BETWEEN 8 AND 19), 0) AS obs_day,
 coalesce(sum(s) FILTER (NOT floor(m % 86400 / 3600) BETWEEN 8 AND 19), 0) AS obs_night FROM d GROUP BY ALL""",
    "routine_index_shift": _FIX + f""",
 t AS (SELECT participant, t // 600 AS slot, avg(lat) AS lat, avg(lon) AS lon FROM x GROUP BY ALL),
 h AS (SELECT participant, slot + shift * 144 AS slot, shift, lat AS lat1, lon AS lon1 FROM t CROSS JOIN range(1, 15) r(shift))
SELECT participant, shift::INT AS shift, count(*) AS n_common, round(avg(CASE WHEN {_gc("lat", "lon", "lat1", "lon1")} <= 100 THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM t JOIN h USING (participant, slot) GROUP BY ALL""",
}
