"""Queries of study folders (as listed in ``chunk_files``), sinks, lookups and small functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.functions import lists, timebins
from tracelode.functions.geo import bounding_box
from tracelode.functions.instants import stamp_ms
from tracelode.operators import comm_logs, lookups
from tracelode.queries.communication import QUERIES as COMMUNICATION
from tracelode.queries.mobility import fixes, rounded
from tracelode.session import fresh_dir
from tracelode.sources import sinks, study_folder
from tracelode.sources.tables import load


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "chunk_files").select("file_id", F.col("file_name").alias("path"), F.col("n_bytes").alias("size"), F.col("content").alias("value"))
    return study_folder.listing(rows, F.col("path"), F.col("size"))


def study_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = study_folder.files_between(_files(spark, sf_dir), "2021-03-01 02:00:00", "2021-03-01 20:00:00")
    local = F.unix_timestamp(study_folder.file_name_local(F.col("name"), "America/New_York"))
    return rows.select("file_id", "participant", "stream", "name", "n_bytes", "file_s", local.alias("local_s"))


def study_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study_folder.folder_size(_files(spark, sf_dir))


def study_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study_folder.file_days(_files(spark, sf_dir), "America/New_York")


def study_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study_folder.read_windows(_files(spark, sf_dir), "gps", 1_614_560_400, 1_614_639_600)


def study_gps_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the gps files in each participant's window."""
    files = study_folder.in_windows(_files(spark, sf_dir).where("stream = 'gps'"), study_windows(spark, sf_dir))
    return study_folder.rows_of_files(files, "gps").select("participant", "file_name", "timestamp", "latitude", "longitude", "accuracy")


def summary_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily communication written as one CSV per participant and read back."""
    place = fresh_dir(spark, "summaries")
    found = COMMUNICATION["comm_daily_summary"](spark, sf_dir).select("year", "month", "day", "num_in_call", "num_s", "participant")
    sinks.write_by_key(found, place)
    return sinks.read_summaries(spark, place, "year int, month int, day int, num_in_call long, num_s long, participant long").drop("file_name")


def summary_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comm_logs.summary_checks(COMMUNICATION["comm_daily_summary"](spark, sf_dir))


def hourly_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes written as one CSV per participant and hour and counted from those files."""
    place = fresh_dir(spark, "hours")
    sinks.write_hourly(fixes(spark, sf_dir), place)
    rows = spark.read.schema("t long, lat double, lon double, participant string, hour string").option("header", "true").csv(place)
    return rows.groupBy("participant", "hour").agg(F.count(F.lit(1)).alias("n_rows"), F.min("t").alias("first_s"))


def time_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Civil time, texts and offsets of each event in New York."""
    zone, pattern = "America/New_York", "yyyy-MM-dd HH:mm:ss"
    rows = load(spark, sf_dir, "events").select("event_id", stamp_ms(F.col("ts")).alias("ms"))
    civil = timebins.epoch_to_civil(F.col("ms") / 1000, zone)
    rows = rows.withColumn("c", civil).withColumn("text", timebins.epoch_ms_to_text(F.col("ms"), pattern, zone))
    back = timebins.civil_to_epoch(*[F.col(f"c.{p}") for p in ("year", "month", "day", "hour", "minute", "second")], zone)
    return rows.select(
        "event_id", "text", back.alias("epoch_s"), timebins.text_to_epoch_ms(F.col("text"), pattern, zone).alias("text_ms"), timebins.reformat_stamp(F.col("text"), pattern, "dd/MM/yyyy HH:mm").alias("reformatted"),
        timebins.reformat_stamp(F.lit("no date"), pattern, "dd/MM/yyyy").alias("unreadable"), timebins.utc_offset_hours(F.col("ms") / 1000, zone).alias("offset_h"), timebins.next_day(F.to_date("text")).alias("next_day"),
    )


def list_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of an order: quantities by price, and the lists of two orders joined."""
    items = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_extendedprice"))).alias("i"))
    rows = items.select("l_orderkey", F.col("i.l_quantity").alias("q"), F.col("i.l_extendedprice").alias("p"))
    text = lambda c: F.concat_ws(",", F.transform(c, lambda x: x.cast("long").cast("string")))
    return rows.select("l_orderkey", text(lists.sorted_by(F.col("q"), F.col("p"))).alias("by_price"), text(lists.joined(F.array("q", F.lit(None).cast("array<double>"), lists.sorted_by(F.col("q"), F.col("q"))))).alias("both"))


def blended_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions a third of the way between rows and steps cut to a minute."""
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("a"), F.col("l_extendedprice").cast("double").alias("b"))
    at = lists.blend(F.col("a"), F.col("b"), F.lit(20.0), F.lit(0.0), F.lit(60.0))
    south, west, north, east = bounding_box(F.col("a"), F.col("a") * 2, 500.0)
    out = rows.select("l_orderkey", "l_linenumber", at.alias("third"), lists.fitted_step(F.col("b"), F.col("a") * 3, F.lit(60.0)).alias("step"), south.alias("south"), west.alias("west"), north.alias("north"), east.alias("east"))
    return rounded(out, 5, "third", "step", "south", "west", "north", "east")


def _spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixes(spark, sf_dir).select("participant", F.round("lat", 2).alias("lat"), F.round("lon", 2).alias("lon")).distinct()


def nearby_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visited hundredths of degrees of other participants within 1 km of each participant's."""
    spots = _spots(spark, sf_dir)
    places = spots.select(F.concat_ws("|", "participant", "lat", "lon").alias("place_id"), F.col("participant").alias("kind"), (F.col("lat") + 0.003).alias("lat"), (F.col("lon") + 0.002).alias("lon"))
    found = lookups.nearby_places(spots.select("participant", "lat", "lon", F.col("lat").alias("at_lat"), F.col("lon").alias("at_lon")), places, ["participant", "at_lat", "at_lon"])
    return rounded(found.groupBy("participant", "at_lat", "at_lon").agg(F.count(F.lit(1)).alias("n_places"), F.min("distance_m").alias("nearest_m")), 2, "nearest_m")


#: Boxes that stand for time zones in the queries below.
REGIONS = [("Atlantic/South", -60.0, -180.0, 0.0, 180.0), ("America/West", 0.0, -130.0, 60.0, -100.0), ("America/East", 0.0, -100.0, 60.0, -60.0), ("America/Mountain", 35.0, -112.0, 45.0, -103.0)]


def zones_of_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = spark.createDataFrame(REGIONS, "zone string, south double, west double, north double, east double")
    return lookups.zones_of(_spots(spark, sf_dir), regions, ["participant", "lat", "lon"])


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes along a grid of streets from each participant's first spot to the others, in steps of at most 2 km."""
    spots = _spots(spark, sf_dir)
    home = spots.groupBy("participant").agg(F.min(F.struct("lat", "lon")).alias("h"))
    trips = spots.join(home, "participant").where((F.abs(F.col("lat") - F.col("h.lat")) < 0.5) & (F.abs(F.col("lon") - F.col("h.lon")) < 0.5))
    trips = trips.select(F.concat_ws("|", "participant", "lat", "lon").alias("trip_id"), F.col("h.lat").alias("lat0"), F.col("h.lon").alias("lon0"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    return rounded(lookups.routes(trips, step_m=2000.0), 5, "lat", "lon")


QUERIES = {f.__name__: f for f in (study_files, study_sizes, study_days, study_windows, study_gps_rows, summary_sink, summary_check, hourly_sink, time_texts, list_helpers, blended_positions, nearby_places, zones_of_points, routes)}

_NAMED = """
WITH f AS (SELECT *, epoch(try_strptime(regexp_extract(file_name, '(\\d{4}-\\d{2}-\\d{2} \\d{2})_', 1), '%Y-%m-%d %H'))::BIGINT AS file_s, string_split(file_name, '/') AS parts FROM chunk_files),
 n AS (SELECT file_id, parts[1] AS who, parts[2] AS strm, parts[-1] AS name, n_bytes, content, file_s FROM f WHERE parts[1] NOT LIKE '.%' AND parts[1] <> 'registry' AND parts[-1] NOT LIKE '.%')"""
_WINDOWS = _NAMED + """,
 w AS (SELECT who, greatest(coalesce(min(file_s) FILTER (strm = 'identifiers'), min(file_s) FILTER (strm = 'gps')), 1614560400) AS start_s,
   least(max(file_s) FILTER (strm NOT IN ('survey_timings', 'survey_answers', 'audio_recordings')), 1614639600) AS end_s FROM n WHERE file_s IS NOT NULL GROUP BY who HAVING count(*) FILTER (strm = 'gps') > 0)"""
_SPOT = """, sp AS (SELECT DISTINCT participant, round(lat, 2) AS lat, round(lon, 2) AS lon FROM x)"""


def _oracle() -> dict[str, str]:
    from tracelode.queries.communication import ORACLE as comm
    from tracelode.queries.mobility import _FIX, _gc

    five = lambda *names: ", ".join(f"round({v} + 13e-8, 5) AS {n}" for n, v in names)
    dlat = "degrees(500.0 / 6371000)"
    return {
        "study_files": _NAMED + """ SELECT file_id, who AS participant, strm AS stream, name, n_bytes, file_s,
 epoch(try_strptime(replace(regexp_extract(name, '(\\d{4}-\\d{2}-\\d{2} \\d{2}_\\d{2}_\\d{2})[+]00_00', 1), '_', ':'), '%Y-%m-%d %H:%M:%S'))::BIGINT - 18000 AS local_s FROM n WHERE file_s BETWEEN 1614564000 AND 1614628800""",
        "study_sizes": _NAMED + " SELECT who AS participant, count(*) AS n_files, round(sum(n_bytes) / 1048576, 0) AS mib FROM n GROUP BY who",
        "study_days": _NAMED + """,
 d AS (SELECT who, ((file_s - 18000) // 86400)::BIGINT AS k, count(*) AS c FROM n WHERE file_s IS NOT NULL GROUP BY ALL),
 s AS (SELECT who, unnest(range(min(k), max(k) + 1)) AS k FROM d GROUP BY who)
SELECT who AS participant, DATE '1970-01-01' + k::INT AS day, coalesce(c, 0) AS n_files FROM s LEFT JOIN d USING (who, k)""",
        "study_windows": _WINDOWS + " SELECT who AS participant, start_s, end_s FROM w",
        "study_gps_rows": _WINDOWS + """,
 g AS (SELECT who, name, list_filter(string_split(replace(replace(replace(content, chr(65279), ''), chr(13), ''), '"', ''), chr(10)), lambda l: l <> '') AS ls FROM n JOIN w USING (who) WHERE strm = 'gps' AND file_s >= start_s AND file_s < end_s AND content IS NOT NULL),
 h AS (SELECT who, name, list_transform(string_split(ls[1], ','), lambda c: trim(c)) AS hd, unnest(ls[2:]) AS l FROM g WHERE len(ls) > 1),
 v AS (SELECT who, name, hd, string_split(l, ',') AS v FROM h),
 k AS (SELECT * FROM v WHERE len(v) = len(hd))
SELECT who AS participant, name AS file_name, try_cast(nullif(v[list_position(hd, 'timestamp')], '') AS BIGINT) AS timestamp, try_cast(v[list_position(hd, 'latitude')] AS DOUBLE) AS latitude,
 try_cast(v[list_position(hd, 'longitude')] AS DOUBLE) AS longitude, try_cast(v[list_position(hd, 'accuracy')] AS DOUBLE) AS accuracy FROM k""",
        "summary_sink": f"SELECT year::INT AS year, month::INT AS month, day::INT AS day, num_in_call, num_s, participant FROM ({comm['comm_daily_summary']})",
        "summary_check": f"SELECT participant, 0::BIGINT AS n_wrong, count(*) AS n_rows FROM ({comm['comm_daily_summary']}) GROUP BY participant",
        "hourly_sink": _FIX + " SELECT participant, strftime(make_timestamp(t // 3600 * 3600000000), '%Y-%m-%d %H_%M_%S') AS hour, count(*) AS n_rows, min(t) AS first_s FROM x GROUP BY ALL",
        "time_texts": """
WITH t AS (SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events),
 z AS (SELECT *, timezone('America/New_York', timezone('UTC', make_timestamp(ms // 1000 * 1000000))) AS l FROM t)
SELECT event_id, strftime(l, '%Y-%m-%d %H:%M:%S') AS text, ms // 1000 AS epoch_s, ms // 1000 * 1000 AS text_ms, strftime(l, '%d/%m/%Y %H:%M') AS reformatted, NULL::VARCHAR AS unreadable,
 (epoch(l) - ms // 1000) / 3600 AS offset_h, l::DATE + 1 AS next_day FROM z""",
        "list_helpers": """
WITH i AS (SELECT l_orderkey, list(l_quantity ORDER BY l_extendedprice, l_quantity) AS a, list(l_quantity ORDER BY l_linenumber, l_quantity, l_extendedprice) AS q, list(l_quantity ORDER BY l_quantity) AS s FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, array_to_string(list_transform(a, lambda x: x::BIGINT), ',') AS by_price, array_to_string(list_transform(list_concat(q, s), lambda x: x::BIGINT), ',') AS both FROM i""",
        "blended_positions": f"""
WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS a, l_extendedprice::DOUBLE AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, {five(("third", "(a + (b - a) * (20.0 / 60.0))"), ("step", "(CASE WHEN a * 3 > 60 THEN b * (60.0 / (a * 3)) ELSE b END)"), ("south", f"(a - {dlat})"), ("west", f"(a * 2 - {dlat} / cos(radians(a)))"), ("north", f"(a + {dlat})"), ("east", f"(a * 2 + {dlat} / cos(radians(a)))"))} FROM r""",
        "nearby_places": _FIX + _SPOT + f""",
 j AS (SELECT a.participant, a.lat AS at_lat, a.lon AS at_lon, {_gc("a.lat", "a.lon", "(b.lat + 0.003)", "(b.lon + 0.002)")} AS d FROM sp a JOIN sp b ON abs(b.lat + 0.003 - a.lat) < 0.02)
SELECT participant, at_lat, at_lon, count(*) AS n_places, round(min(d) + 13e-5, 2) AS nearest_m FROM j WHERE d <= 1000 GROUP BY ALL""",
        "zones_of_points": _FIX + _SPOT + ", rg(zone, s, w, n, e) AS (VALUES " + ", ".join(str(r) for r in REGIONS) + """),
 c AS (SELECT sp.*, zone, row_number() OVER (PARTITION BY participant, lat, lon ORDER BY (n - s) * (e - w), zone) AS r FROM sp LEFT JOIN rg ON lat BETWEEN s AND n AND lon BETWEEN w AND e)
SELECT participant, lat, lon, zone FROM c WHERE r = 1""",
        "routes": _FIX + _SPOT + f""",
 hm AS (SELECT participant, min(struct_pack(lat := lat, lon := lon)) AS h FROM sp GROUP BY participant),
 tp AS (SELECT concat_ws('|', participant, lat, lon) AS trip_id, h.lat AS lat0, h.lon AS lon0, lat AS lat1, lon AS lon1 FROM sp JOIN hm USING (participant) WHERE abs(lat - h.lat) < 0.5 AND abs(lon - h.lon) < 0.5),
 lg AS (SELECT trip_id, 0 AS leg, lat0 AS ya, lon0 AS xa, lat1 AS yb, lon0 AS xb FROM tp UNION ALL SELECT trip_id, 1, lat1, lon0, lat1, lon1 FROM tp),
 ln AS (SELECT *, greatest(ceil({_gc("ya", "xa", "yb", "xb")} / 2000), 1)::INT AS n FROM lg),
 pt AS (SELECT *, unnest(range(leg, n + 1)) AS j FROM ln)
SELECT trip_id, leg * 1000000 + j AS k, {five(("lat", "(ya + (yb - ya) * (j / n))"), ("lon", "(xa + (xb - xa) * (j / n))"))} FROM pt""",
    }


ORACLE = _oracle()
