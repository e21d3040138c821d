"""Queries of the general problems (sessions, grids, compaction, stamps, stops, packed fields)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.functions.instants import sensor_instant, stamp_ms, survey_instant
from tracelode.operators.compaction import compact, manifest_files, published
from tracelode.operators.packed import packed_choices, split_values
from tracelode.operators.regular_grid import regular_grid
from tracelode.operators.sessions import sessions
from tracelode.operators.stamps import normalise_stamps
from tracelode.operators.stops import HOUR_MS, stops_and_trips
from tracelode.session import fresh_dir
from tracelode.sources.tables import load
from tracelode.streaming.live import replayed_sessions


#: Holes of the accelerometer series up to this length are filled, longer ones marked.
FILL_GAP_MS = 10_000


def p2_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(load(spark, sf_dir, "survey_timings"), ["participant", "survey_id"], survey_instant())


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_sessions(spark, sf_dir).select("participant", "survey_id", "start_ms", "end_ms")


def p2_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sessions of ``p2_sessions`` from a stream: the rows arrive in eight batches in their order in the file, late ones after their time."""
    rows = load(spark, sf_dir, "survey_timings").select("participant", "survey_id", F.timestamp_millis(survey_instant()).alias("at"), F.monotonically_increasing_id().alias("arrival"))
    return replayed_sessions(spark, rows, ["participant", "survey_id"], "at", "arrival", late="400 days")


def p3_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = regular_grid(load(spark, sf_dir, "accelerometer"), "participant", sensor_instant(), ["x", "y", "z"], fill_gap_ms=FILL_GAP_MS)
    return grid.withColumnRenamed("tick", "epoch_second")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_grid(spark, sf_dir).where("filled").select("participant", "epoch_second")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = fresh_dir(spark, "compacted")
    compact(spark, load(spark, sf_dir, "chunk_files"), target)
    return published(spark, target).select("participant", "stream", "record_ms")


def p4_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compaction into many small groups: rows, distinct records, and whether in every shard the fullest group holds at most a tenth more than the mean."""
    target = fresh_dir(spark, "balanced")
    compact(spark, load(spark, sf_dir, "chunk_files"), target, target_bytes=16 << 10)
    loads = manifest_files(spark, target).groupBy("shard").agg((F.max("load") / F.avg("load")).alias("r"))
    keys = ["participant", "stream", "record_ms"]
    rows = published(spark, target).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_records"))
    return rows.crossJoin(loads.agg((F.max("r") <= 1.1).alias("balanced")))  # one row each


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = load(spark, sf_dir, "stamp_log").select(
        F.lit("stamp_log").alias("tbl"), "record_id", F.col("raw_value").alias("raw"), F.col("device_zone").alias("zone"), "day_first"
    )
    history = load(spark, sf_dir, "survey_history").select(
        F.lit("survey_history").alias("tbl"), F.col("history_id").alias("record_id"), F.col("archive_start").alias("raw"), F.col("study_zone").alias("zone"), "day_first"
    ).distinct()  # a version may be listed twice; stamp_log ids are unique
    both = normalise_stamps(log.unionByName(history), "raw", "zone", "day_first")
    # Exploding drops the nulls without a filter, which would be pushed down and run the parsing twice.
    return both.select("tbl", "record_id", F.explode(F.array_compact(F.array("utc_ms"))).alias("utc_ms"))


def p6_stops_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stops_and_trips(load(spark, sf_dir, "gps"))
    return found.withColumn("duration_ms", F.col("end_ms") - F.col("start_ms"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    hundredths = lambda c: F.floor(F.col(c) * 100).cast("long").alias(c)
    return (
        p6_stops_trips(spark, sf_dir)
        .select("participant", "kind", F.floor(F.col("start_ms") / HOUR_MS).cast("long").alias("start_hour"), *map(hundredths, ("from_lat", "from_lon", "to_lat", "to_lon")))
        .distinct()
    )


def p7_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the state machine alone makes of each distinct packed field of radio and checkbox questions."""
    kind = F.lower(F.coalesce("question_type", F.lit("")))
    rows = load(spark, sf_dir, "survey_answers").where(kind.contains("radio") | kind.contains("checkbox"))
    texts = rows.select(F.explode(F.array("answer_options", "answer")).alias("text")).where(F.col("text").isNotNull()).distinct()
    return split_values(texts, "text", ["text"])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_choices(load(spark, sf_dir, "survey_answers"), load(spark, sf_dir, "survey_history"), stamp_ms(F.col("file_time")))


_INSTANT = """coalesce(CASE WHEN abs("timestamp") < 100000000000 THEN "timestamp" * 1000 WHEN abs("timestamp") < 100000000000000 THEN "timestamp"
 WHEN abs("timestamp") < 100000000000000000 THEN "timestamp" // 1000 ELSE "timestamp" // 1000000 END, epoch_us(utc_time) // 1000)"""

_SESSIONS = f"""
WITH e AS (SELECT participant, survey_id, {_INSTANT} AS t FROM survey_timings),
 k AS (SELECT * FROM e WHERE participant IS NOT NULL AND survey_id IS NOT NULL AND t IS NOT NULL),
 f AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 900000 THEN 0 ELSE 1 END AS opens FROM k WINDOW w AS (PARTITION BY participant, survey_id ORDER BY t)),
 g AS (SELECT *, sum(opens) OVER (PARTITION BY participant, survey_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM f)
SELECT participant, survey_id, min(t) AS start_ms, max(t) AS end_ms{{more}} FROM g GROUP BY participant, survey_id, s"""

_READINGS = """
WITH e AS (SELECT participant, coalesce("timestamp", epoch_us(try_cast(utc_time AS TIMESTAMP)) // 1000) AS t, x, y, z FROM accelerometer),
 k AS (SELECT * FROM e WHERE participant IS NOT NULL AND t IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL
   AND NOT isnan(x) AND NOT isnan(y) AND NOT isnan(z))"""

ORACLE = {
    "p2_found": _SESSIONS.format(more=""),
    "p2_sessions": _SESSIONS.format(more=", max(t) - min(t) AS duration_ms, count(*) AS n_events"),
    "p2_stream": _SESSIONS.format(more=", count(*) AS n_events"),
    "p3_found": _READINGS
    + """,
 l AS (SELECT participant, t, lead(t) OVER (PARTITION BY participant ORDER BY t) AS nxt FROM k)
SELECT participant, unnest(range(t // 1000 + 1, nxt // 1000)) AS epoch_second FROM l WHERE nxt - t <= 60000""",
}

ORACLE["p4_found"] = """
WITH f AS (SELECT participant, stream, list_filter(string_split(replace(replace(replace(content, chr(65279), ''), chr(13), ''), '"', ''), chr(10)), lambda l: trim(l) <> '') AS ls FROM chunk_files WHERE content IS NOT NULL),
 h AS (SELECT *, string_split(ls[1], ',') AS hd FROM f WHERE len(ls) > 1),
 r AS (SELECT participant, stream, hd, unnest(ls[2:]) AS l FROM h),
 v AS (SELECT participant, stream, hd, string_split(l, ',') AS v FROM r WHERE NOT contains(l, 'UTC time')),
 k AS (SELECT participant, stream, v[list_position(hd, 'timestamp')] AS ts, v[list_position(hd, 'UTC time')] AS utc FROM v WHERE len(v) = len(hd))
SELECT DISTINCT participant, stream, coalesce(try_cast(nullif(trim(ts), '') AS BIGINT), epoch_us(try_cast(utc AS TIMESTAMP)) // 1000) AS record_ms FROM k
WHERE nullif(trim(ts), '') IS NOT NULL OR try_cast(utc AS TIMESTAMP) IS NOT NULL"""

ORACLE["p4_balance"] = f"SELECT count(*) AS n_rows, count(*) AS n_records, true AS balanced FROM ({ORACLE['p4_found']})"

ORACLE["p3_grid"] = _READINGS + """,
 s AS (SELECT participant, t // 1000 AS tick, count(*) AS n, min(t) AS first_t, max(t) AS last_t, min(struct_pack(t := t, x := x, y := y, z := z)) AS f, max(struct_pack(t := t, x := x, y := y, z := z)) AS l FROM k GROUP BY ALL),
 m AS (SELECT *, lag(last_t) OVER w AS left_t, lag(tick) OVER w AS left_tick, lag(l) OVER w AS lf FROM s WINDOW w AS (PARTITION BY participant ORDER BY tick)),
 j AS (SELECT *, coalesce(first_t - left_t <= 60000, false) AS joined FROM m),
 g AS (SELECT *, unnest(range(CASE WHEN joined THEN left_tick + 1 ELSE tick END, tick + 1)) AS at_ FROM j),
 v AS (SELECT *, CASE WHEN joined AND first_t - left_t <= 10000 THEN (at_ * 1000 - left_t)::DOUBLE / (first_t - left_t)::DOUBLE END AS share FROM g)
SELECT participant, at_ AS epoch_second, CASE WHEN at_ < tick THEN 0 ELSE n END AS n_readings, at_ < tick AS filled,
 CASE WHEN NOT joined THEN f.x ELSE lf.x + (f.x - lf.x) * share END AS x, CASE WHEN NOT joined THEN f.y ELSE lf.y + (f.y - lf.y) * share END AS y,
 CASE WHEN NOT joined THEN f.z ELSE lf.z + (f.z - lf.z) * share END AS z FROM v"""

#: No choice of a question holds another one, so a choice's place in the text tells its position.
ORACLE["p7_found"] = """
WITH q AS (SELECT unnest(from_json(survey_json, '[{"question_id": "VARCHAR", "answers": [{"text": "VARCHAR"}]}]')) AS q FROM survey_history WHERE survey_json IS NOT NULL),
 c AS (SELECT DISTINCT q.question_id AS question_id, unnest(q.answers).text AS val FROM q),
 a AS (SELECT DISTINCT * FROM survey_answers WHERE contains(lower(question_type), 'radio') OR contains(lower(question_type), 'checkbox')),
 f AS (SELECT participant, survey_id, epoch_us(file_time) // 1000 AS answers_ms, question_id, 'answer_options' AS field, answer_options AS t FROM a
   UNION ALL SELECT participant, survey_id, epoch_us(file_time) // 1000, question_id, 'answer', answer FROM a),
 n AS (SELECT *, replace(replace(replace(t, '""', '"'), chr(92) || '"', '"'), chr(92) || chr(39), chr(39)) AS s FROM f WHERE t IS NOT NULL AND trim(t) NOT IN ('', 'NOT_PRESENTED', 'NO_ANSWER_SELECTED')),
 m AS (SELECT n.*, val, strpos(s, val) AS place FROM n JOIN c USING (question_id) WHERE strpos(s, val) > 0)
SELECT participant, survey_id, answers_ms, question_id, field, row_number() OVER (PARTITION BY participant, survey_id, answers_ms, question_id, field, t ORDER BY place) AS pos, val FROM m"""

_BLANK, _MARK = " \\x{a0}\\x{2002}\\x{2003}\\x{2009}\\x{200b}\\x{202f}\\x{3000}\\x{feff}", ";,|\\t\\n\\r\\x{ff1b}\\x{ff0c}\\x{3001}"
#: The state machine one character a step: st 0 between values, 1 in a quoted one, 2 in a plain one; s0 is a value's beginning, nq a quote that begins none.
ORACLE["p7_values"] = f"""
WITH RECURSIVE a AS (SELECT * FROM survey_answers WHERE contains(lower(question_type), 'radio') OR contains(lower(question_type), 'checkbox')),
 f AS (SELECT DISTINCT t FROM (SELECT answer_options AS t FROM a UNION ALL SELECT answer FROM a) WHERE t IS NOT NULL AND regexp_replace(t, '^\\s+|\\s+$', '', 'g') NOT IN ('', 'NOT_PRESENTED', 'NO_ANSWER_SELECTED')),
 m AS (
  SELECT t, 1::BIGINT AS i, 0 AS st, '' AS q, '' AS buf, 0 AS depth, 0::BIGINT AS s0, 0::BIGINT AS nq, 0::BIGINT AS pos, NULL::VARCHAR AS val FROM f
  UNION ALL
  SELECT t,
   CASE k WHEN 'lost' THEN s0 WHEN 'code' THEN i + 6 WHEN 'escape' THEN i + 2 WHEN 'twice' THEN i + 2 WHEN 'plain end' THEN i ELSE i + 1 END,
   CASE k WHEN 'open quote' THEN 1 WHEN 'begin' THEN 2 WHEN 'lost' THEN 0 WHEN 'close quote' THEN 0 WHEN 'plain end' THEN 0 ELSE st END,
   CASE k WHEN 'open quote' THEN c ELSE q END,
   CASE k WHEN 'open quote' THEN '' WHEN 'code' THEN buf || chr(('0x' || substr(t, i + 2, 4))::INT) WHEN 'escape' THEN buf || CASE nx WHEN 'n' THEN chr(10) WHEN 't' THEN chr(9) WHEN 'r' THEN chr(13) ELSE nx END WHEN 'twice' THEN buf || c WHEN 'inside' THEN buf || c ELSE buf END,
   CASE k WHEN 'in' THEN depth + 1 WHEN 'out' THEN depth - 1 ELSE depth END,
   CASE WHEN k IN ('open quote', 'begin') THEN i ELSE s0 END,
   CASE k WHEN 'lost' THEN s0 ELSE nq END,
   CASE WHEN k IN ('close quote', 'plain end') THEN pos + 1 ELSE pos END,
   CASE k WHEN 'close quote' THEN buf WHEN 'plain end' THEN regexp_replace(substr(t, s0, i - s0), '^\\s+|\\s+$', '', 'g') END
  FROM (SELECT *, CASE
    WHEN st = 0 THEN CASE WHEN regexp_full_match(c, '[{_BLANK}{_MARK}]') THEN 'pass' WHEN c IN (']', '}}', ')') AND depth > 0 THEN 'out' WHEN c IN ('"', chr(39)) AND nq <> i THEN 'open quote' WHEN c IN ('[', '(', '{{') THEN 'in' ELSE 'begin' END
    WHEN st = 1 THEN CASE WHEN i > length(t) THEN 'lost' WHEN c = chr(92) AND nx = 'u' AND regexp_full_match(substr(t, i + 2, 4), '[0-9A-Fa-f]{{4}}') THEN 'code' WHEN c = chr(92) AND nx <> '' THEN 'escape' WHEN c <> q THEN 'inside' WHEN nx = q THEN 'twice'
      WHEN regexp_matches(substr(t, i + 1), '^[{_BLANK}]*([{_MARK}\\])}}]|$)') OR regexp_matches(substr(t, i + 1), '^[{_BLANK}]+' || q) THEN 'close quote' ELSE 'inside' END
    ELSE CASE WHEN i > length(t) OR regexp_full_match(c, '[{_MARK}]') OR depth > 0 AND c IN (']', '}}', ')') THEN 'plain end' ELSE 'go on' END END AS k
   FROM (SELECT *, substr(t, i, 1) AS c, substr(t, i + 1, 1) AS nx FROM m WHERE i <= length(t) OR st <> 0)))
SELECT t AS text, pos, val FROM m WHERE val IS NOT NULL"""

QUERIES = {
    "p2_found": p2_found,
    "p2_sessions": p2_sessions,
    "p2_stream": p2_stream,
    "p3_found": p3_found,
    "p3_grid": p3_grid,
    "p4_found": p4_found,
    "p4_balance": p4_balance,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p6_stops_trips": p6_stops_trips,
    "p7_found": p7_found,
    "p7_values": p7_values,
}
