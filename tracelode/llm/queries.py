"""Queries and SQL of the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.functions.instants import stamp_ms, survey_instant
from tracelode.llm.leakage import leaked_items, near_copies
from tracelode.llm.mojibake import garbled_documents, restored_documents
from tracelode.llm.nearest import nearest_by_ticks
from tracelode.llm.tokenizer import encode_corpus
from tracelode.sources.tables import load


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = load(spark, sf_dir, "survey_answers").select("participant", "survey_id", stamp_ms(F.col("file_time")).alias("answers_ms"))
    named = F.lower(F.regexp_replace("event", r"^[\s\u00a0]+|[\s\u00a0]+$", "")) == "submitted"
    control = F.col("event").isNull() & (F.col("question_id") == "User hit submit")
    submissions = load(spark, sf_dir, "survey_timings").where(named | control).select("participant", "survey_id", survey_instant().alias("timings_ms"))
    return nearest_by_ticks(files, submissions, ["participant", "survey_id"], "answers_ms", "timings_ms", 30 * 60_000)


def _cores(spark: SparkSession) -> int:
    """Tasks that scans of fewer splits are dealt out over."""
    return spark.sparkContext.defaultParallelism


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(load(spark, sf_dir, "documents"), least_tasks=_cores(spark))


def p9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_copies(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items"), least_tasks=_cores(spark))
    return found.withColumn("similarity", F.round(F.col("similarity") + 13e-9, 6))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items"), least_tasks=_cores(spark)).select("doc_id", "item_id")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled_documents(spark, load(spark, sf_dir, "documents")).select("doc_id").distinct()


def p10_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restored_documents(spark, load(spark, sf_dir, "documents"))


_P1 = """
WITH s AS (SELECT DISTINCT participant, survey_id, coalesce(CASE WHEN abs("timestamp") < 100000000000 THEN "timestamp" * 1000
   WHEN abs("timestamp") < 100000000000000 THEN "timestamp" WHEN abs("timestamp") < 100000000000000000 THEN "timestamp" // 1000
   ELSE "timestamp" // 1000000 END, epoch_us(utc_time) // 1000) AS t FROM survey_timings
   WHERE lower(trim(event)) = 'submitted' OR (event IS NULL AND question_id = 'User hit submit')),
 f AS (SELECT DISTINCT participant, survey_id, epoch_us(file_time) // 1000 AS a FROM survey_answers),
 j AS (SELECT f.participant, f.survey_id, a, t, row_number() OVER (PARTITION BY f.participant, f.survey_id, a ORDER BY abs(t - a), t) AS r
   FROM f JOIN s ON f.participant = s.participant AND f.survey_id = s.survey_id AND abs(t - a) <= 1800000)
SELECT participant, survey_id, a AS answers_ms, t AS timings_ms FROM j WHERE r = 1"""

_P9 = """
WITH w AS (SELECT doc_id AS id, false AS item, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ws FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT item_id, true, regexp_extract_all(lower(passage), '[\\p{L}\\p{N}]+') FROM eval_items),
 g AS (SELECT id, item, unnest(list_transform(range(1, len(ws) - 10), lambda i: array_to_string(ws[i:i+11], ' '))) AS s FROM w WHERE len(ws) >= 12)
SELECT DISTINCT d.id AS doc_id, e.id AS item_id FROM g d JOIN g e ON d.s = e.s AND NOT d.item AND e.item"""

#: Brute force over all item-sized windows of the documents that share any shingle with the item (others have similarity 0).
_NEAR = """
WITH w AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ws FROM (SELECT DISTINCT doc_id, text FROM documents) WHERE text IS NOT NULL),
 e AS (SELECT item_id, regexp_extract_all(lower(passage), '[\\p{L}\\p{N}]+') AS ps FROM eval_items),
 g AS (SELECT id, ws, unnest(range(1, len(ws) - 3)) AS p FROM w WHERE len(ws) >= 12),
 s AS (SELECT id, p, array_to_string(ws[p:p+4], ' ') AS s, len(array_to_string(ws[p:p+4], '')) AS n FROM g),
 f AS (SELECT item_id, ps, unnest(range(1, len(ps) - 3)) AS q FROM e WHERE len(ps) >= 12),
 t AS (SELECT item_id, array_to_string(ps[q:q+4], ' ') AS s, len(array_to_string(ps[q:q+4], '')) AS n, count(*) AS m FROM f GROUP BY ALL),
 z AS (SELECT item_id, sum(n * m) AS total FROM t GROUP BY item_id),
 c AS (SELECT DISTINCT id, item_id FROM s JOIN t USING (s)),
 v AS (SELECT c.id, c.item_id, len(ps) AS l, unnest(range(1, len(ws) - len(ps) + 2)) AS a FROM c JOIN w USING (id) JOIN e USING (item_id)),
 h AS (SELECT v.id, v.item_id, v.a, s.s, s.n, count(*) AS k FROM v JOIN s ON s.id = v.id AND s.p BETWEEN v.a AND v.a + v.l - 5 GROUP BY ALL),
 j AS (SELECT h.id, h.item_id, a, sum(h.n * h.k) AS mine, coalesce(sum(CASE WHEN t.m IS NOT NULL THEN least(h.k, t.m) * h.n END), 0) AS com FROM h LEFT JOIN t ON t.item_id = h.item_id AND t.s = h.s GROUP BY ALL),
 r AS (SELECT id, item_id, max(com / (mine + total - com)) AS similarity FROM j JOIN z USING (item_id) GROUP BY ALL)
SELECT id AS doc_id, item_id, round(similarity + 13e-9, 6) AS similarity FROM r WHERE similarity >= 0.8"""

QUERIES = {
    "p1_found": p1_found,
    "p8_ids": p8_ids,
    "p9_found": p9_found,
    "p9_leaks": p9_leaks,
    "p10_found": p10_found,
    "p10_restored": p10_restored,
}
ORACLE = {"p1_found": _P1, "p9_found": _P9, "p9_leaks": _NEAR}
