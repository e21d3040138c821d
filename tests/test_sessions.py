from __future__ import annotations

import random

from pyspark.sql import functions as F

from tracelode.operators.sessions import sessions

GAP = 900_000


def brute(rows):
    out, by = [], {}
    for key, t in rows:
        if key is not None and t is not None:
            by.setdefault(key, []).append(t)
    for key, times in by.items():
        times.sort()
        start = last = times[0]
        n = 1
        for t in times[1:]:
            if t - last > GAP:
                out.append((key, start, last, last - start, n))
                start, n = t, 0
            last, n = t, n + 1
        out.append((key, start, last, last - start, n))
    return sorted(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "k string, t long")
    df = df.withColumn("lo", F.lit("clash")).withColumn("hi", F.lit(1)).withColumn("n", F.lit(2)).withColumn("_bucket", F.lit(3))
    return sorted(tuple(r) for r in sessions(df, ["k"], F.col("t"), GAP, **kw).collect())


def test_matches_brute_force_over_bucket_edges(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), rnd.choice([None, *[rnd.randrange(0, 90_000_000) for _ in range(20)]])) for _ in range(900)]
    rows += rows[:50]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, bucket_ms=2 * GAP + 1) == brute(rows)


def test_a_step_of_the_gap_itself_stays_and_negative_times_work(spark):
    rows = [("a", -GAP), ("a", 0), ("a", GAP), ("a", 2 * GAP + 1)]
    assert run(spark, rows) == [("a", -GAP, GAP, 2 * GAP, 3), ("a", 2 * GAP + 1, 2 * GAP + 1, 0, 1)]


def test_empty(spark):
    assert run(spark, []) == []


def test_one_hot_key_with_ties(spark):
    rows = [("a", 5)] * 300 + [("a", 5 + k * GAP) for k in range(300)]
    assert run(spark, rows) == brute(rows)
