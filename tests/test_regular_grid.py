from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from tracelode.operators.regular_grid import regular_grid


def brute(rows, gap=60_000):
    by = {}
    for who, t, x in rows:
        if who is not None and t is not None and x is not None and not math.isnan(x):
            by.setdefault(who, []).append((t, x))
    out = {}
    for who, reads in by.items():
        reads.sort()
        bouts = [[reads[0]]]
        for r in reads[1:]:
            bouts.append([r]) if r[0] - bouts[-1][-1][0] > gap else bouts[-1].append(r)
        for bout in bouts:
            for g in range(bout[0][0] // 1000, bout[-1][0] // 1000 + 1):
                inside = [r for r in bout if r[0] // 1000 == g]
                left = [r for r in bout if r[0] < g * 1000]
                right = next(r for r in bout if r[0] >= g * 1000)
                if not left:
                    v = right[1]
                else:
                    v = left[-1][1] + (right[1] - left[-1][1]) * (g * 1000 - left[-1][0]) / (right[0] - left[-1][0])
                out[who, g] = (len(inside), not inside, round(v, 6))
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "who string, t long, x double").withColumn("tick", F.lit(1)).withColumn("filled", F.lit("z"))
    return {(r.who, r.tick): (r.n_readings, r.filled, None if r.x is None else round(r.x, 6)) for r in regular_grid(df, "who", F.col("t"), ["x"], **kw).collect()}


def test_matches_brute_force_over_bucket_edges(spark):
    rnd, rows, t = random.Random(1), [], 0
    for _ in range(700):
        t += rnd.choice([40, 300, 900, 2500, 59_999, 60_000, 60_001]) if rnd.random() < 0.4 else rnd.randrange(1, 1500)
        rows.append((rnd.choice(["a", "a", "b", None]), t, rnd.choice([None, float("nan"), 1.0]) if rnd.random() < 0.1 else rnd.random()))
    rows += [("a", None, 1.0)]
    want = brute(rows)
    assert run(spark, rows) == want
    assert run(spark, rows, bucket_ticks=70) == want


def test_wide_gaps_are_marked_and_empty_input_is_empty(spark):
    rows = [("a", 0, 1.0), ("a", 10_000, 3.0)]
    got = run(spark, rows, fill_gap_ms=5000)
    assert got["a", 5] == (0, True, None) and len(got) == 11
    assert run(spark, []) == {}
