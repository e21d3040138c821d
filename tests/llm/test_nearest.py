from __future__ import annotations

import random

from pyspark.sql import functions as F

from tracelode.llm.nearest import nearest_by_ticks


def brute(left, right, tolerance):
    out = set()
    for k, a in left:
        near = [(abs(t - a), t) for j, t in right if j == k and k is not None and None not in (a, t) and abs(t - a) <= tolerance]
        if near:
            out.add((k, a, min(near)[1]))
    return sorted(out)


def run(spark, left, right, tolerance, tick):
    one = spark.createDataFrame(left, "k string, a long").withColumn("_tick", F.lit("clash"))
    two = spark.createDataFrame(right, "k string, t long").withColumn("_inside", F.lit(0)).withColumn("a", F.lit(0))
    return sorted(tuple(r) for r in nearest_by_ticks(one, two, ["k"], "a", "t", tolerance, tick).collect())


def test_matches_brute_force_at_any_tick(spark):
    rnd = random.Random(7)
    pick = lambda n: [(rnd.choice(["a", "a", "a", "b", None]), rnd.choice([None, *[rnd.randrange(-3000, 9000) for _ in range(15)]])) for _ in range(n)]
    left, right = pick(400), pick(120)
    left, right = left + left[:40], right + right[:40]
    for tick in (1, 7, 100, 5000):
        assert run(spark, left, right, 150, tick) == brute(left, right, 150)


def test_ties_edges_and_empty_sides(spark):
    assert run(spark, [("a", 100)], [("a", 90), ("a", 110)], 10, 6) == [("a", 100, 90)]
    assert run(spark, [("a", 100)], [("a", 111)], 10, 6) == []
    assert run(spark, [("a", 100)], [], 10, 6) == [] and run(spark, [], [("a", 1)], 10, 6) == []
