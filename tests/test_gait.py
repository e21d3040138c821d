from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tracelode.operators import gait as G

MARKS = np.zeros((10, 10))
for _col, _rows in enumerate([(1, 4, 5, 9), (3, 6), (2, 6), (1, 6), (1, 2, 6, 9), (1, 3, 6, 9), (0, 2, 6), (1, 7), (1, 7), (6,)]):
    MARKS[list(_rows), _col] = 1


def test_lasting_peaks():
    exact = np.zeros((10, 10))
    exact[6, 1:7] = 1
    assert np.array_equal(G.lasting_peaks(MARKS, 5, 0), exact)
    path = np.zeros((10, 10))
    for col, row in enumerate([5, 6, 6, 6, 6, 6, 6, 7, 7, 6]):
        path[row, col] = 1
    assert np.array_equal(G.lasting_peaks(MARKS, 10, 1), path)
    assert np.array_equal(G.lasting_peaks(MARKS, 3, 20), MARKS)


def walk(hz, seconds, size=0.5, fs=37):
    t = np.arange(0, seconds, 1 / fs)
    return t, np.zeros_like(t), np.zeros_like(t), 1 + size * np.sin(2 * np.pi * hz * t)


def test_cadence_of_a_steady_walk():
    for hz in (1.6, 1.8, 2.0):
        _, magnitude = G.resample(*walk(hz, 20))
        found = G.cadence(magnitude)
        assert len(found) == 20 and np.abs(found[2:-2] - hz).max() <= 0.05
    assert not G.cadence(G.resample(*walk(1.8, 20, 0.05))[1]).any()


def test_resampling():
    t, x, y, z = walk(1.7, 10)
    assert np.allclose(G.resample(t, x, y, z * G.STANDARD_GRAVITY)[1], G.resample(t, x, y, z)[1])
    assert [len(G.whole_seconds(np.arange(n))) for n in (16, 17, 20, 3)] == [10, 20, 20, 0]
    assert len(G.resample(t[:1], x[:1], y[:1], z[:1])[1]) == 0


def test_table(spark):
    t, x, y, z = walk(1.8, 30)
    rows = [("a", int(1000 * i) + 1_600_000_000_000, float(p), float(q), float(r)) for i, p, q, r in zip(t, x, y, z)] + [(None, 1, 0.0, 0.0, 0.0), ("b", 5, None, 0.0, 0.0)]
    df = spark.createDataFrame(rows + rows[:20], "who string, t long, x double, y double, z double")
    seconds = G.walking_seconds(df, "who", F.col("t"))
    (day,) = G.gait_bins(seconds, 86_400).collect()
    assert day.source == "a" and 24 <= day.walking_time <= 30 and abs(day.cadence - 1.8) < 0.1
    assert G.walking_seconds(df.limit(0), "who", F.col("t")).count() == 0
