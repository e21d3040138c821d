from __future__ import annotations

import random

import numpy as np

from tracelode.operators.stops import HOUR_MS, METRES_PER_DEGREE, StopRule, shared_spots, stops_and_trips

BASE = 1_614_600_000_000 - 1_614_600_000_000 % HOUR_MS
M = 1 / 111_195


def journey(seed=0, night=False):
    """Two stops an hour apart on foot, with jitter, strays and poor fixes; the second one spans midnight if ``night``."""
    rnd = random.Random(seed)
    rows, t = [], BASE + (20 * HOUR_MS if night else 0)

    def ping(north, east, accuracy=8.0):
        nonlocal t
        t += rnd.randrange(30_000, 60_000)
        rows.append(["p", t, None, 45 + (north + rnd.gauss(0, 7)) * M, 7 + (east + rnd.gauss(0, 7)) * M * 1.414, 1.0, accuracy])

    for k in range(60):
        ping(0, 0)
        if k % 15 == 7:
            ping(2500, 900)
        if k % 20 == 9:
            ping(900, 900, 1500.0)
    for k in range(1, 40):
        ping(50 * k, 0)
    for _ in range(300):
        ping(2000, 0)
    return rows


def run(spark, rows, rule=StopRule()):
    df = spark.createDataFrame(rows, "participant string, timestamp long, utc_time string, latitude double, longitude double, altitude double, accuracy double")
    return sorted((tuple(r) for r in stops_and_trips(df, rule).collect()), key=lambda r: (r[0], r[2], r[1]))


def test_stops_and_the_trip_between(spark):
    rows = journey()
    found = run(spark, rows)
    assert [r[1] for r in found] == ["stop", "trip", "stop"]
    first, trip, second = found
    assert abs(first[6] - 45) < 10 * M and abs(second[6] - 45 - 2000 * M) < 10 * M
    assert first[2] == rows[0][1] and second[3] == rows[-1][1] and trip[2] == first[3] and trip[3] == second[2]
    assert 1900 < trip[5] < 2600


def test_days_and_repeats_change_nothing(spark):
    rows = journey(1, night=True)
    whole = run(spark, rows, StopRule(bucket_ms=1000 * HOUR_MS))
    cut = run(spark, rows + rows[::3], StopRule(bucket_ms=HOUR_MS))
    assert [(r[1], r[2], r[3]) for r in whole] == [(r[1], r[2], r[3]) for r in cut] and len(cut) == 3
    assert all(abs(a[6] - b[6]) < 5 * M for a, b in zip(whole, cut))


def test_silences(spark):
    quiet = lambda h: [["p", BASE + k * 60_000, None, 45.0, 7.0, 0.0, None] for k in range(12)] + [["p", BASE + 11 * 60_000 + h * HOUR_MS + k * 60_000, None, 45.0, 7.0, 0.0, None] for k in range(12)]
    assert len(run(spark, quiet(4))) == 1
    assert [r[1] for r in run(spark, quiet(5))] == ["stop", "stop"]


def test_short_stays_unusable_rows_and_wrapped_longitudes(spark):
    stay = lambda lon, minutes: [["q", BASE + k * 60_000, None, 10.0, lon, None, 5.0] for k in range(minutes + 1)]
    assert run(spark, stay(20.0, 9)) == []
    (only,) = run(spark, stay(200.0, 10))
    assert only[7] == -160.0
    bad = [[None, BASE, None, 1.0, 1.0, 1.0, 1.0], ["p", None, None, 1.0, 1.0, 1.0, 1.0], ["p", 5, None, 1.0, 1.0, 1.0, 1.0], ["p", BASE, None, None, 1.0, 1.0, 1.0], ["p", BASE, None, 400.0, 1.0, 1.0, 1.0], ["p", BASE, None, 0.0, 0.0, 1.0, 1.0], ["p", BASE, None, float("nan"), 1.0, 1.0, 1.0]]
    assert run(spark, bad) == [] and run(spark, []) == []


def test_visits_of_one_spot_share_its_centre():
    spots = shared_spots([(10.0, 179.9999, 10), (10.0002, -179.9999, 30), (11.0, 0.0, 5)], 60.0)
    assert spots[0] == spots[1] and abs(spots[0][0] - 10.00015) < 1e-9 and abs(spots[0][1] + 179.99995) < 1e-6
    assert spots[2] == (11.0, 0.0) and shared_spots([], 60.0) == []


def test_spots_of_parent_cells_are_those_of_all_comparisons():
    rng = np.random.default_rng(4)
    for lat0, lon0 in ((45.0, 7.0), (-70.0, 179.999), (0.0, 0.0), (88.5, 10.0)):
        homes = np.stack([lat0 + rng.normal(0, 0.01, 30), lon0 + rng.normal(0, 0.02, 30)], axis=1)
        stops = [(float(a + rng.normal(0, 2e-4)), float(o + rng.normal(0, 2e-4)), int(rng.integers(1, 50))) for a, o in homes[rng.integers(0, 30, 400)]]
        centres, of = [], []
        for lat, lon, n in stops:
            away = [np.hypot(c[0] - lat, (c[1] - lon) * np.cos(np.radians(lat))) * METRES_PER_DEGREE for c in centres]
            k = int(np.argmin(away)) if away else -1
            if k < 0 or away[k] > 60:
                centres.append([lat, lon, n])
                k = len(centres) - 1
            else:
                c = centres[k]
                c[:] = [(c[0] * c[2] + lat * n) / (c[2] + n), (c[1] * c[2] + lon * n) / (c[2] + n), c[2] + n]
            of.append(k)
        got = shared_spots(stops, 60.0)
        assert np.allclose([g[0] for g in got], [centres[k][0] for k in of]) and np.allclose([(g[1] - centres[k][1] + 180) % 360 for g, k in zip(got, of)], 180)
