from __future__ import annotations

import numpy as np
import pytest

from tracelode.operators import trajectory as T
from tracelode.operators.gps_reports import asserted_positions, report

# The published test day (places, legs in seconds after its start) and its published statistics below.
A, B, C = (51.45435654, -2.58555554), (51.4539284, -2.5861665), (51.4542473, -2.5861116)
T0 = 1_633_042_800
LEGS = [(2, A, A, 0, 39_600), (1, A, B, 39_600, 40_500), (2, B, B, 40_500, 44_100), (1, B, A, 44_100, 45_000), (2, A, A, 45_000, 63_000), (1, A, C, 63_000, 64_800), (2, C, C, 64_800, 75_600), (1, C, A, 75_600, 77_500), (2, A, A, 77_500, 86_700)]
DAY = np.array([[s, *a, T0 + t, *b, T0 + u, 1] for s, a, b, t, u in LEGS], float)


def test_a_known_day():
    got = T.bin_statistics(T.stretched(DAY, T0, T0 + 86_400), (51.457183, -2.597960), "Europe/London")
    want = {"obs_duration": 24 * 3600, "obs_day": 10 * 3600, "obs_night": 14 * 3600, "home_time": 0, "dist_traveled": 208, "num_sig_places": 2, "total_flight_time": 5500, "av_flight_length": 52}
    assert {k: got[k] for k in want} == want
    assert [round(got[k] / 1000, 3) for k in ("max_dist_home", "radius", "diameter", "sd_flight_length")] == [0.915, 0.013, 0.064, 0.012]
    assert round(got["entropy"], 3) == 0.468
    assert [round(got[k] / 3600, 3) for k in ("av_flight_duration", "sd_flight_duration", "total_pause_time", "av_pause_duration", "sd_pause_duration")] == [0.382, 0.132, 22.472, 4.494, 3.496]


def test_the_published_tables_of_a_known_day(spark):
    columns = T.TRAJECTORY_DDL.replace(",", " ").split()[::2]
    path = spark.createDataFrame([("p", int(r[0]), *map(float, r[1:7]), int(r[7])) for r in DAY], T.TRAJECTORY_DDL)
    assert path.columns == columns
    at = (51.457183, -2.597960)
    first, second = report(T.summary(path, zone="Europe/London", home_at=at), True, "Europe/London", T.routine(path, "Europe/London")).orderBy("day").collect()
    got = first.asDict()
    assert (got["year"], got["month"], got["day"]) == (2021, 10, 1) and (second.obs_day, second.obs_night) == (0, 0.0)
    assert [got[k] for k in ("obs_duration", "obs_day", "obs_night", "home_time", "dist_traveled", "num_sig_places")] == [24, 10, 14, 0, 0.208, 2]
    want = {"max_dist_home": 0.915, "radius": 0.013, "diameter": 0.064, "entropy": 0.468, "total_flight_time": 1.528, "av_flight_length": 0.052, "sd_flight_length": 0.012, "av_flight_duration": 0.382, "sd_flight_duration": 0.132, "total_pause_time": 22.472, "av_pause_duration": 4.494, "sd_pause_duration": 3.496}
    assert {k: round(got[k], 3) for k in want} == want
    assert got["physical_circadian_rhythm"] == got["physical_circadian_rhythm_stratified"] == 0
    hours = report(T.summary(path, 3600, "Europe/London", at), False, "Europe/London")
    assert hours.count() == 24 and len(hours.columns) == 17
    assert hours.where("hour = 11").first().av_flight_length == got["av_flight_length"] * 1000 or hours.where("hour = 11").first().obs_duration == 60


def test_stretching_beyond_the_data_is_not_observed():
    got = T.stretched(DAY, T0 - 3600, T0 + 1800)
    assert got[0, T.T0] == T0 - 3600 and got[0, T.T1] == T0 + 1800 and got[0, T.OBS] == 0
    assert T.bin_statistics(T.stretched(DAY, 0, 10), A)["obs_duration"] == 0


def test_knots_at_a_bend_and_pauses():
    lat = np.r_[np.linspace(0, 0.01, 11), np.full(10, 0.01)]
    lon = np.r_[np.zeros(11), np.linspace(0.001, 0.01, 10)]
    assert 10 in T.knots(lat, lon, 20.0, 1.0)
    still = T.chunk_rows(np.arange(5.0), np.full(5, 1.0), np.full(5, 2.0), 10, 10, 20, 10)
    assert [r[0] for r in still] == [T.PAUSE] and still[0][3] == -5 and still[0][6] == 9
    assert T.chunk_rows(np.array([7.0]), np.array([1.0]), np.array([2.0]), 10, 10, 20, 10)[0][0] == T.UNKNOWN


def test_inference_keeps_time_in_order_and_fills_small_gaps():
    rows = [[2, 1.0, 1.0, 0, 1.0, 1.0, 10, 1], [2, 1.0, 1.0, 10, 1.0, 1.0, 20, 1], [3, 1.0, 1.0, 40, np.nan, np.nan, 50, 1], [1, 1.0, 1.0, 60, 1.01, 1.0, 90, 1]]
    out = T.infer(rows, 10, 10)
    assert all(a[T.T0] <= b[T.T0] for a, b in zip(out, out[1:])) and not np.isnan(np.array(out)).any()
    assert {x[T.OBS] for x in out} == {0, 1} and out[0][T.T1] == 20


def test_places_and_home():
    places = T.significant_places(DAY[DAY[:, 0] == 2], 30.0)
    assert [int(p[2]) for p in places] == [3, 1, 1]
    assert T.home_of(DAY, "Europe/London") == pytest.approx(A)
    assert T.home_of(DAY[DAY[:, 0] == 1]) is None


def test_routine_of_equal_and_different_days():
    week = np.concatenate([DAY[:, :] + np.array([0, 0, 0, 86_400 * k, 0, 0, 86_400 * k, 0]) for k in range(5)])
    week[:, T.T1] = np.minimum(week[:, T.T1], np.r_[week[1:, T.T0], np.inf])
    same = T.routine_of(week, T0 + 2 * 86_400, T0 + 3 * 86_400)
    assert same == pytest.approx(1.0)
    week[week[:, T.T0] < T0 + 2 * 86_400, T.LAT0] += 1
    assert T.routine_of(week, T0 + 2 * 86_400, T0 + 3 * 86_400) == pytest.approx(0.5)
    assert T.routine_of(DAY, T0, T0 + 86_400) == 0 and T.routine_of(DAY[DAY[:, 0] == 1], T0, T0 + 86_400) == 0
    assert T.agreement(week[:1], week[:0], 0, 1) == 0


def test_pipeline(spark):
    rows = [("p", 10 * k, 45 + (k % 2) * 1e-6 + max(0, k - 200) * 1e-4, 7.0) for k in range(400)]
    fixes = spark.createDataFrame(rows, "participant string, t long, lat double, lon double")
    got = T.trajectories(fixes).orderBy("t0").collect()
    assert got[0].status == T.PAUSE and T.FLIGHT in {r.status for r in got}
    assert T.trajectories(fixes.limit(0)).count() == 0


def test_positions_off_the_globe_are_an_error(spark):
    rows = [("p", 1, 1.0, 1.0, 0.0, 1.0, 1.0, 5.0, 1), ("p", 1, 91.0, 1.0, 5.0, 1.0, 1.0, 9.0, 1)]
    assert asserted_positions(spark.createDataFrame(rows[:1], T.TRAJECTORY_DDL)).count() == 1
    with pytest.raises(Exception, match="off the globe"):
        asserted_positions(spark.createDataFrame(rows, T.TRAJECTORY_DDL)).collect()


def test_pauses_of_one_place_are_merged():
    rows = DAY[DAY[:, 0] == 2]
    assert [round(p[2]) for p in T.merged_pauses(rows, (0.0, 0.0), 7.5)] == [round((39_600 + 18_000 + 9_200) / 60), 60, 180]
    assert T.merged_pauses(rows, A, 7.5)[0][2] == 60 and T.merged_pauses(rows[:0], A, 7.5) == []
