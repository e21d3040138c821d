from __future__ import annotations

import math

import numpy as np
import pytest

from tracelode.functions.timebins import Frequency
from tracelode.operators import places as P
from tracelode.operators import simulate as Z
from tracelode.operators import trajectory as T
from tracelode.operators.comm_logs import communication_summary


def square(lat, lon, half_m):
    d, e = half_m / P.METRES, half_m / P.METRES / math.cos(math.radians(lat))
    return [[lat - d, lon - e], [lat - d, lon + e], [lat + d, lon + e], [lat + d, lon - e]]


def test_areas():
    turn = np.linspace(0, 2 * math.pi, 721)[:-1]
    ring = 30 * np.stack([np.cos(turn), np.sin(turn)], axis=1)
    assert P.area(ring) == pytest.approx(math.pi * 900, rel=1e-3)
    for shift in (0, 10, 25, 45, 79, 81):
        assert P.polygon_in_circle(ring + [shift, 0], 50) == pytest.approx(P.circles_area(shift, 50, 30), abs=1.0)
    notched = np.array([[-60, -60], [60, -60], [60, 60], [0, 0], [-60, 60]], float)
    assert P.polygon_in_circle(notched, 20) == pytest.approx(math.pi * 400 * 0.75)
    assert P.overlap_m2(45, 7, 50, np.array(square(45, 7, 10)), 5) == pytest.approx(400, rel=0.01)
    assert P.overlap_m2(45, 7, 50, np.array(square(45, 7, 500)[::-1]), 5) == pytest.approx(math.pi * 2500, rel=0.01)
    assert P.overlap_m2(45, 7, 50, np.array([[45.0, 7.0]]), 5) == pytest.approx(math.pi * 25, rel=0.01)
    assert P.overlap_m2(45, 7, 50, np.array(square(45.01, 7, 10)), 5) == pytest.approx(0, abs=1e-9)


def test_times_at_places(spark):
    pauses = spark.createDataFrame([("p", 1, 45.0, 7.0, 600.0, 0.0), ("p", 2, 45.1, 7.1, 60.0, 0.0), ("p", 3, None, 7.1, 60.0, 0.0)], "participant string, pause_id long, lat double, lon double, seconds double, t0 double")
    shapes = [(1, "pub", square(45, 7, 20), {"a": "b"}), (2, "park", square(45, 7.0003, 10), {}), (3, "pub", square(45.0, 7.0, 5), None), (4, "pub", [], None), (5, "bar", [[45.00001, 7.0]], None)]
    places = spark.createDataFrame(shapes, "place_id long, kind string, shape array<array<double>>, tags map<string,string>")
    overlaps = P.place_overlaps(pauses, places)
    got = {r.kind: (round(r.minutes, 6), r.minutes_adjusted) for r in P.place_times(pauses, overlaps).collect()}
    assert got["pub"][0] == 10 and got["park"][0] == 0 and got["other"] == (2, 0.0) and got["bar"][0] == 0
    assert sum(v[1] for v in got.values()) == pytest.approx(10) and got["park"][1] > 0
    assert {r.place_id for r in P.places_log(pauses, overlaps, places).collect()} == {1, 2, 3, 5}
    assert P.place_overlaps(pauses, places.limit(0)).count() == 0


def test_simulated_logs(spark):
    calls, texts = Z.simulate_logs(spark, users=3, days=10)
    assert sorted(map(tuple, texts.collect())) == sorted(map(tuple, Z.simulate_logs(spark, users=3, days=10)[1].collect()))
    assert calls.count() > 20 and texts.count() > 50 and texts.where("message_length != 'MMS' AND CAST(message_length AS INT) < 5").count() == 0
    days = communication_summary(calls, texts, Frequency.DAILY)
    assert 27 <= days.count() <= 30


def test_simulated_traces(spark):
    fixes = Z.simulate_gps(spark, users=2, days=2)
    rows = fixes.where("participant = 'user1'").orderBy("t").collect()
    assert rows == Z.simulate_gps(spark, users=2, days=2).where("participant = 'user1'").orderBy("t").collect()
    t = np.array([r.t for r in rows])
    assert (np.diff(t) > 0).all() and 0.15 < len(t) * 5 / (2 * 86_400) < 0.35
    assert np.hypot(*np.ptp(np.array([(r.lat, r.lon) for r in rows]), axis=0)) < 0.5
    homes = T.homes(T.trajectories(fixes, interval=60, r=50, w=50, h=30)).collect()
    first = rows[0]
    (mine,) = [h for h in homes if h.participant == "user1"]
    assert T.arc_m(mine.lat, mine.lon, first.lat, first.lon) < 100


def test_simulated_calls_and_texts_are_both_put_out(spark):
    from tracelode.queries.kernels import sim_logs

    calls, texts = Z.simulate_logs(spark)
    assert {r["kind"]: r["count"] for r in sim_logs(spark, "").groupBy("kind").count().collect()} == {"call": calls.count(), "text": texts.count()}


def test_people_and_switches():
    people = Z.people_of({"User 1": {"vehicle": "bus", "main_employment": "university", "active_status": 10, "preferred_exits": ["cinema"]}, "Users 2-3": {"active_status": 8, "active_status-1": 0, "vehicle-2": "car"}})
    assert sorted(people) == [1, 2, 3] and people[1].on(5) == Z.Attributes("bus", "university", 10, 5, ("cinema",))
    assert [people[2].on(d).active_status for d in (0, 1, 2)] == [8, 0, 0] and [people[3].on(d).vehicle for d in (1, 2)] == ["foot", "car"]
    for bad in ({"User": {}}, {"User 1": {"vehicle": "boat"}}, {"User 1": {"active_status": 11}}, {"User 1": {"preferred_exits": ["bar", "bar"]}}):
        with pytest.raises(ValueError):
            Z.people_of(bad)
    monday = 1_641_168_000
    idle = Z.Person(Z.Attributes("foot", "none", 0))
    still = np.array(Z.one_trace(0, 2, monday, 1, Z.Traveller(), idle))
    assert np.ptp(still[:, 1:], axis=0).max() == 0 and abs(len(still) - 2 * 86_400 / 5) <= 2
    ride = np.array(Z.one_trace(0, 1, monday, 1, Z.Traveller(), Z.Person(Z.Attributes("bus", "office", 0))))
    drive = np.array(Z.one_trace(0, 1, monday, 1, Z.Traveller(), Z.Person(Z.Attributes("car", "office", 0))))
    pauses = lambda x: int((np.diff(np.flatnonzero(np.hypot(*np.diff(x[:, 1:], axis=0).T) > 0)) > 1).sum())
    assert pauses(ride) > pauses(drive) == 1 and (np.diff(ride[:, 0]) > 0).all()
    quiet = np.array(Z.one_trace(1, 3, monday + 5 * 86_400, 2, Z.Traveller(), Z.Person(Z.Attributes("foot", "none", 10), ((1, "active_status", 0),))))
    moved = [np.ptp(quiet[(quiet[:, 0] - monday) // 86_400 == 5 + d][:, 1:], axis=0).max() for d in range(3)]
    assert moved[0] > 0 and moved[2] == 0
