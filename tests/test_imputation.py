from __future__ import annotations

import numpy as np
import pytest

from tracelode.operators import imputation as I
from tracelode.operators import trajectory as T
from tracelode.operators.imputation import Kernel, model_states, tidied
from tracelode.operators.trajectory import TRAJECTORY_DDL


def days(n=6, gap=True):
    """Home at night, a walk to work and back each day; some afternoons are missing."""
    rows, home, work = [], (45.0, 7.0), (45.01, 7.01)
    for d in range(n):
        t = 86_400 * d
        legs = [(2, home, home, 0, 8), (1, home, work, 8, 8.5), (2, work, work, 8.5, 17), (1, work, home, 17, 17.5), (2, home, home, 17.5, 24)]
        if gap and d % 2:
            legs = legs[:2] + [(2, work, work, 8.5, 12), (2, home, home, 20, 24)]
        rows += [[s, *a, t + 3600 * u, *b, t + 3600 * v, 1] for s, a, b, u, v in legs]
    return np.array(rows, float)


def test_gaps_are_filled_without_holes_and_repeatably():
    rows = days()
    out = np.array(I.impute_rows("p", rows))
    assert np.allclose(out[1:, T.T0], out[:-1, T.T1]) and (out[:, T.T1] > out[:, T.T0]).all()
    assert np.allclose(out[1:, T.LAT0], out[:-1, T.LAT1]) and np.allclose(out[1:, T.LON0], out[:-1, T.LON1])
    assert len(out[out[:, T.OBS] == 1]) == len(rows) and (out[:, T.OBS] == 0).any()
    assert np.array_equal(out, np.array(I.impute_rows("p", rows))) and abs(out[:, T.LAT0] - 45).max() < 0.05


def test_long_hauls_and_complete_trajectories():
    rows = np.array([[2, 45.0, 7.0, 0, 45.0, 7.0, 3600, 1], [2, 52.0, 13.0, 90_000, 52.0, 13.0, 99_000, 1]], float)
    kinds = [int(r[0]) for r in I.impute_rows("p", rows)]
    assert kinds == [2, 2, 1, 2, 2]
    whole = days(2, gap=False)
    assert len(I.impute_rows("p", whole)) == len(whole)


def test_online_gp_is_sparse_and_follows_the_data():
    k = I.Kernel(size=20, l3=0.5)
    gp = I.OnlineGP(k)
    rng = np.random.default_rng(0)
    for i in range(400):
        x = rng.uniform(0, 6)
        gp.add(i * 600.0, x, np.sin(x))
    assert len(gp.t) <= 20
    error = [abs(I.training_kernel(gp.t, gp.x, 240_000.0, x, k) @ gp.alpha - np.sin(x)) for x in np.linspace(0.5, 5.5, 20)]
    assert np.mean(error) < 0.35 and np.isfinite(gp.alpha).all()


def test_table(spark):
    rows = [("p", int(r[0]), *map(float, r[1:7]), 1) for r in days(4)]
    df = spark.createDataFrame(rows, T.TRAJECTORY_DDL)
    got = I.impute(df)
    assert got.where("obs = 0").count() > 0 and got.count() > len(rows) and I.impute(df.limit(0)).count() == 0


def test_states_carry_on_where_they_stopped(spark):
    rng = np.random.default_rng(3)
    rows, t = [], 0.0
    for k in range(160):
        lat, step = 45 + rng.normal(0, 0.01), float(rng.uniform(300, 4000))
        rows.append(("p", 1 + k % 2, lat, 7.0, t, lat + 0.001 * (1 - k % 2), 7.0, t + step, 1))
        t += step
    path = spark.createDataFrame(rows, TRAJECTORY_DDL)
    kernel = Kernel(size=12)
    half = float(rows[79][4])
    part = model_states(path.where(path.t0 <= half), None, kernel)
    resumed = {r.fit: r for r in model_states(path, part, kernel).collect()}
    rest = {r.fit: r for r in model_states(path.where(path.t0 > half), part, kernel).collect()}
    assert set(resumed) == {0, 1, 2, 3} and all(resumed[k].t == rest[k].t and resumed[k].alpha == rest[k].alpha and len(resumed[k].t) <= 12 for k in resumed)
    kept = {r.fit: r for r in model_states(path.limit(0), part, kernel).collect()}
    assert [kept[k].t for k in range(4)] == [r.t for r in sorted(part.collect(), key=lambda r: r.fit)]


def test_rows_of_one_kind_are_put_together():
    filled = [[2, 1.0, 1.0, 0.0, 1.0, 1.0, 10.0, 0], [2, 1.0, 1.0, 10.0, 1.0, 1.0, 30.0, 0], [1, 1.0, 1.0, 30.0, 1.001, 1.0, 40.0, 0], [1, 1.001, 1.0, 40.0, 1.002, 1.0, 50.0, 0], [1, 1.002, 1.0, 50.0, 1.002, 1.005, 60.0, 0], [1, 1.002, 1.005, 60.0, 1.002, 1.006, 61.0, 0], [1, 5.0, 5.0, 61.0, 5.0, 5.0, 61.0, 0]]
    out = tidied(filled, 20.0)
    assert [r[0] for r in out] == [2, 1, 1] and [r[3] for r in out] == [0.0, 30.0, 50.0] and out[-1][6] == 61.0


def test_methods():
    with pytest.raises(ValueError):
        Kernel(method="XY")
    assert Kernel(method="TL").method == "TL"
