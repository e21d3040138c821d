"""Gaps of trajectories filled by resampling a participant's own flights and pauses.

A sparse online Gaussian process (Csato and Opper 2002) picks the instants that stand for a
participant's movement; gaps are then walked from both ends with flights and pauses drawn near
those instants in time of day, day of week and place. All draws are seeded by participant and
gap, so a repeated task gives the same result.
"""

from __future__ import annotations

import itertools
import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.functions.arrow_groups import to_batch
from tracelode.operators.trajectory import FLIGHT, LAT0, LAT1, LON0, LON1, OBS, PAUSE, STATUS, T0, T1, TRAJECTORY_DDL, arc_m, bends, by_participant, home_of

DAY_S, WEEK_S, HOUR_S = 86_400.0, 604_800.0, 3600.0


@dataclass(frozen=True)
class Kernel:
    """Scales: l in seconds (time) or degrees (l3), a for the periods, b weights, g in metres."""

    l1: float = 60 * 60 * 24 * 10
    l2: float = 60 * 60 * 24 * 30
    l3: float = 0.002
    g: float = 200.0
    a1: float = 5.0
    a2: float = 1.0
    b1: float = 0.3
    b2: float = 0.2
    b3: float = 0.5
    noise: float = 0.01
    tolerance: float = 0.05
    size: int = 100
    top: int = 10
    draws: int = 3
    linearity: float = 2.0
    method: str = "GLC"  # what likeness takes in: TL time, GL place, GLC both
    bend_m: float = 20.0  # of filled flights in a row, those with smaller bends become one

    def __post_init__(self) -> None:
        if self.method not in ("TL", "GL", "GLC"):
            raise ValueError("method must be TL, GL or GLC")


def periodic(dt: np.ndarray, k: Kernel) -> tuple[np.ndarray, np.ndarray]:
    """Likeness by time of day and by time of week, both fading with distance in time."""
    dt = np.abs(dt)
    day = np.exp(-dt / k.l1) * np.exp(-np.sin(np.pi * dt / DAY_S) ** 2 / k.a1)
    week = np.exp(-dt / k.l2) * np.exp(-np.sin(np.pi * dt / WEEK_S) ** 2 / k.a2)
    return day, week


def training_kernel(t: np.ndarray, x: np.ndarray, t0: float, x0: float, k: Kernel) -> np.ndarray:
    day, week = periodic(t - t0, k)
    return k.b1 * day + k.b2 * week + k.b3 * np.exp(-np.abs(x - x0) / k.l3)


class OnlineGP:
    """Sparse online GP with at most ``size`` basis vectors; state can be carried on."""

    def __init__(self, k: Kernel):
        self.k = k
        self.t, self.x = np.zeros(0), np.zeros(0)
        self.alpha, self.c, self.q = np.zeros(0), np.zeros((0, 0)), np.zeros((0, 0))
        self.centre: float | None = None

    @classmethod
    def restored(cls, state: dict, k: Kernel) -> OnlineGP:
        """A fit as ``model_states`` wrote it."""
        gp = cls(k)
        n = len(state["t"])
        gp.t, gp.x, gp.alpha, gp.centre = np.array(state["t"], float), np.array(state["x"], float), np.array(state["alpha"], float), state["centre"]
        gp.c, gp.q = np.array(state["c"], float).reshape(n, n), np.array(state["q"], float).reshape(n, n)
        return gp

    def add(self, t: float, x: float, y: float) -> None:
        k = self.k
        own = k.b1 + k.b2 + k.b3
        if not len(self.t):
            s2 = k.noise + own
            self.t, self.x = np.array([t]), np.array([x])
            self.alpha, self.c, self.q = np.array([y / s2]), np.array([[-1 / s2]]), np.array([[1 / own]])
            return
        near = training_kernel(self.t, self.x, t, x, k)
        c_near, weights = self.c @ near, self.q @ near
        s2 = k.noise + own + near @ c_near
        gain, novelty = (y - near @ self.alpha) / s2, own - near @ weights
        if novelty < k.tolerance:
            shift = c_near + weights
            eta = 1 / (1 - novelty / s2)
            self.alpha = self.alpha + gain * eta * shift
            self.c = self.c - eta / s2 * np.outer(shift, shift)
            return
        s, e = np.r_[c_near, 1], np.r_[weights, -1]
        n = len(self.t)
        pad = lambda m: np.pad(m, ((0, 1), (0, 1)))
        self.alpha = np.r_[self.alpha, 0] + gain * s
        self.c, self.q = pad(self.c) - np.outer(s, s) / s2, pad(self.q) + np.outer(e, e) / novelty
        self.t, self.x = np.r_[self.t, t], np.r_[self.x, x]
        if n + 1 > k.size:
            self._drop()

    def _drop(self) -> None:
        """Takes out the vector whose loss changes the posterior least."""
        q, c = np.diag(self.q), np.diag(self.c)
        score = self.alpha**2 / np.maximum(q + c, 1e-12)
        j = int(np.argmin(score))
        rest = np.arange(len(self.t)) != j
        qj, cj, both = self.q[rest, j], self.c[rest, j], self.q[j, j] + self.c[j, j]
        self.alpha = self.alpha[rest] - self.alpha[j] / both * (qj + cj)
        self.c = self.c[np.ix_(rest, rest)] + np.outer(qj, qj) / self.q[j, j] - np.outer(qj + cj, qj + cj) / both
        self.q = self.q[np.ix_(rest, rest)] - np.outer(qj, qj) / self.q[j, j]
        self.t, self.x = self.t[rest], self.x[rest]


#: The four fits: flights and pauses, each by latitude and by longitude.
FITS = tuple((kind, a, b) for kind in (FLIGHT, PAUSE) for a, b in ((LAT0, LON0), (LON0, LAT0)))


def fitted(rows: np.ndarray, k: Kernel = Kernel(), earlier: list[OnlineGP] | None = None) -> list[OnlineGP]:
    """The four fits over a trajectory, carried on from ``earlier`` ones."""
    out = earlier or [OnlineGP(k) for _ in FITS]
    middle = (rows[:, T0] + rows[:, T1]) / 2
    for gp, (kind, a, b) in zip(out, FITS, strict=True):
        of = np.flatnonzero(rows[:, STATUS] == kind)
        if gp.centre is None and len(of):
            gp.centre = float(rows[of, b].mean())
        for i in of:
            gp.add(middle[i], rows[i, a], rows[i, b] - gp.centre)
    return out


def representative(rows: np.ndarray, k: Kernel = Kernel(), earlier: list[OnlineGP] | None = None) -> np.ndarray:
    """The flights and pauses whose mid-times the four fits keep as basis vectors."""
    middle = (rows[:, T0] + rows[:, T1]) / 2
    keep = np.zeros(len(rows), bool)
    for gp, (kind, _, _) in zip(fitted(rows, k, earlier), FITS, strict=True):
        keep |= (rows[:, STATUS] == kind) & np.isin(middle, gp.t)
    return rows[keep]


_STATE = pa.schema([("participant", pa.string()), ("fit", pa.int32()), ("centre", pa.float64()), ("last_t", pa.float64()), *[(n, pa.list_(pa.float64())) for n in ("t", "x", "alpha", "c", "q")]])
STATE_DDL = "participant string, fit int, centre double, last_t double, t array<double>, x array<double>, alpha array<double>, c array<double>, q array<double>"


def model_states(trajectory: DataFrame, earlier: DataFrame | None = None, k: Kernel = Kernel()) -> DataFrame:
    """The state of each participant's four fits, one row each, to be written and carried on later.

    With ``earlier`` states only what came after their last instant is learnt, so a study can be
    taken in part by part; participants without new rows keep their state.
    """
    rows = trajectory.select("participant", F.struct(*TRAJECTORY_DDL.replace(",", " ").split()[2::2]).alias("row"), F.lit(None).cast(f"struct<{STATE_DDL.replace(' array', ':array').replace(' double', ':double').replace(' int', ':int').replace(' string', ':string').replace(', ', ',')}>").alias("state"))
    if earlier is not None:
        rows = rows.unionByName(earlier.select("participant", F.struct(*STATE_DDL.replace(",", " ").split()[::2]).alias("state")), allowMissingColumns=True)

    def learn(key, table):
        seen, states = [], []
        for row, state in zip(table.column("row").to_pylist(), table.column("state").to_pylist(), strict=True):
            if state is not None:
                states.append(state)
            elif row is not None:
                seen.append([float(v) if v is not None else math.nan for v in row.values()])
        data = np.array(sorted(seen, key=lambda r: r[T0]), float).reshape(-1, 8)
        gps = None
        if states:
            gps = [OnlineGP.restored(s, k) for s in sorted(states, key=lambda s: s["fit"])]
            data = data[data[:, T0] > max(s["last_t"] for s in states)]
        gps = fitted(data, k, gps)
        last = float(data[-1, T0]) if len(data) else max((s["last_t"] for s in states), default=0.0)
        out = [(key[0].as_py(), i, gp.centre, last, *(a.ravel().tolist() for a in (gp.t, gp.x, gp.alpha, gp.c, gp.q))) for i, gp in enumerate(gps)]
        return pa.Table.from_batches([to_batch(out, _STATE)])

    return rows.groupBy("participant").applyInArrow(learn, STATE_DDL)


class _Filler:
    def __init__(self, rows: np.ndarray, home: tuple[float, float] | None, k: Kernel, rng: np.random.Generator):
        self.k, self.rng, self.home = k, rng, home
        chosen = representative(rows, k)
        self.flights = chosen[chosen[:, STATUS] == FLIGHT]
        self.pauses = chosen[chosen[:, STATUS] == PAUSE]
        self.all_flights = rows[rows[:, STATUS] == FLIGHT]
        self.box = (rows[:, LAT0].min() - 0.01, rows[:, LAT0].max() + 0.01, rows[:, LON0].min() - 0.01, rows[:, LON0].max() + 0.01)

    def likeness(self, table: np.ndarray, t: float, lat: float, lon: float) -> np.ndarray:
        """Time of day and week, distance, or both together."""
        k = self.k
        near = np.exp(-arc_m(lat, lon, table[:, LAT0], table[:, LON0]) / k.g)
        if k.method == "GL":
            return near
        day, week = periodic((table[:, T0] + table[:, T1]) / 2 - t, k)
        return (k.b1 * day + k.b2 * week) / (k.b1 + k.b2) if k.method == "TL" else k.b1 * day + k.b2 * week + k.b3 * near

    def moves(self, t: float, lat: float, lon: float, speed: float, was_flight: bool) -> bool:
        top = lambda table: float(np.sort(self.likeness(table, t, lat, lon))[-self.k.top :].mean()) if len(table) else 0.0
        f, p = top(self.flights), top(self.pauses)
        p0 = min(max(f / (f + p + 1e-8), 1e-5), 1 - 1e-5)
        p1 = min(1.0, p0 * math.exp(min(max(0.0, speed - 2) / (-12 / math.log(p0)), 100)))
        draws = self.rng.random(self.k.draws) < p1
        return bool(draws.any() if was_flight else draws.all())

    def sample(self, table: np.ndarray, t: float, lat: float, lon: float) -> np.ndarray:
        w = self.likeness(table, t, lat, lon) + 1e-5
        return table[self.rng.choice(len(table), p=w / w.sum())]

    def direct(self, gap: list[float], low: float, high: float) -> list[list[float]]:
        """Stay, go straight at a drawn speed, stay."""
        lat, lon, t, lat1, lon1, t1 = gap
        need = min(float(arc_m(lat, lon, lat1, lon1)) / self.rng.uniform(low, high), t1 - t)
        if need >= t1 - t:
            return [[FLIGHT, *gap, 0]]
        go = self.rng.uniform(t, t1 - need)
        return [[PAUSE, lat, lon, t, lat, lon, go, 0], [FLIGHT, lat, lon, go, lat1, lon1, go + need, 0], [PAUSE, lat1, lon1, go + need, lat1, lon1, t1, 0]]

    def walk(self, gap: list[float], kinds: tuple[int, int]) -> list[list[float]]:
        """Steps from both ends in turn until they meet."""
        ends = [[gap[0], gap[1], gap[2], kinds[0] == FLIGHT], [gap[3], gap[4], gap[5], kinds[1] == FLIGHT]]
        out: list[list[float]] = []
        for step in itertools.count():
            (x0, y0, t0, _), (x1, y1, t1, _) = ends
            if t0 >= t1:
                return out
            away = float(arc_m(x0, y0, x1, y1))
            if away < 1e-6 or t1 - t0 < 30:
                break
            side = step % 2
            lat, lon, t, was_flight = ends[side]
            sign = -1 if side else 1
            left, target = t1 - t0, ends[1 - side]
            if len(self.flights) and self.moves(t, lat, lon, away / (left + 1e-4), was_flight):
                drawn = self.sample(self.flights, t, lat, lon)
                dx, dy, dt = sign * (drawn[LAT1] - drawn[LAT0]), sign * (drawn[LON1] - drawn[LON0]), drawn[T1] - drawn[T0]
                if dt > left:
                    dx, dy, dt = dx * left / dt, dy * left / dt, left
                ux, uy = target[0] - lat, target[1] - lon
                size, share = math.hypot(dx, dy), self.rng.uniform(0, self.k.linearity)
                bx, by = dx + share * ux, dy + share * uy
                if math.hypot(bx, by) > 0:
                    dx, dy = (v * size / math.hypot(bx, by) for v in (bx, by))
                if dx * ux + dy * uy < 0:
                    dx, dy = -dx, -dy
                to = (lat + dx, lon + dy)
                inside = self.box[0] <= to[0] <= self.box[1] and self.box[2] <= to[1] <= self.box[3]
                speed = float(arc_m(lat, lon, lat + dx, lon + dy)) / max(dt, 1e-4)
                if not inside or float(arc_m(lat, lon, *to)) >= away:
                    to, dt = (target[0], target[1]), min(left, away / max(speed, 0.5))
                kind = FLIGHT
            else:
                drawn = self.sample(self.pauses, t, lat, lon)
                dt = drawn[T1] - drawn[T0]
                dt *= 1 if dt <= 1800 else 5 if dt <= 3 * HOUR_S else 10 if dt <= 18 * HOUR_S else 50
                if dt >= left:
                    break
                to, kind = (lat, lon), PAUSE
            at = t + sign * dt
            out.append([kind, lat, lon, t, *to, at, 0] if not side else [kind, *to, at, lat, lon, t, 0])
            ends[side] = [*to, at, kind == FLIGHT]
        (x0, y0, t0, _), (x1, y1, t1, _) = ends
        if t1 > t0:
            out.append([PAUSE if float(arc_m(x0, y0, x1, y1)) < 1e-6 else FLIGHT, x0, y0, t0, x1, y1, t1, 0])
        return out

    def fill(self, gap: list[float], kinds: tuple[int, int]) -> list[list[float]]:
        lat, lon, t, lat1, lon1, t1 = gap
        away, span = float(arc_m(lat, lon, lat1, lon1)), t1 - t
        if (lat, lon) == (lat1, lon1):
            return [[PAUSE, *gap, 0]]
        if away > 300_000:
            return [[FLIGHT, *gap, 0]] if away / span > 210 else self.direct(gap, 244, 258)
        home = [float(arc_m(a, b, *self.home)) for a, b in ((lat, lon), (lat1, lon1))] if self.home else [math.inf, math.inf]
        around = int(np.searchsorted(self.all_flights[:, T0], t1 + 12 * HOUR_S, "left") - np.searchsorted(self.all_flights[:, T1], t - 12 * HOUR_S, "right"))
        if (around <= 5 and span > 6 * HOUR_S and min(home) > 50) or not len(self.pauses):
            return self.direct(gap, *((1, 1.8) if away < 3000 else (13, 32)))
        out = []
        if span > 4 * HOUR_S and min(home) <= 50:
            need = min(away / 0.6, span)
            if home[0] <= 50:
                out.append([PAUSE, lat, lon, t, lat, lon, t1 - need, 0])
                gap = [lat, lon, t1 - need, lat1, lon1, t1]
            else:
                out.append([PAUSE, lat1, lon1, t + need, lat1, lon1, t1, 0])
                gap = [lat, lon, t, lat1, lon1, t + need]
        return out + self.walk(gap, kinds)


def tidied(filled: list[list[float]], bend_m: float) -> list[list[float]]:
    """The rows that fill a gap, runs of one kind put together.

    Pauses in a row become one from the first start to the last end; flights in a row become as
    few as their bends of ``bend_m`` or more allow.
    """
    rows = sorted((r for r in filled if r[T1] > r[T0]), key=lambda r: r[T0])
    out: list[list[float]] = []
    for kind, run in itertools.groupby(rows, key=lambda r: r[STATUS]):
        run = list(run)
        if kind == PAUSE or len(run) == 1:
            out.append([kind, *run[0][LAT0 : T0 + 1], *run[-1][LAT1 : T1 + 1], 0])
            continue
        points = np.array([run[0][LAT0 : T0 + 1], *[r[LAT1 : T1 + 1] for r in run]], float)
        at = bends(points[:, 0], points[:, 1], [0, len(points) - 1], bend_m)
        out += [[FLIGHT, *points[a].tolist(), *points[b].tolist(), 0] for a, b in zip(at, at[1:], strict=False)]
    return out


def impute_rows(who: str, rows: np.ndarray, zone: str = "UTC", k: Kernel = Kernel()) -> list[list[float]]:
    """The trajectory with every gap filled (obs 0), in time order; rows without length are left out."""
    rows = rows[np.argsort(rows[:, T0], kind="stable")]
    filler, out = None, [list(r) for r in rows]
    for i in range(len(rows) - 1):
        a, b = rows[i], rows[i + 1]
        if b[T0] <= a[T1]:
            continue
        rng = np.random.default_rng(zlib.crc32(f"{who}|{a[T1]:.3f}".encode()))
        if filler is None:
            filler = _Filler(rows, home_of(rows, zone), k, rng)
        filler.rng = rng
        out += tidied(filler.fill([a[LAT1], a[LON1], a[T1], b[LAT0], b[LON0], b[T0]], (int(a[STATUS]), int(b[STATUS]))), k.bend_m)
    return sorted((r for r in out if r[T1] > r[T0]), key=lambda r: r[T0])


def impute(trajectory: DataFrame, zone: str = "UTC", k: Kernel = Kernel()) -> DataFrame:
    """Trajectories of all participants with their gaps filled; same columns, ``obs`` 0 where filled."""
    schema = pa.schema([("participant", pa.string()), ("status", pa.int32()), *[(n, pa.float64()) for n in ("lat0", "lon0", "t0", "lat1", "lon1", "t1")], ("obs", pa.int32())])
    typed = lambda rows: [(int(r[STATUS]), *map(float, r[1:7]), int(r[OBS])) for r in rows]
    return by_participant(trajectory, lambda who, rows: typed(impute_rows(who, rows, zone, k)), schema, TRAJECTORY_DDL)
