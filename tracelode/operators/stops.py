"""Stops and trips from location pings.

Pings are put into grid cells of two levels and run-length encoded: fine cells of ``cell_m`` in a
plane of the bucket tell where a ping is against its run, parent cells of eight by eight fine ones
which visits of all days are near each other. A dwell run keeps every ping in the cell of its running centre or a neighbour of it;
it ends only when ``leave_fixes`` pings in a row lie elsewhere (stray pings don't end it) or
after a silence of more than ``silence_ms``. Runs of at least ``min_stop_ms`` are stops.

Two levels keep every task small, however many pings one participant has: runs are formed per
(participant, day), then only the runs that matter - stops, a day's first and last runs, and one
summary of each movement between - are stitched per participant in time order, streaming; what a
task holds is one participant's stops, which time bounds.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.functions.arrow_groups import key_runs, sorted_groups
from tracelode.functions.geo import EARTH_RADIUS_M, wrap_longitude
from tracelode.functions.instants import sensor_instant

METRES_PER_DEGREE = EARTH_RADIUS_M * math.pi / 180
HOUR_MS = 3_600_000


@dataclass(frozen=True)
class StopRule:
    """Parameters; distances in metres, times in ms."""

    radius_m: float = 100.0
    min_stop_ms: int = 600_000
    silence_ms: int = 4 * HOUR_MS
    leave_fixes: int = 3
    cell_m: float = 70.0
    max_accuracy_m: float = 200.0
    earliest_ms: int = 946_684_800_000  # clocks before 2000 are impossible
    bucket_ms: int = 24 * HOUR_MS
    same_spot_m: float = 60.0  # visits of one participant this near to each other share their spot
    # A stop begins with its first ping that isn't part of the approach, and ends likewise: of the first
    # ``approach_fixes`` pings at most a third are, those further from their median than ``approach_times`` the
    # median distance, and ``approach_m`` at least. All pings stay in the stop's centre and count.
    approach_fixes: int = 15
    approach_times: float = 3.0
    approach_m: float = 20.0


_TOKEN = pa.schema([
    ("participant", pa.string()), ("moving", pa.bool_()), ("barrier", pa.bool_()), ("t0", pa.int64()), ("t1", pa.int64()),
    ("s0", pa.int64()), ("s1", pa.int64()), ("n", pa.int64()), ("lat", pa.float64()), ("lon", pa.float64()),
    ("lat0", pa.float64()), ("lon0", pa.float64()), ("lat1", pa.float64()), ("lon1", pa.float64()), ("path_m", pa.float64()), ("max_gap", pa.int64()),
])
_TOKEN_DDL = (
    "participant string, moving boolean, barrier boolean, t0 long, t1 long, s0 long, s1 long, n long, lat double, lon double, "
    "lat0 double, lon0 double, lat1 double, lon1 double, path_m double, max_gap long"
)
_ROW_DDL = (
    "participant string, kind string, start_ms long, end_ms long, n_fixes long, distance_m double, "
    "from_lat double, from_lon double, to_lat double, to_lon double"
)


def distance_m(lat0: float, lon0: float, lat1: float, lon1: float) -> float:
    """Great-circle distance by the haversine form."""
    a, b = math.radians(lat0), math.radians(lat1)
    h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(lon1 - lon0) / 2) ** 2
    return 2 * EARTH_RADIUS_M * math.asin(min(1.0, math.sqrt(h)))


def _path_m(lat: np.ndarray, lon: np.ndarray) -> float:
    if len(lat) < 2:
        return 0.0
    a = np.radians(lat)
    h = np.sin(np.diff(a) / 2) ** 2 + np.cos(a[:-1]) * np.cos(a[1:]) * np.sin(np.radians(np.diff(lon)) / 2) ** 2
    return float((2 * EARTH_RADIUS_M * np.arcsin(np.minimum(1, np.sqrt(h)))).sum())


def _arrival(x: np.ndarray, y: np.ndarray, rule: StopRule) -> int:
    """How many pings at the head of a run still belong to the approach; none of runs below six pings."""
    if len(x) < 6:
        return 0
    head = slice(0, rule.approach_fixes)
    away = np.hypot(x[head] - np.median(x[head]), y[head] - np.median(y[head]))
    limit = max(rule.approach_m, rule.approach_times * float(np.median(away)))
    k = 0
    while k < len(away) // 3 and away[k] > limit:
        k += 1
    return k


def _dwell_runs(t: np.ndarray, x: np.ndarray, y: np.ndarray, rule: StopRule) -> list[np.ndarray]:
    """The pings (as indexes) of each run of one bucket in time order, stray pings left out."""
    gx, gy = np.floor(x / rule.cell_m), np.floor(y / rule.cell_m)
    starts = np.flatnonzero(np.r_[True, (gx[1:] != gx[:-1]) | (gy[1:] != gy[:-1]) | (np.diff(t) > rule.silence_ms)])
    ends = np.r_[starts[1:], len(t)]
    sums_x, sums_y = np.add.reduceat(x, starts).tolist(), np.add.reduceat(y, starts).tolist()
    cx, cy, size = gx[starts].tolist(), gy[starts].tolist(), (ends - starts).tolist()
    first, last = t[starts].tolist(), t[ends - 1].tolist()
    cell, silence, leave = rule.cell_m, rule.silence_ms, rule.leave_fixes
    runs, i, m = [], 0, len(size)
    while i < m:
        mine, n, sx, sy, until = [i], size[i], sums_x[i], sums_y[i], last[i]
        pending, away, j = [], 0, i + 1
        while j < m and first[j] - until <= silence:
            if abs(cx[j] - sx / n // cell) <= 1 and abs(cy[j] - sy / n // cell) <= 1:
                mine.append(j)
                n, sx, sy, until = n + size[j], sx + sums_x[j], sy + sums_y[j], last[j]
                pending, away = [], 0
            else:
                pending.append(j)
                away += size[j]
                if away >= leave:
                    break
            j += 1
        runs.append(np.concatenate([np.arange(starts[k], ends[k]) for k in mine]) if len(mine) > 1 else np.arange(starts[i], ends[i]))
        i = pending[0] if pending else j
    return runs


def day_tokens(t: np.ndarray, lat: np.ndarray, lon: np.ndarray, rule: StopRule) -> list[tuple]:
    """Runs and movements of one participant's bucket; ``t`` ascends, repeats of an instant are left out here."""
    keep = np.r_[True, t[1:] != t[:-1]]
    t, lat, lon = t[keep], lat[keep], lon[keep]
    lon = lon[0] + (lon - lon[0] + 180) % 360 - 180
    y, x = lat * METRES_PER_DEGREE, lon * METRES_PER_DEGREE * max(0.01, math.cos(math.radians(float(np.median(lat)))))
    runs = _dwell_runs(t, x, y, rule)
    centres = [(float(lat[r].mean()), float(lon[r].mean())) for r in runs]
    lone = set()  # a single ping far off its neighbours is stray: no part of the path
    for k in range(1, len(runs) - 1):
        if len(runs[k]) <= 2:
            there, back, across = distance_m(*centres[k - 1], *centres[k]), distance_m(*centres[k], *centres[k + 1]), distance_m(*centres[k - 1], *centres[k + 1])
            if there + back > 3 * across + 500:
                lone.add(k)
    out: list[tuple] = []
    moving: list | None = None
    before = 0

    def flush() -> None:
        nonlocal moving
        if moving:
            out.append(tuple(moving))
            moving = None

    for k, run in enumerate(runs):
        a, b = int(run[0]), int(run[-1])
        t0, t1 = int(t[a]), int(t[b])
        inner = run if len(run) == b - a + 1 else np.arange(a, b + 1)
        gap = int(np.diff(t[inner]).max()) if len(inner) > 1 else 0
        edge = k < rule.leave_fixes or k >= len(runs) - rule.leave_fixes
        if t1 - t0 >= rule.min_stop_ms or edge:
            flush()
            head, tail = _arrival(x[run], y[run], rule), _arrival(x[run][::-1], y[run][::-1], rule)
            barrier = before >= rule.leave_fixes
            came, left = int(run[head]), int(run[len(run) - 1 - tail])  # approach and departure belong to the trips
            out.append((False, barrier, t0, t1, int(t[came]), int(t[left]), len(run), *centres[k], float(lat[came]), float(lon[came]), float(lat[left]), float(lon[left]), _path_m(lat[run], lon[run]), gap))
        elif k not in lone:
            if moving is None:
                moving = [True, True, t0, t1, t0, t1, len(run), *centres[k], float(lat[a]), float(lon[a]), float(lat[b]), float(lon[b]), _path_m(lat[run], lon[run]), gap]
            else:
                moving[13] += distance_m(moving[11], moving[12], float(lat[a]), float(lon[a])) + _path_m(lat[run], lon[run])
                moving[14] = max(moving[14], t0 - moving[3], gap)
                moving[3] = moving[5] = t1
                moving[6] += len(run)
                moving[11], moving[12] = float(lat[b]), float(lon[b])
        before += len(run)
    flush()
    return out


def _first_level(rule: StopRule) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for (who, _), (t, lat, lon) in key_runs(batches, 2):
            rows += [(who, *token) for token in day_tokens(t, lat, lon, rule)]
            if len(rows) > 20_000:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _TOKEN, strict=True)], schema=_TOKEN)


class _SpotGrid:
    """A participant's spots by parent cells of eight by eight fine cells, so a visit is compared with the spots around it alone."""

    def __init__(self, within_m: float, cell_m: float):
        self.size = 8 * cell_m / METRES_PER_DEGREE
        self.within_m = within_m
        self.cells: dict[tuple[int, int], list[int]] = {}
        self.centres: list[list[float]] = []  # lat, lon, pings

    def _cell(self, lat: float, lon: float) -> tuple[int, int]:
        return math.floor(lat / self.size), math.floor(lon / self.size)

    def _around(self, lat: float, lon: float) -> list[int]:
        reach = self.within_m / METRES_PER_DEGREE
        wide = reach / max(0.01, math.cos(math.radians(min(89.0, abs(lat) + reach))))
        (south, west), (north, east) = self._cell(lat - reach, lon - wide), self._cell(lat + reach, lon + wide)
        return sorted(k for y in range(south, north + 1) for x in range(west, east + 1) for k in self.cells.get((y, x), ()))

    def add(self, lat: float, lon: float, n: int) -> int:
        """Puts a visit to the nearest spot within reach, whose centre moves, or to a new one; gives its number."""
        near = self._around(lat, lon)
        if near:
            c = np.array([self.centres[k] for k in near])
            away = np.hypot(c[:, 0] - lat, (c[:, 1] - lon) * math.cos(math.radians(lat))) * METRES_PER_DEGREE
            best = int(np.argmin(away))
            if away[best] <= self.within_m:
                spot = self.centres[near[best]]
                old = self._cell(spot[0], spot[1])
                total = spot[2] + n
                spot[:] = [(spot[0] * spot[2] + lat * n) / total, (spot[1] * spot[2] + lon * n) / total, total]
                if (new := self._cell(spot[0], spot[1])) != old:
                    self.cells[old].remove(near[best])
                    self.cells.setdefault(new, []).append(near[best])
                return near[best]
        self.centres.append([lat, lon, n])
        self.cells.setdefault(self._cell(lat, lon), []).append(len(self.centres) - 1)
        return len(self.centres) - 1


def shared_spots(stops: list[tuple[float, float, int]], within_m: float, cell_m: float = StopRule.cell_m) -> list[tuple[float, float]]:
    """Centre of each stop (lat, lon, pings): the mean over all stops near the same centre, weighted by pings."""
    if not stops:
        return []
    base, grid = stops[0][1], _SpotGrid(within_m, cell_m)
    of = [grid.add(lat, base + (lon - base + 180) % 360 - 180, n) for lat, lon, n in stops]
    return [(float(grid.centres[k][0]), float((grid.centres[k][1] + 180) % 360 - 180)) for k in of]


class _Stitcher:
    """Turns one participant's tokens, in time order, into stops and trips; holds the stops alone."""

    def __init__(self, who: str, rule: StopRule):
        self.who, self.rule = who, rule
        self.open: dict | None = None
        self.pending = 0
        self.stop: dict | None = None  # the last finished stop
        self.gap, self.path, self.seen, self.at = 0, 0.0, None, None
        self.rows: list[tuple] = []
        self.stops: list[tuple[float, float, int]] = []

    def _finish(self) -> None:
        run, rule = self.open, self.rule
        self.open, self.pending = None, 0
        if run is None:
            return
        if run["s1"] - run["s0"] < rule.min_stop_ms:
            self.gap = max(self.gap, run["gap"])
            self.path += run["path"]
            return
        stop = {"lat": run["lat"] / run["n"], "lon": (run["lon"] / run["n"] + 180) % 360 - 180, "k": len(self.stops), **{k: run[k] for k in ("s0", "s1")}}
        self.stops.append((stop["lat"], stop["lon"], run["n"]))
        if self.stop and self.gap <= rule.silence_ms and distance_m(self.stop["lat"], self.stop["lon"], stop["lat"], stop["lon"]) > rule.radius_m:
            self.rows.append(("trip", self.stop["s1"], stop["s0"], run["fixes_before"], self.path, self.stop["k"], stop["k"]))
        self.rows.append(("stop", stop["s0"], stop["s1"], run["n"], 0.0, stop["k"], stop["k"]))
        self.stop, self.gap, self.path, self.fixes = stop, run["gap_after"], run["path_after"], 0

    fixes = 0

    def _travel(self, token: tuple) -> tuple[int, float]:
        """Silence and distance from what was seen last to this token."""
        t0, t1, lat0, lon0, lat1, lon1 = token[2], token[3], token[9], token[10], token[11], token[12]
        gap = 0 if self.seen is None else t0 - self.seen
        link = 0.0 if self.at is None else distance_m(*self.at, lat0, lon0)
        self.seen, self.at = t1 if self.seen is None else max(self.seen, t1), (lat1, lon1)
        return gap, link

    def add(self, token: tuple) -> None:
        moving, barrier, t0, t1, s0, s1, n, lat, lon, lat0, lon0, lat1, lon1, path, inner = token
        rule, run = self.rule, self.open
        if not moving and not barrier and run and t0 - run["t1"] <= rule.silence_ms:
            if distance_m(run["lat"] / run["n"], run["lon"] / run["n"], lat, lon) <= rule.radius_m:
                self._travel(token)
                run["lon"] += (run["lon"] / run["n"] + (lon - run["lon"] / run["n"] + 180) % 360 - 180) * n
                run["lat"] += lat * n
                run["n"] += n
                run["t1"], run["s1"], run["gap_after"], run["path_after"], self.pending = t1, s1, 0, 0.0, 0
                return
            if n + self.pending < rule.leave_fixes:
                self.pending += n
                at = self.at
                gap, _ = self._travel(token)
                self.at = at  # a stray ping is no part of the path
                run["gap_after"] = max(run["gap_after"], gap, inner)
                return
        self._finish()
        gap, link = self._travel(token)
        self.gap, self.path = max(self.gap, gap), self.path + link
        if moving:
            self.gap, self.path = max(self.gap, inner), self.path + path
            self.fixes += n
            return
        self.open = {"t1": t1, "s0": s0, "s1": s1, "n": n, "lat": lat * n, "lon": lon * n, "gap": inner, "path": path, "gap_after": 0, "path_after": 0.0, "fixes_before": self.fixes}
        if s1 - s0 < rule.min_stop_ms:
            self.fixes += n

    def end(self) -> list[tuple]:
        """The participant's rows, the visits of one spot given their common centre."""
        self._finish()
        spots = shared_spots(self.stops, self.rule.same_spot_m, self.rule.cell_m)
        return [(self.who, *row[:5], *spots[row[5]], *spots[row[6]]) for row in self.rows]


def _second_level(rule: StopRule) -> Callable:
    names = [x.split()[0] for x in _ROW_DDL.split(", ")]
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), *[pa.float64()] * 5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stitcher: _Stitcher | None = None
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        for batch in batches:
            for who, *token in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if stitcher is None or stitcher.who != who:
                    if stitcher and (rows := stitcher.end()):
                        yield pack(rows)
                    stitcher = _Stitcher(who, rule)
                stitcher.add(tuple(token))
        if stitcher and (rows := stitcher.end()):
            yield pack(rows)

    return run


def clean_fixes(gps: DataFrame, rule: StopRule = StopRule()) -> DataFrame:
    """``participant, t, lat, lon, accuracy`` of the usable pings; longitudes in [-180, 180).

    Left out: null or NaN participant, instant or position, positions off the globe or at exactly
    (0, 0), clocks before ``earliest_ms`` and accuracies over ``max_accuracy_m``; an unknown
    accuracy is kept.
    """
    lat, lon = F.col("latitude"), F.col("longitude")
    fixes = gps.select("participant", sensor_instant().alias("t"), lat.alias("lat"), lon.alias("lon"), "accuracy")
    lat, lon = F.col("lat"), F.col("lon")
    return fixes.where(
        F.col("participant").isNotNull() & (F.col("t") >= rule.earliest_ms) & lat.between(-90, 90) & lon.between(-360, 360)
        & ~((lat == 0) & (lon == 0)) & (F.col("accuracy").isNull() | F.isnan("accuracy") | (F.col("accuracy") <= rule.max_accuracy_m))
    ).withColumn("lon", wrap_longitude(lon))


def stops_and_trips(gps: DataFrame, rule: StopRule = StopRule()) -> DataFrame:
    """``participant, kind, start_ms, end_ms, n_fixes, distance_m, from_lat, from_lon, to_lat, to_lon``.

    A "stop" is a stay of at least ``min_stop_ms`` within about ``radius_m`` of one spot, from its
    first to its last ping; a "trip" leads from a stop to the participant's next one at another
    spot without a silence of more than ``silence_ms`` between; ``distance_m`` sums the
    great-circle steps of the trip. Visits of one participant within ``same_spot_m`` of each other
    share the mean of all their pings as their spot, as single visits wander. Repeated pings count once: of one instant the most accurate,
    then the southernmost, then the westernmost. Unusable pings (see ``clean_fixes``) don't
    count; an empty table gives an empty result; extra columns are ignored.
    """
    fixes = clean_fixes(gps, rule).withColumn("bucket", F.floor(F.col("t") / F.lit(rule.bucket_ms)).cast("long"))
    rank = F.coalesce("accuracy", F.lit(float("inf")))
    tokens = (
        sorted_groups(fixes.select("participant", "bucket", "t", "lat", "lon", rank.alias("rank")), ["participant", "bucket"], "t", "rank", "lat", "lon")
        .drop("rank")
        .mapInArrow(_first_level(rule), _TOKEN_DDL)
    )
    return sorted_groups(tokens, ["participant"], "t0").mapInArrow(_second_level(rule), _ROW_DDL)
