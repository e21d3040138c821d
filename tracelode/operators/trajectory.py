"""From averaged positions to flights and pauses, and statistics of such trajectories.

A trajectory is a table ``participant, status, lat0, lon0, t0, lat1, lon1, t1, obs`` ordered by
``t0`` (epoch seconds); status 1 is a flight, 2 a pause, 3 a single unknown position.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from datetime import datetime
from zoneinfo import ZoneInfo

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.functions.arrow_groups import key_runs, sorted_groups, to_batch
from tracelode.functions.geo import EARTH_RADIUS_M
from tracelode.operators.mobility import chunks, collapse

FLIGHT, PAUSE, UNKNOWN = 1, 2, 3
TRAJECTORY_DDL = "participant string, status int, lat0 double, lon0 double, t0 double, lat1 double, lon1 double, t1 double, obs int"
_TRAJECTORY = pa.schema([("participant", pa.string()), ("status", pa.int32()), *[(n, pa.float64()) for n in ("lat0", "lon0", "t0", "lat1", "lon1", "t1")], ("obs", pa.int32())])
STATUS, LAT0, LON0, T0, LAT1, LON1, T1, OBS = range(8)


def arc_m(lat0, lon0, lat1, lon1):
    """Great-circle distance by the law of cosines, for numbers and arrays."""
    a, b = np.radians(lat0), np.radians(lat1)
    c = np.cos(a) * np.cos(b) * np.cos(np.radians(lon0) - np.radians(lon1)) + np.sin(a) * np.sin(b)
    return np.arccos(np.clip(c, -1, 1)) * EARTH_RADIUS_M


def off_circle_m(lat: np.ndarray, lon: np.ndarray, a: int, b: int) -> np.ndarray:
    """Distance of all points from the great circle through points ``a`` and ``b``; 0 if those coincide."""
    if abs(lat[a] - lat[b]) < 1e-6 and abs(lon[a] - lon[b]) < 1e-6:
        return np.zeros(len(lat))
    p, q = np.radians(lat), np.radians(lon)
    v = np.stack([np.cos(p) * np.cos(q), np.cos(p) * np.sin(q), np.sin(p)], axis=1)
    normal = np.cross(v[a], v[b])
    normal = normal / (np.linalg.norm(normal) + 1e-6)
    return np.abs(math.pi / 2 - np.arccos(np.clip(v @ normal, -1, 1))) * EARTH_RADIUS_M


def widest_m(lat: np.ndarray, lon: np.ndarray, stop_at: float = math.inf) -> float:
    """Greatest pairwise distance; returns early once ``stop_at`` is reached."""
    best = 0.0
    for i in range(len(lat) - 1):
        best = max(best, float(arc_m(lat[i], lon[i], lat[i + 1 :], lon[i + 1 :]).max()))
        if best >= stop_at:
            break
    return best


def knots(lat: np.ndarray, lon: np.ndarray, w: float, h: float) -> list[int]:
    """Indexes where a chunk breaks: its ends, the ends of pauses, and wherever it bends by ``w`` or more.

    A pause is a run of two or more steps below ``h``. A stretch up to the chunk's end is tested
    without the end itself.
    """
    n = len(lat)
    still = arc_m(lat[:-1], lon[:-1], lat[1:], lon[1:]) < h
    edge = np.flatnonzero(np.diff(np.r_[0, still.view(np.int8), 0]))
    found = {0, n - 1}
    for start, stop in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        if stop - start >= 2:
            found |= {start, stop}
    return bends(lat, lon, sorted(found), w)


def bends(lat: np.ndarray, lon: np.ndarray, seeds: list[int], w: float) -> list[int]:
    """``seeds`` and the points between two of them that lie ``w`` or more off the great circle through their ends, again and again."""
    n, found = len(lat), set(seeds)
    todo = list(zip(seeds, seeds[1:], strict=False))
    while todo:
        a, b = todo.pop()
        last = min(b, n - 2)
        if last - a < 2:
            continue
        away = off_circle_m(lat[a : last + 1], lon[a : last + 1], 0, last - a)
        k = a + int(np.argmax(away))
        if away.max() >= w and a < k < last:
            found.add(k)
            todo += [(a, k), (k, b)]
    return sorted(found)


def chunk_rows(t: np.ndarray, lat: np.ndarray, lon: np.ndarray, interval: float, r: float, w: float, h: float) -> list[list[float]]:
    """Flights and pauses of one gap-free chunk."""
    half = interval / 2
    if len(t) == 1:
        return [[UNKNOWN, lat[0], lon[0], t[0] - half, math.nan, math.nan, t[0] + half, 1]]
    if widest_m(lat, lon, r) < r:
        x, y = (lat[0] + lat[-1]) / 2, (lon[0] + lon[-1]) / 2
        return [[PAUSE, x, y, t[0] - half, x, y, t[-1] + half, 1]]
    still = arc_m(lat[:-1], lon[:-1], lat[1:], lon[1:]) < h
    out = []
    at = knots(lat, lon, w, h)
    for a, b in zip(at, at[1:], strict=False):
        if still[a:b].all():
            x, y = (lat[a] + lat[b]) / 2, (lon[a] + lon[b]) / 2
            out.append([PAUSE, x, y, t[a], x, y, t[b], 1])
        else:
            out.append([FLIGHT, lat[a], lon[a], t[a], lat[b], lon[b], t[b], 1])
    return out


def settle_unknown(rows: list[list[float]], interval: float, r: float) -> None:
    """Turns single positions into pauses or short flights by the nearer neighbour in time; edits in place."""
    wrap = lambda lon: (lon + 180) % 360 - 180
    reach, half = 3 * interval, interval / 2
    for i, row in enumerate(rows):
        if row[STATUS] != UNKNOWN:
            continue
        lat, lon = row[LAT0], row[LON0]
        row[STATUS], row[LAT1], row[LON1] = PAUSE, lat, lon
        if i == 0:
            continue
        prev = rows[i - 1]
        later = rows[i + 1] if i + 1 < len(rows) else None
        if row[T0] - prev[T1] <= reach:
            away, span = (lat - prev[LAT1], lon - prev[LON1]), row[T0] - prev[T1]
            near = arc_m(lat, lon, prev[LAT1], prev[LON1]) < r
        elif later is not None and later[T0] - row[T1] <= reach:
            away, span = (later[LAT0] - lat, later[LON0] - lon), later[T0] - row[T1]
            near = arc_m(lat, lon, later[LAT0], later[LON0]) < r
        else:
            continue
        if not near and span > 0:
            dx, dy = away[0] / span * half, away[1] / span * half
            row[STATUS] = FLIGHT
            row[LAT0], row[LON0], row[LAT1], row[LON1] = lat - dx, wrap(lon - dy), lat + dx, wrap(lon + dy)


def merge_touching_pauses(rows: list[list[float]]) -> list[list[float]]:
    out: list[list[float]] = []
    run: list[list[float]] = []

    def flush() -> None:
        if len(run) > 1:
            x, y = (float(np.mean([r[k] for r in run])) for k in (LAT0, LON0))
            out.append([PAUSE, x, y, run[0][T0], x, y, run[-1][T1], 1])
        else:
            out.extend(run)
        run.clear()

    for row in rows:
        if run and not (row[STATUS] == PAUSE and row[T0] == run[-1][T1]):
            flush()
        if row[STATUS] == PAUSE:
            run.append(row)
        else:
            out.append(row)
    flush()
    return out


def close_small_gaps(rows: list[list[float]], within_m: float = 10.0) -> list[list[float]]:
    """Aligns neighbours of a gap that are within ``within_m`` and gives the pauses that fill such gaps."""
    fills = []
    for a, b in zip(rows, rows[1:], strict=False):
        if not (b[T0] > a[T1] and arc_m(b[LAT0], b[LON0], a[LAT1], a[LON1]) < within_m):
            continue
        kinds = (a[STATUS], b[STATUS])
        if kinds == (PAUSE, PAUSE):
            for row in (a, b):
                row[LAT0], row[LON0], row[LAT1], row[LON1] = a[LAT1], a[LON1], a[LAT1], a[LON1]
        elif kinds == (PAUSE, FLIGHT):
            b[LAT0], b[LON0] = a[LAT1], a[LON1]
        elif kinds == (FLIGHT, PAUSE):
            a[LAT1], a[LON1] = b[LAT0], b[LON0]
        else:
            a[LAT1] = b[LAT0] = (a[LAT1] + b[LAT0]) / 2
            a[LON1] = b[LON0] = (a[LON1] + b[LON0]) / 2
        fills.append([PAUSE, b[LAT0], b[LON0], a[T1], b[LAT0], b[LON0], b[T0], 0])
    return fills


def infer(rows: list[list[float]], interval: float, r: float) -> list[list[float]]:
    """A participant's finished trajectory from the rows of its chunks in time order."""
    rows = [list(x) for x in rows]
    settle_unknown(rows, interval, r)
    rows = merge_touching_pauses(rows)
    fills = close_small_gaps(rows)
    for a, b in zip(rows, rows[1:], strict=False):
        if b[T0] == a[T1]:
            if (a[STATUS], b[STATUS]) == (PAUSE, FLIGHT):
                b[LAT0], b[LON0] = a[LAT1], a[LON1]
            elif (a[STATUS], b[STATUS]) == (FLIGHT, PAUSE):
                a[LAT1], a[LON1] = b[LAT0], b[LON0]
    return sorted(rows + fills, key=lambda x: x[T0])


def _chunked(interval: float, r: float, w: float, h: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for (who, _), (_, t, lat, lon) in key_runs(batches, 2):
            rows += [(who, int(x[0]), *[float(v) for v in x[1:7]], 1) for x in chunk_rows(t, lat, lon, interval, r, w, h)]
            if len(rows) > 20_000:
                yield to_batch(rows, _TRAJECTORY)
                rows = []
        yield to_batch(rows, _TRAJECTORY)

    return run


def _per_participant(work: Callable[[str, np.ndarray], list], schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for (who,), columns in key_runs(batches, 1):
            rows += [(who, *x) for x in work(who, np.stack([c.astype(float) for c in columns], axis=1))]
            if len(rows) > 20_000:
                yield to_batch(rows, schema)
                rows = []
        yield to_batch(rows, schema)

    return run


def by_participant(trajectory: DataFrame, work: Callable[[str, np.ndarray], list], schema: pa.Schema, ddl: str) -> DataFrame:
    """Applies ``work`` to each participant's ordered trajectory (columns status to obs)."""
    ordered = sorted_groups(trajectory, ["participant"], "t0").select(*TRAJECTORY_DDL.replace(",", " ").split()[::2])
    return ordered.mapInArrow(_per_participant(work, schema), ddl)


def flights(fixes: DataFrame, interval: int = 10, r: float = 10.0, w: float = 20.0, h: float = 10.0) -> DataFrame:
    """Rows of all chunks of ``participant, t, lat, lon`` fixes; single positions have status 3 and no end position."""
    rows = chunks(collapse(fixes, interval)).select("participant", "chunk", "bin", "t", "lat", "lon")
    found = sorted_groups(rows, ["participant", "chunk"], "bin").mapInArrow(_chunked(interval, r, w, h), TRAJECTORY_DDL)
    return found.withColumns({c: F.nullif(F.col(c), F.lit(math.nan)) for c in ("lat1", "lon1")})


def trajectories(fixes: DataFrame, interval: int = 10, r: float = 10.0, w: float = 20.0, h: float = 10.0) -> DataFrame:
    """Finished trajectories: flights, pauses and the pauses that fill small gaps (obs 0).

    Empty input gives an empty result; the fixes of one participant must be distinct in time.
    """
    typed = lambda rows: [(int(x[0]), *map(float, x[1:7]), int(x[7])) for x in rows]
    return by_participant(flights(fixes, interval, r, w, h), lambda _, rows: typed(infer(rows.tolist(), interval, r)), _TRAJECTORY, TRAJECTORY_DDL)


def significant_places(rows: np.ndarray, threshold_m: float) -> list[list[float]]:
    """Online clusters of pauses: [lat, lon, visits, seconds], in order of their first visit.

    A pause within ``threshold_m`` of the nearest centre joins it and moves it to the mean of its
    visits; else it begins a new one.
    """
    places: list[list[float]] = []
    for row in rows:
        lat, lon, s = row[LAT0], row[LON0], row[T1] - row[T0]
        if places:
            away = arc_m(lat, lon, np.array([p[0] for p in places]), np.array([p[1] for p in places]))
            k = int(np.argmin(away))
            if away[k] <= threshold_m:
                p = places[k]
                p[0], p[1] = (p[0] * p[2] + lat) / (p[2] + 1), (p[1] * p[2] + lon) / (p[2] + 1)
                p[2], p[3] = p[2] + 1, p[3] + s
                continue
        places.append([lat, lon, 1, s])
    return places


def local_hours(t: np.ndarray, zone: str) -> np.ndarray:
    """Local hour of each instant; offsets are looked up once per quarter of an hour."""
    tz = ZoneInfo(zone)
    quarters, back = np.unique(np.floor(np.asarray(t, float) / 900), return_inverse=True)
    offsets = np.array([datetime.fromtimestamp(q * 900, tz).utcoffset().total_seconds() for q in quarters])
    return ((t + offsets[back]) % 86_400 // 3600).astype(int) if len(back) else np.zeros(0, int)


def home_of(rows: np.ndarray, zone: str = "UTC", threshold_m: float = 20.0) -> tuple[float, float] | None:
    """The most visited place of the observed pauses with mid-hours from 19 to 9; None without any."""
    rows = rows[(rows[:, STATUS] == PAUSE) & (rows[:, OBS] == 1)]
    hours = local_hours((rows[:, T0] + rows[:, T1]) / 2, zone)
    places = significant_places(rows[(hours <= 9) | (hours >= 19)], threshold_m)
    return (lambda p: (p[0], p[1]))(max(places, key=lambda p: p[2])) if places else None


def stretched(rows: np.ndarray, start: float, end: float) -> np.ndarray:
    """The rows that overlap a bin, the first and last set to its edges on their own lines.

    A row that is lengthened by that is no longer observed.
    """
    rows = rows[(rows[:, T0] < end) & (rows[:, T1] > start)].copy()
    if not len(rows):
        return rows
    first, last = rows[0].copy(), rows[-1].copy()
    for row, at, k in ((0, start, LAT0), (-1, end, LAT1)):
        x = first if row == 0 else last
        share = (at - x[T0]) / (x[T1] - x[T0])
        rows[row, k] = x[LAT0] + (x[LAT1] - x[LAT0]) * share
        rows[row, k + 1] = x[LON0] + (x[LON1] - x[LON0]) * share
        rows[row, k + 2] = at
        if share < 0 or share > 1:
            rows[row, OBS] = 0
    return rows


DAILY = ("obs_duration", "obs_day", "obs_night", "home_time", "dist_traveled", "max_dist_home", "radius", "diameter", "num_sig_places", "entropy",
         "total_flight_time", "av_flight_length", "sd_flight_length", "av_flight_duration", "sd_flight_duration", "total_pause_time", "av_pause_duration", "sd_pause_duration")


def bin_statistics(rows: np.ndarray, home: tuple[float, float], zone: str = "UTC") -> dict[str, float | None]:
    """Statistics of the rows of one bin, in seconds and metres; only obs_duration (0) without rows."""
    if not len(rows):
        return {n: None for n in DAILY} | {"obs_duration": 0.0, "obs_day": 0.0, "obs_night": 0.0}
    s = rows[:, T1] - rows[:, T0]
    seen = rows[:, OBS] == 1
    hours = local_hours((rows[:, T0] + rows[:, T1]) / 2, zone)
    day = (hours >= 8) & (hours <= 19)
    from_home = np.stack([arc_m(*home, rows[:, LAT0], rows[:, LON0]), arc_m(*home, rows[:, LAT1], rows[:, LON1])])
    moved = np.round(arc_m(rows[:, LAT1], rows[:, LON1], rows[:, LAT0], rows[:, LON0]))
    flight, pause = rows[:, STATUS] == FLIGHT, rows[:, STATUS] == PAUSE
    mean = lambda v: float(v.mean()) if len(v) else 0.0
    dev = lambda v: float(v.std()) if len(v) else 0.0
    out = {
        "obs_duration": float(s[seen].sum()), "obs_day": float(s[seen & day].sum()), "obs_night": float(s[seen & ~day].sum()),
        "home_time": float(s[from_home.mean(axis=0) <= 50].sum()), "dist_traveled": float(moved.sum()), "max_dist_home": float(from_home.max()),
        "diameter": widest_m(rows[:, LAT0], rows[:, LON0]), "total_flight_time": float(s[flight].sum()),
        "av_flight_length": mean(moved[flight]), "sd_flight_length": dev(moved[flight]), "av_flight_duration": mean(s[flight]), "sd_flight_duration": dev(s[flight]),
        "total_pause_time": float(s[pause].sum()), "av_pause_duration": mean(s[pause]), "sd_pause_duration": dev(s[pause]),
    }
    at, w = rows[pause], s[pause]
    radius = 0.0
    if w.sum() > 0:
        centre = (w @ at[:, LAT0] / w.sum(), w @ at[:, LON0] / w.sum())
        radius = float(w @ arc_m(*centre, at[:, LAT0], at[:, LON0]) / w.sum())
    long = np.array([p[3] for p in significant_places(at, 50.0) if p[3] > 900])
    share = long / long.sum() if len(long) else long
    out |= {"radius": radius, "num_sig_places": float(len(long)), "entropy": float(-(share * np.log(share + 0.00001)).sum()) if len(long) > 1 else 0.0}
    return out


def summary(trajectory: DataFrame, width_s: int = 86_400, zone: str = "UTC", home_at: tuple[float, float] | None = None) -> DataFrame:
    """Statistics per participant and bin of ``width_s`` from the local start of the first day (or hour).

    Seconds and metres. Bins without rows show 0 observed seconds and nulls; participants
    without night pauses have no home and are left out, unless ``home_at`` states one for all.
    """
    daily = width_s == 86_400
    names = ("bin_start", *DAILY)
    schema = pa.schema([("participant", pa.string()), *[(n, pa.float64()) for n in names]])

    def work(_: str, rows: np.ndarray) -> list:
        home = home_at or home_of(rows, zone)
        if home is None:
            return []
        tz = ZoneInfo(zone)
        floor = lambda t: datetime.fromtimestamp(t, tz).replace(minute=0, second=0, microsecond=0, **({"hour": 0} if daily else {})).timestamp()
        start, end = floor(rows[0, T0]), floor(rows[-1, T1]) + (width_s if daily else 0)
        out = []
        low = 0
        for k in range(max(0, int((end - start) // width_s))):
            a, b = start + k * width_s, start + (k + 1) * width_s
            while low < len(rows) and rows[low, T1] <= a:
                low += 1
            high = low + int(np.searchsorted(rows[low:, T0], b))
            got = bin_statistics(stretched(rows[low:high], a, b), home, zone)
            out.append((a, *[got[n] for n in DAILY]))
        return out

    return by_participant(trajectory, work, schema, "participant string, " + ", ".join(f"{n} double" for n in names))


def homes(trajectory: DataFrame, zone: str = "UTC") -> DataFrame:
    """``participant, lat, lon``: the home of each participant that has night pauses."""
    schema = pa.schema([("participant", pa.string()), ("lat", pa.float64()), ("lon", pa.float64())])
    return by_participant(trajectory, lambda _, rows: [h] if (h := home_of(rows, zone)) else [], schema, "participant string, lat double, lon double")


def merged_pauses(rows: np.ndarray, home: tuple[float, float], radius_m: float) -> list[list[float]]:
    """[lat, lon, minutes] of the pauses beyond twice ``radius_m`` from home; one within that of an earlier place adds its minutes to the nearest."""
    out: list[list[float]] = []
    for row in rows:
        lat, lon, minutes = row[LAT0], row[LON0], (row[T1] - row[T0]) / 60
        if arc_m(lat, lon, *home) <= 2 * radius_m:
            continue
        away = arc_m(lat, lon, np.array([p[0] for p in out]), np.array([p[1] for p in out])) if out else np.zeros(0)
        if len(away) and away.min() <= 2 * radius_m:
            out[int(np.argmin(away))][2] += minutes
        else:
            out.append([lat, lon, minutes])
    return out


def pause_places(trajectory: DataFrame, radius_m: float = 7.5, zone: str = "UTC") -> DataFrame:
    """``participant, place, lat, lon, minutes`` of ``merged_pauses``: what a map is asked about; participants without a home are left out."""
    schema = pa.schema([("participant", pa.string()), ("place", pa.int64()), ("lat", pa.float64()), ("lon", pa.float64()), ("minutes", pa.float64())])

    def work(_: str, rows: np.ndarray) -> list:
        home = home_of(rows, zone)
        return [] if home is None else [(i, *map(float, p)) for i, p in enumerate(merged_pauses(rows[rows[:, STATUS] == PAUSE], home, radius_m))]

    return by_participant(trajectory, work, schema, "participant string, place long, lat double, lon double, minutes double")


def places(trajectory: DataFrame, threshold_m: float = 50.0) -> DataFrame:
    """``participant, place, lat, lon, visits, seconds`` of the clusters of each participant's pauses."""
    schema = pa.schema([("participant", pa.string()), ("place", pa.int64()), ("lat", pa.float64()), ("lon", pa.float64()), ("visits", pa.int64()), ("seconds", pa.float64())])
    found = lambda rows: [(i, p[0], p[1], int(p[2]), float(p[3])) for i, p in enumerate(significant_places(rows[rows[:, STATUS] == PAUSE], threshold_m))]
    return by_participant(trajectory, lambda _, rows: found(rows), schema, "participant string, place long, lat double, lon double, visits long, seconds double")


def split_summary(trajectory: DataFrame, zone: str = "UTC", day_from: int = 8, day_to: int = 20) -> DataFrame:
    """Daily statistics for the day (local ``day_from`` to ``day_to``) and the night pieces around it, side by side."""
    names = ["bin_start", *[f"{n}_daytime" for n in DAILY], *[f"{n}_nighttime" for n in DAILY]]
    schema = pa.schema([("participant", pa.string()), *[(n, pa.float64()) for n in names]])

    def work(_: str, rows: np.ndarray) -> list:
        home = home_of(rows, zone)
        if home is None:
            return []
        tz = ZoneInfo(zone)
        start = datetime.fromtimestamp(rows[0, T0], tz).replace(hour=0, minute=0, second=0, microsecond=0)
        out = []
        for k in range(int((rows[-1, T1] - start.timestamp()) // 86_400) + 1):
            a = start.timestamp() + k * 86_400
            b, local = a + 86_400, datetime.fromtimestamp(a, tz)
            morning, evening = (local.replace(hour=h).timestamp() for h in (day_from, day_to))
            day = bin_statistics(stretched(rows, morning, evening), home, zone)
            night = bin_statistics(np.concatenate([stretched(rows, a, morning), stretched(rows, evening, b)]), home, zone)
            out.append((a, *[day[n] for n in DAILY], *[night[n] for n in DAILY]))
        return out

    return by_participant(trajectory, work, schema, "participant string, " + ", ".join(f"{n} double" for n in names))


def agreement(mine: np.ndarray, other: np.ndarray, start: float, end: float, within_m: float = 10.0) -> float:
    """Share of the seconds in [start, end) when both rest that are spent within ``within_m``; 0 if there are none."""
    common = near = 0.0
    ends = np.maximum.accumulate(other[:, T1]) if len(other) else other
    for row in mine:
        a, b = max(row[T0], start), min(row[T1], end)
        if b <= a or not len(other):
            continue
        for k in range(int(np.searchsorted(ends, a, "right")), int(np.searchsorted(other[:, T0], b, "left"))):
            s = min(b, other[k, T1]) - max(a, other[k, T0])
            if s > 0:
                common += s
                near += s * bool(arc_m(row[LAT0], row[LON0], other[k, LAT0], other[k, LON0]) <= within_m)
    return near / common if common else 0.0


def routine_of(rows: np.ndarray, start: float, end: float, window: int = 14, stratified: bool = False, zone: str = "UTC") -> float:
    """Mean agreement of a day with up to ``window`` days before and after it (Canzian and Musolesi 2015).

    Pauses are compared as intervals, so every second counts. Stratified, only days of the same
    kind (weekday or weekend) are compared; the divisor stays the number of days on either side.
    """
    rest = rows[rows[:, STATUS] == PAUSE]
    if not len(rest):
        return 0.0
    first, last = rest[0, T0], rest[:, T1].max()
    low, high = max(start, first), min(end, last)
    before, after = (min(round(x / 86_400), window) for x in (low - first, last - high))
    if max(before, after) <= 0:
        return 0.0
    shifts = [*range(1, before + 1), *range(-after, 0)]
    if stratified:
        weekend = lambda t: datetime.fromtimestamp(t, ZoneInfo(zone)).weekday() >= 5
        middle = (low + high) / 2
        shifts = [s for s in shifts if weekend(middle - s * 86_400) == weekend(middle)]
    total = 0.0
    for s in shifts:
        moved = rest.copy()
        moved[:, [T0, T1]] += s * 86_400
        total += agreement(rest, moved, low, high)
    return total / (before + after)


def routine(trajectory: DataFrame, zone: str = "UTC", window: int = 14) -> DataFrame:
    """``participant, bin_start, routine, routine_stratified`` of each local day of a trajectory."""
    schema = pa.schema([("participant", pa.string()), *[(n, pa.float64()) for n in ("bin_start", "routine", "routine_stratified")]])

    def work(_: str, rows: np.ndarray) -> list:
        start = datetime.fromtimestamp(rows[0, T0], ZoneInfo(zone)).replace(hour=0, minute=0, second=0, microsecond=0).timestamp()
        days = [start + k * 86_400 for k in range(int((rows[-1, T1] - start) // 86_400) + 1)]
        return [(a, routine_of(rows, a, a + 86_400, window), routine_of(rows, a, a + 86_400, window, True, zone)) for a in days]

    return by_participant(trajectory, work, schema, "participant string, bin_start double, routine double, routine_stratified double")
