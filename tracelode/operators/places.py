"""Time at places of interest: overlap of pause circles with place circles and polygons."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.functions.arrow_groups import to_batch
from tracelode.functions.geo import EARTH_RADIUS_M

#: Degrees of a grid cell; a place is listed in every cell its padded box touches.
CELL = 0.005
METRES = EARTH_RADIUS_M * math.pi / 180


def plane(points: np.ndarray, lat: float, lon: float) -> np.ndarray:
    """(lat, lon) rows as metres east and north of a centre."""
    return np.stack([(points[:, 1] - lon) * METRES * math.cos(math.radians(lat)), (points[:, 0] - lat) * METRES], axis=1)


def area(polygon: np.ndarray) -> float:
    """Area of a simple polygon."""
    x, y = polygon[:, 0], polygon[:, 1]
    return abs(float(x @ np.roll(y, -1) - y @ np.roll(x, -1))) / 2 if len(polygon) > 2 else 0.0


def polygon_in_circle(polygon: np.ndarray, radius: float) -> float:
    """Area that a polygon shares with the circle about the origin, exactly.

    Every edge adds the signed area of the circle's share of its triangle with the centre: the
    part of the edge inside the circle gives a triangle, the parts outside give sectors.
    """
    p, q = polygon, np.roll(polygon, -1, axis=0)
    d = q - p
    a = np.maximum((d * d).sum(axis=1), 1e-18)
    half_b, c = (p * d).sum(axis=1), (p * p).sum(axis=1) - radius**2
    root = np.sqrt(np.maximum(half_b**2 - a * c, 0))
    low, high = (np.clip(v, 0, 1) for v in ((-half_b - root) / a, (-half_b + root) / a))
    m, n = p + low[:, None] * d, p + high[:, None] * d
    cross = lambda u, v: u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]
    turn = lambda u, v: np.arctan2(cross(u, v), (u * v).sum(axis=1))
    return abs(float((cross(m, n) + radius**2 * (turn(p, m) + turn(n, q))).sum())) / 2


def circles_area(distance: float, r: float, s: float) -> float:
    """Area that two circles share."""
    if distance >= r + s:
        return 0.0
    if distance <= abs(r - s):
        return math.pi * min(r, s) ** 2
    x, y = (distance**2 + r**2 - s**2) / (2 * distance), (distance**2 + s**2 - r**2) / (2 * distance)
    return r**2 * math.acos(x / r) - x * math.sqrt(max(r**2 - x**2, 0)) + s**2 * math.acos(y / s) - y * math.sqrt(max(s**2 - y**2, 0))


def overlap_m2(lat: float, lon: float, radius: float, place: np.ndarray, place_radius: float) -> float:
    """Area that a pause circle shares with a place: a circle about a single point, else a polygon."""
    local = plane(place, lat, lon)
    if len(local) < 3:
        return circles_area(float(np.hypot(*local[0])), radius, place_radius)
    return polygon_in_circle(local, radius)


_PAIR = pa.schema([("pause_id", pa.int64()), ("place_id", pa.int64()), ("kind", pa.string()), ("m2", pa.float64())])


def _overlaps(radius: float, place_radius: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for pause, lat, lon, place, kind, shape in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                m2 = overlap_m2(lat, lon, radius, np.array(shape, float).reshape(-1, 2), place_radius)
                if m2 > 1e-6:
                    rows.append((pause, place, kind, m2))
            yield to_batch(rows, _PAIR)

    return run


def place_overlaps(pauses: DataFrame, places: DataFrame, radius: float = 50.0, place_radius: float = 7.5) -> DataFrame:
    """``pause_id, place_id, kind, m2`` of pauses (pause_id, lat, lon) and places (place_id, kind, shape) that meet.

    ``shape`` is an array of [lat, lon]: one point or a polygon. Both sides meet in an equi-join on
    grid cells: a pause lies in one, a place in all that its padded box touches. Null positions
    and empty shapes meet nothing.
    """
    pad = (radius + 2 * place_radius) / METRES
    lats, lons = F.transform("shape", lambda p: p[0]), F.transform("shape", lambda p: p[1])
    widen = pad / F.cos(F.radians(F.least(F.array_max(F.transform(lats, F.abs)), F.lit(85.0))))
    cells = lambda low, high: F.explode(F.sequence(F.floor(low / CELL), F.floor(high / CELL)))
    spread = places.where(F.size("shape") > 0).select("place_id", "kind", "shape", cells(F.array_min(lats) - pad, F.array_max(lats) + pad).alias("cy"), (F.array_min(lons) - widen).alias("_w"), (F.array_max(lons) + widen).alias("_e"))
    spread = spread.select("place_id", "kind", "shape", "cy", cells(F.col("_w"), F.col("_e")).alias("cx"))
    at = pauses.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select("pause_id", "lat", "lon", F.floor(F.col("lat") / CELL).alias("cy"), F.floor(F.col("lon") / CELL).alias("cx"))
    pairs = at.join(spread, ["cy", "cx"]).select("pause_id", "lat", "lon", "place_id", "kind", "shape")
    return pairs.mapInArrow(_overlaps(radius, place_radius), "pause_id long, place_id long, kind string, m2 double")


def place_times(pauses: DataFrame, overlaps: DataFrame) -> DataFrame:
    """``participant, kind, minutes, minutes_adjusted``: time by the kind with most overlap, and shared in proportion.

    ``pauses``: participant, pause_id, seconds. Pauses that meet no place count as "other"; of kinds with
    the same overlap (to a thousandth of a square metre) the first by name counts.
    """
    kinds = overlaps.groupBy("pause_id", "kind").agg(F.sum("m2").alias("m2"))
    totals = kinds.groupBy("pause_id").agg(F.sum("m2").alias("total"), F.min(F.struct((-F.round("m2", 3)).alias("m"), "kind")).alias("best"))
    shared = kinds.join(totals, "pause_id").select("pause_id", "kind", (F.col("m2") / F.col("total")).alias("share"), (F.col("kind") == F.col("best.kind")).alias("chosen"))
    rows = pauses.select("participant", "pause_id", "seconds").join(shared, "pause_id", "left")
    minutes = F.col("seconds") / 60
    return rows.groupBy("participant", F.coalesce("kind", F.lit("other")).alias("kind")).agg(
        F.sum(F.when(F.coalesce("chosen", F.lit(True)), minutes).otherwise(0.0)).alias("minutes"), F.sum(minutes * F.coalesce("share", F.lit(0.0))).alias("minutes_adjusted")
    )


def places_log(pauses: DataFrame, overlaps: DataFrame, places: DataFrame, least_s: float = 300.0) -> DataFrame:
    """Tags of the places met in pauses of at least ``least_s``: ``participant, day, place_id, tags``."""
    long = pauses.where(F.col("seconds") >= least_s).select("participant", "pause_id", F.floor(F.col("t0") / 86_400).alias("day"))
    return long.join(overlaps.select("pause_id", "place_id"), "pause_id").select("participant", "day", "place_id").distinct().join(places.select("place_id", "tags"), "place_id")
