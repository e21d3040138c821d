"""What is near a position: places of a table, time zones, routes; no network is asked.

Maps come as tables: whoever has a map service writes its answer to one. Both sides meet in an
equi-join on grid cells, so no position is compared with all of a map.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.functions.geo import EARTH_RADIUS_M, bounding_box, great_circle_m


def _cell(value: Column, size: float) -> Column:
    return F.floor(value / size).cast("long")


def spread_to_cells(rows: DataFrame, south: Column, west: Column, north: Column, east: Column, size: float) -> DataFrame:
    """A row per grid cell that its box touches: adds ``cy, cx``."""
    tall = rows.withColumns({"_w": west, "_e": east, "cy": F.explode(F.sequence(_cell(south, size), _cell(north, size)))})
    return tall.withColumn("cx", F.explode(F.sequence(_cell(F.col("_w"), size), _cell(F.col("_e"), size)))).drop("_w", "_e")


def nearby_places(spots: DataFrame, places: DataFrame, keys: Sequence[str], radius_m: float = 1000.0) -> DataFrame:
    """``*keys, place_id, kind, distance_m`` of the places (place_id, kind, lat, lon) within ``radius_m`` of each spot (keys, lat, lon).

    Null positions are near nothing. A spot is put into every cell that its box touches; a cell
    is as wide as the radius at the equator.
    """
    size = math.degrees(radius_m / EARTH_RADIUS_M)
    known = spots.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(*keys, F.col("lat").alias("_la"), F.col("lon").alias("_lo"))
    south, west, north, east = bounding_box(F.col("_la"), F.col("_lo"), radius_m)
    at = places.select("place_id", "kind", "lat", "lon").withColumns({"cy": _cell(F.col("lat"), size), "cx": _cell(F.col("lon"), size)})
    pairs = spread_to_cells(known, south, west, north, east, size).join(at, ["cy", "cx"])
    away = great_circle_m(F.col("_la"), F.col("_lo"), F.col("lat"), F.col("lon"))
    return pairs.select(*keys, "place_id", "kind", away.alias("distance_m")).where(F.col("distance_m") <= radius_m)


def zones_of(points: DataFrame, regions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``*keys, zone``: the zone of the smallest region (zone, south, west, north, east in degrees) that holds each point (keys, lat, lon), null where none does."""
    area = (F.col("north") - F.col("south")) * (F.col("east") - F.col("west"))
    spread = spread_to_cells(regions.withColumn("_area", area), F.col("south"), F.col("west"), F.col("north"), F.col("east"), 5.0)
    at = points.withColumns({"cy": _cell(F.col("lat"), 5.0), "cx": _cell(F.col("lon"), 5.0)})
    inside = F.col("lat").between(F.col("south"), F.col("north")) & F.col("lon").between(F.col("west"), F.col("east"))
    held = at.join(spread, ["cy", "cx"]).where(inside).groupBy(*keys).agg(F.min_by("zone", F.struct("_area", "zone")).alias("zone"))
    return points.select(*keys).join(held, list(keys), "left")


def routes(trips: DataFrame, known: DataFrame | None = None, step_m: float = 50.0) -> DataFrame:
    """``trip_id, k, lat, lon``: points along each trip (trip_id, lat0, lon0, lat1, lon1) no more than ``step_m`` apart.

    ``known`` (trip_id, path: array of structs lat, lon) holds what a routing service answered;
    other trips lead along the streets of a grid: first north or south, then east or west.
    """
    corner = F.array(F.struct(F.col("lat0").alias("lat"), F.col("lon0").alias("lon")), F.struct(F.col("lat1").alias("lat"), F.col("lon0").alias("lon")), F.struct(F.col("lat1").alias("lat"), F.col("lon1").alias("lon")))
    rows = trips.withColumn("_p", corner)
    if known is not None:
        rows = rows.join(known.select("trip_id", "path"), "trip_id", "left").withColumn("_p", F.coalesce("path", "_p"))
    legs = rows.select("trip_id", F.posexplode(F.arrays_zip(F.slice("_p", 1, F.size("_p") - 1).alias("a"), F.slice("_p", 2, F.size("_p") - 1).alias("b"))).alias("leg", "z"))
    a, b = F.col("z.a"), F.col("z.b")
    n = F.greatest(F.ceil(great_circle_m(a["lat"], a["lon"], b["lat"], b["lon"]) / step_m), F.lit(1)).cast("int")
    points = legs.withColumn("n", n).withColumn("j", F.explode(F.sequence(F.when(F.col("leg") == 0, 0).otherwise(1), F.col("n"))))
    share = F.col("j") / F.col("n")
    placed = points.select("trip_id", (F.col("leg") * 1_000_000 + F.col("j")).cast("long").alias("k"), (a["lat"] + (b["lat"] - a["lat"]) * share).alias("lat"), (a["lon"] + (b["lon"] - a["lon"]) * share).alias("lon"))
    return placed
