"""Distances and coordinates on the globe as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6.371e6


def wrap_longitude(lon: Column) -> Column:
    """Longitude brought to [-180, 180)."""
    return F.pmod(lon + 180, F.lit(360.0)) - 180


def great_circle_m(lat0: Column, lon0: Column, lat1: Column, lon1: Column) -> Column:
    """Spherical-law-of-cosines distance in metres, its cosine clamped to [-1, 1]."""
    a, b = F.radians(lat0), F.radians(lat1)
    cosine = F.cos(a) * F.cos(b) * F.cos(F.radians(lon0) - F.radians(lon1)) + F.sin(a) * F.sin(b)
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))) * EARTH_RADIUS_M


def bounding_box(lat: Column, lon: Column, radius_m: float) -> tuple[Column, Column, Column, Column]:
    """South, west, north and east edges of the box that reaches ``radius_m`` from the centre."""
    dlat = F.lit(math.degrees(radius_m / EARTH_RADIUS_M))
    dlon = dlat / F.cos(F.radians(lat))
    return lat - dlat, lon - dlon, lat + dlat, lon + dlon


def unit_vector(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    a, b = F.radians(lat), F.radians(lon)
    return F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a)


def great_circle_offset_m(lat: Column, lon: Column, lat0: Column, lon0: Column, lat1: Column, lon1: Column) -> Column:
    """Distance of a point from the great circle through two others; 0 where those are one spot (1e-6 degrees)."""
    a, b, c = unit_vector(lat0, lon0), unit_vector(lat1, lon1), unit_vector(lat, lon)
    n = (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
    size = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2]) + 1e-6
    cosine = (n[0] * c[0] + n[1] * c[1] + n[2] * c[2]) / size
    away = F.abs(F.lit(math.pi / 2) - F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))) * EARTH_RADIUS_M
    return F.when((F.abs(lat0 - lat1) < 1e-6) & (F.abs(lon0 - lon1) < 1e-6), 0.0).otherwise(away)
