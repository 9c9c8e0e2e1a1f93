"""Column functions on the sphere and in the Mercator plane."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M, MERCATOR_M = 6_371_000.0, 6_378_137.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres; null where a coordinate is."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    h = F.when(h > 1, 1.0).otherwise(h)
    return 2 * EARTH_M * F.asin(F.sqrt(h))


def mercator_x(lon: Column) -> Column:
    return MERCATOR_M * F.radians(lon)


def mercator_y(lat: Column) -> Column:
    return MERCATOR_M * F.log(F.tan(F.radians(F.lit(45.0)) + F.radians(lat) / 2))


def chord(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column, radius: float) -> tuple[Column, Column]:
    """Length of the segment a-b inside the circle around p, and the segment's least distance from p."""
    dx, dy = bx - ax, by - ay
    fx, fy = ax - px, ay - py
    a = dx * dx + dy * dy
    b = fx * dx + fy * dy
    c = fx * fx + fy * fy - radius * radius
    disc = b * b - a * c
    root = F.sqrt(F.greatest(disc, F.lit(0.0)))
    t0 = F.greatest(F.lit(0.0), (-b - root) / a)
    t1 = F.least(F.lit(1.0), (-b + root) / a)
    inside = F.when((a > 0) & (disc > 0) & (t1 > t0), (t1 - t0) * F.sqrt(a)).otherwise(0.0)
    t = F.when(a > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -b / a))).otherwise(0.0)
    nearest = F.sqrt(F.pow(fx + t * dx, 2) + F.pow(fy + t * dy, 2))
    return inside, nearest
