"""Distances and grids on the sphere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two points."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(F.radians(lon2 - lon1) / 2), F.lit(2)
    )
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def cell(degrees: Column, per_degree: int = 100) -> Column:
    """Number of the grid line nearest to a coordinate."""
    return F.floor(degrees * per_degree + 0.5).cast("long")


def plausible(lat: Column, lon: Column) -> Column:
    """Coordinates in range and not the null island."""
    near_zero = (F.abs(lat) < 1e-7) & (F.abs(lon) < 1e-7)
    return lat.between(-90, 90) & lon.between(-180, 180) & ~near_zero


def mercator(lat: Column, lon: Column, width: int, height: int) -> tuple[Column, Column]:
    """Canvas place of a point."""
    x = (lon + 180) / 360 * width
    y = (1 - F.log(F.tan(F.radians(lat)) + 1 / F.cos(F.radians(lat))) / F.lit(3.141592653589793)) / 2 * height
    return x, y


def dms(degrees: Column, positive: str, negative: str) -> Column:
    """Degrees, minutes and seconds to two places with the letter of the hemisphere."""
    hundredths = F.round(F.abs(degrees) * 360_000).cast("long")
    whole, rest = F.floor(hundredths / 360_000), hundredths % 360_000
    seconds = F.format_string("%.2f", (rest % 6_000) / 100)
    return F.concat(whole, F.lit("°"), F.floor(rest / 6_000), F.lit("'"), seconds, F.lit('"'), F.when(degrees < 0, negative).otherwise(positive))
