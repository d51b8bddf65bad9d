"""Two distances: spherical for matching, ellipsoidal for discovery."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The sphere's radius in metres; semi-major axis and flattening of WGS 84.
RADIUS, AXIS, FLATTENING = 6371000.0, 6378137.0, 1 / 298.257223563


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lng1, lng2)
    # least() would pass over a null
    return F.when(h.isNotNull(), 2 * RADIUS * F.asin(F.least(F.lit(1.0), F.sqrt(h))))


def ellipsoidal(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Lambert's formula on reduced latitudes: within 0.1 m below 50 km."""
    reduced = lambda x: F.atan((1 - FLATTENING) * F.tan(F.radians(x)))
    b1, b2 = reduced(lat1), reduced(lat2)
    h = F.pow(F.sin((b2 - b1) / 2), 2) + F.cos(b1) * F.cos(b2) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    angle = 2 * F.asin(F.least(F.lit(1.0), F.sqrt(h)))
    p, q = (b1 + b2) / 2, (b2 - b1) / 2
    x = (angle - F.sin(angle)) * F.pow(F.sin(p) * F.cos(q), 2) / F.pow(F.cos(angle / 2), 2)
    y = (angle + F.sin(angle)) * F.pow(F.cos(p) * F.sin(q), 2) / F.pow(F.sin(angle / 2), 2)
    missing = lat1.isNull() | lng1.isNull() | lat2.isNull() | lng2.isNull()
    return F.when(missing, F.lit(None).cast("double")).when(angle == 0, F.lit(0.0)).otherwise(AXIS * (angle - FLATTENING / 2 * (x + y)))


def within_box(lat: Column, lng: Column, center_lat: Column, center_lng: Column, metres: Column) -> Column:
    """A necessary condition for a distance of at most `metres`, on plain columns that a scan can prune by.

    A degree of latitude has 110,574 m at least; near the poles, and across the date line, longitude isn't restricted.
    """
    d_lat = metres / 110000.0
    d_lng = metres / (F.cos(F.radians(F.least(F.abs(center_lat) + d_lat, F.lit(89.0)))) * 110000.0)
    free = (F.abs(center_lat) + d_lat > 89.0) | (F.abs(center_lng) + d_lng > 180.0)
    return lat.between(center_lat - d_lat, center_lat + d_lat) & (free | lng.between(center_lng - d_lng, center_lng + d_lng))
