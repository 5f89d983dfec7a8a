"""Spherical geometry as column expressions, plus SQL names for them."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# The two Earth radii in use, in km.
RADIUS_KM = 6371.0
MEAN_RADIUS_KM = 6371.0088


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def _central_angle(lat1, lng1, lat2, lng2) -> Column:
    a, b = F.radians(_c(lat1)), F.radians(_c(lat2))
    dlat = b - a
    dlng = F.radians(_c(lng2) - _c(lng1))
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(dlng / 2), 2)
    return 2 * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def _course(lat1, lng1, lat2, lng2) -> Column:
    a, b = F.radians(_c(lat1)), F.radians(_c(lat2))
    dlng = F.radians(_c(lng2) - _c(lng1))
    return F.atan2(F.sin(dlng) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(dlng))


def haversine_km(lat1, lng1, lat2, lng2, radius: float = RADIUS_KM) -> Column:
    return _central_angle(lat1, lng1, lat2, lng2) * radius


def bearing_deg(lat1, lng1, lat2, lng2) -> Column:
    """Initial great-circle course in [0, 360)."""
    return F.pmod(F.degrees(_course(lat1, lng1, lat2, lng2)) + 360, F.lit(360.0))


def cross_track_km(lat, lng, lat1, lng1, lat2, lng2, radius: float = RADIUS_KM) -> Column:
    """Signed distance from the great circle through point 1 and point 2: positive right of the course."""
    d13 = _central_angle(lat1, lng1, lat, lng)
    dt = _course(lat1, lng1, lat, lng) - _course(lat1, lng1, lat2, lng2)
    return F.asin(F.sin(d13) * F.sin(dt)) * radius


def along_track_km(lat, lng, lat1, lng1, lat2, lng2, radius: float = RADIUS_KM) -> Column:
    """Signed distance along the line from point 1 to the foot of the perpendicular: negative behind point 1."""
    d13 = _central_angle(lat1, lng1, lat, lng)
    dt = _course(lat1, lng1, lat, lng) - _course(lat1, lng1, lat2, lng2)
    return F.atan2(F.sin(d13) * F.cos(dt), F.cos(d13)) * radius


def chord_km(arc_km: float, radius: float = RADIUS_KM) -> float:
    """Straight-line length under an arc of the given length."""
    import math

    return 2 * radius * math.sin(min(arc_km / (2 * radius), math.pi / 2))


def unit_xyz(lat, lng) -> tuple[Column, Column, Column]:
    a, o = F.radians(_c(lat)), F.radians(_c(lng))
    return F.cos(a) * F.cos(o), F.cos(a) * F.sin(o), F.sin(a)


def register_geo(spark: SparkSession) -> None:
    """SQL names `haversine_km`, `bearing_deg`, `cross_track_km` as temporary SQL functions (no Python involved)."""
    r = MEAN_RADIUS_KM
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION haversine_km(lat1 DOUBLE, lng1 DOUBLE, lat2 DOUBLE, lng2 DOUBLE)
        RETURNS DOUBLE RETURN 2 * {r} * asin(least(1.0D, sqrt(pow(sin(radians(lat2 - lat1) / 2), 2)
          + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lng2 - lng1) / 2), 2))))"""
    )
    spark.sql(
        """CREATE OR REPLACE TEMPORARY FUNCTION bearing_deg(lat1 DOUBLE, lng1 DOUBLE, lat2 DOUBLE, lng2 DOUBLE)
        RETURNS DOUBLE RETURN pmod(degrees(atan2(sin(radians(lng2 - lng1)) * cos(radians(lat2)),
          cos(radians(lat1)) * sin(radians(lat2))
          - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lng2 - lng1)))) + 360, 360.0D)"""
    )
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION cross_track_km(
          lat DOUBLE, lng DOUBLE, lat1 DOUBLE, lng1 DOUBLE, course DOUBLE)
        RETURNS DOUBLE RETURN {r} * asin(sin(haversine_km(lat1, lng1, lat, lng) / {r})
          * sin(radians(bearing_deg(lat1, lng1, lat, lng) - course)))"""
    )
