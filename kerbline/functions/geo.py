"""Planar and spherical geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kerbline.constants import EARTH_R_M, M_PER_DEG, M_PER_DEG_LAT_APP


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(dlon / 2), F.lit(2)
    )
    return 2 * EARTH_R_M * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))


def equirect_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Planar distance with the cosine of the middle latitude."""
    dlat = F.radians(lat2 - lat1)
    dlon = F.radians(lon2 - lon1) * F.cos(F.radians(lat1 + lat2) / 2)
    return EARTH_R_M * F.sqrt(dlat * dlat + dlon * dlon)


def local_x(lon: Column, lat0: Column, lon0: Column) -> Column:
    return (lon - lon0) * (M_PER_DEG * F.cos(F.radians(lat0)))


def local_y(lat: Column, lat0: Column) -> Column:
    return (lat - lat0) * M_PER_DEG


def app_x(lon: Column, lat0: Column, lon0: Column) -> Column:
    """East metres around a point, the live application's variant."""
    return (lon - lon0) * (M_PER_DEG * F.cos(F.radians(lat0)))


def app_y(lat: Column, lat0: Column) -> Column:
    return (lat - lat0) * M_PER_DEG_LAT_APP


def web_mercator_x(lon: Column) -> Column:
    return F.radians(lon) * 6378137.0


def web_mercator_y(lat: Column) -> Column:
    return F.log(F.tan(F.lit(0.7853981633974483) + F.radians(lat) / 2)) * 6378137.0


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Compass bearing of a step, 0 to 360."""
    dlon = F.radians(lon2 - lon1)
    a, b = F.radians(lat1), F.radians(lat2)
    y = F.sin(dlon) * F.cos(b)
    x = F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(dlon)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def planar_bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Compass direction on a local plane at the middle latitude, 0 to 360."""
    dx = (lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    return F.pmod(F.degrees(F.atan2(dx, lat2 - lat1)) + 360.0, F.lit(360.0))


def camera_bearing(bearing: Column) -> Column:
    """Map rotation that lays a route left to right."""
    return F.pmod(bearing - 90.0, F.lit(360.0))


def clamp_share(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Share along a segment of the point nearest to (px, py), 0 for zero length."""
    dx, dy = bx - ax, by - ay
    len2 = dx * dx + dy * dy
    t = ((px - ax) * dx + (py - ay) * dy) / len2
    return F.when(len2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))).otherwise(0.0)
