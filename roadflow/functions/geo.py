"""Geodesy as Column expressions: all of it stays in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import EARTH_RADIUS_M, KM_PER_DEG


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    s1, s2 = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    a = s1 * s1 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * s2 * s2
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing, 0 to 360 degrees clockwise from north."""
    p1, p2, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(p2)
    x = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def bearing_delta(a: Column, b: Column) -> Column:
    """Unsigned difference of two bearings, 0 to 180."""
    d = F.abs(a - b)
    return F.least(d, 360.0 - d)


def manhattan_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return KM_PER_DEG * (F.abs(lat2 - lat1) + F.abs(lon2 - lon1) * F.cos(F.radians(lat1)))


def project(lat: Column, lon: Column, geom: Column) -> Column:
    """``struct(lat, lon)`` of the point of the polyline ``geom`` (array of lon/lat) that is nearest in degrees."""

    def nearest(i: Column) -> Column:
        a, b = F.element_at(geom, i), F.element_at(geom, i + 1)
        dx, dy = b["lon"] - a["lon"], b["lat"] - a["lat"]
        d2 = dx * dx + dy * dy
        t = F.when(d2 > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((lon - a["lon"]) * dx + (lat - a["lat"]) * dy) / d2))).otherwise(F.lit(0.0))
        x, y = a["lon"] + t * dx, a["lat"] + t * dy
        return F.struct(((lon - x) * (lon - x) + (lat - y) * (lat - y)).alias("d2"), i.alias("i"), y.alias("lat"), x.alias("lon"))

    best = F.array_min(F.transform(F.sequence(F.lit(1), F.size(geom) - 1), nearest))
    return F.struct(best["lat"].alias("lat"), best["lon"].alias("lon"))
