"""Distances, shapes and grids on the globe as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371008.7714
#: Metres of each unit.
UNITS_M = {"m": 1.0, "meters": 1.0, "km": 1000.0, "kilometers": 1000.0, "mi": 1609.344, "miles": 1609.344, "yd": 0.9144, "ft": 0.3048, "in": 0.0254, "cm": 0.01, "mm": 0.001, "nmi": 1852.0, "NM": 1852.0}
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def metres(distance: str | float) -> float:
    """``"12km"`` or a number of metres."""
    if isinstance(distance, (int, float)):
        return float(distance)
    m = re.fullmatch(r"\s*([\d.]+)\s*([A-Za-z]*)\s*", distance)
    if not m or (m[2] or "m") not in UNITS_M:
        raise ValueError(f"not a distance: {distance!r}")
    return float(m[1]) * UNITS_M[m[2] or "m"]


def point(p) -> tuple[float, float]:
    """``(lat, lon)`` of a point given as an object, ``[lon, lat]`` or ``"lat,lon"``."""
    if isinstance(p, dict):
        if "coordinates" in p:
            return float(p["coordinates"][1]), float(p["coordinates"][0])
        return float(p["lat"]), float(p["lon"])
    if isinstance(p, str):
        lat, lon = p.split(",")
        return float(lat), float(lon)
    return float(p[1]), float(p[0])


def haversine(lat: Column, lon: Column, lat0: float, lon0: float) -> Column:
    """Metres to a fixed point."""
    a = F.pow(F.sin(F.radians(lat - F.lit(lat0)) / 2), 2) + F.cos(F.radians(F.lit(lat0))) * F.cos(F.radians(lat)) * F.pow(F.sin(F.radians(lon - F.lit(lon0)) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def in_box(lat: Column, lon: Column, top: float, left: float, bottom: float, right: float) -> Column:
    """Within a box; one whose left side lies east of its right side crosses the date line."""
    wide = (lon >= left) & (lon <= right) if left <= right else (lon >= left) | (lon <= right)
    return (lat <= top) & (lat >= bottom) & wide


def in_polygon(lat: Column, lon: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd rule over the edges of a ring of (lat, lon)."""
    odd = F.lit(False)
    for (ya, xa), (yb, xb) in zip(ring, [*ring[1:], ring[0]]):
        if ya == yb:
            continue
        cross = ((F.lit(ya) > lat) != (F.lit(yb) > lat)) & (lon < (lat - ya) * (xb - xa) / (yb - ya) + xa)
        odd = odd != cross
    return odd


def geotile(lat: Column, lon: Column, zoom: int) -> Column:
    """``zoom/x/y`` of the web-mercator tile."""
    n = 1 << zoom
    x = F.floor((lon + 180.0) / 360.0 * n)
    s = F.sin(F.radians(F.greatest(F.lit(-85.05112878), F.least(F.lit(85.05112878), lat))))
    y = F.floor((0.5 - F.log((1 + s) / (1 - s)) / (4 * 3.141592653589793)) * n)
    clip = lambda v: F.greatest(F.lit(0).cast("bigint"), F.least(F.lit(n - 1).cast("bigint"), v))
    return F.concat_ws("/", F.lit(str(zoom)), clip(x).cast("string"), clip(y).cast("string"))


def geohash(lat: Column, lon: Column, precision: int) -> Column:
    """Base-32 geohash: the bits of both scaled coordinates, interleaved, five to a letter."""
    bits = 5 * precision
    nx, ny = (bits + 1) // 2, bits // 2
    x = F.least(F.floor((lon + 180.0) / 360.0 * float(1 << nx)), F.lit((1 << nx) - 1).cast("bigint"))
    y = F.least(F.floor((lat + 90.0) / 180.0 * float(1 << ny)), F.lit((1 << ny) - 1).cast("bigint"))
    letters = []
    for k in range(precision):
        v = F.lit(0).cast("bigint")
        for b in range(5 * k, 5 * k + 5):
            bit = F.shiftright(x, nx - 1 - b // 2) if b % 2 == 0 else F.shiftright(y, ny - 1 - b // 2)
            v = v * 2 + bit.bitwiseAND(F.lit(1).cast("bigint"))
        letters.append(F.substring(F.lit(BASE32), (v + 1).cast("int"), F.lit(1)))
    return F.concat(*letters)
