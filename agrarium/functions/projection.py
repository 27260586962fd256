"""Map projections as column expressions: universal transverse Mercator both ways, and web Mercator back.

Krüger's series in the third flattening, to the fourth order, which is far
below a millimetre within a zone and its neighbours.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ellipsoid and grid of EPSG 326xx, 327xx and 3857, fixed values.
AXIS, FLATTENING, SCALE, EAST, SOUTH, SPHERE = 6_378_137.0, 1 / 298.257223563, 0.9996, 500_000.0, 10_000_000.0, 6_378_137.0
N = FLATTENING / (2 - FLATTENING)
RADIUS = AXIS / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
ECCENTRICITY = 2 * math.sqrt(N) / (1 + N)
#: Coefficients of the published series.
FORWARD = (N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180, 13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440, 61 * N**3 / 240 - 103 * N**4 / 140, 49561 * N**4 / 161280)
INVERSE = (N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360, N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440, 17 * N**3 / 480 - 37 * N**4 / 840, 4397 * N**4 / 161280)
LATITUDE = (2 * N - 2 * N**2 / 3 - 2 * N**3 + 116 * N**4 / 45, 7 * N**2 / 3 - 8 * N**3 / 5 - 227 * N**4 / 45, 56 * N**3 / 15 - 136 * N**4 / 35, 4279 * N**4 / 630)


def _sum(terms: list[Column]) -> Column:
    return sum(terms[1:], terms[0])


def utm_epsg(lon: Column, lat: Column) -> Column:
    """The EPSG code of a point's zone; the exceptions of the far north aren't made."""
    zone = F.least(F.greatest(F.floor((lon + 180) / 6) + 1, F.lit(1)), F.lit(60))
    return (F.when(lat >= 0, 32600).otherwise(32700) + zone).cast("int")


def _centre(epsg: Column) -> Column:
    return F.radians((epsg % 100) * 6 - 183)


def to_utm(lon: Column, lat: Column, epsg: Column) -> Column:
    """struct(x, y) in metres of the zone of a code 326xx or 327xx; null for other codes."""
    sine = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(sine) - ECCENTRICITY * F.atanh(ECCENTRICITY * sine))
    away = F.radians(lon) - _centre(epsg)
    xi0, eta0 = F.atan2(t, F.cos(away)), F.atanh(F.sin(away) / F.sqrt(1 + t * t))
    # Held in a struct, the first step is taken once and not for each term.
    held = F.transform(F.array(F.struct(xi0.alias("xi"), eta0.alias("eta"))), lambda h: F.struct(
        (h["xi"] + _sum([a * F.sin(2 * j * h["xi"]) * F.cosh(2 * j * h["eta"]) for j, a in enumerate(FORWARD, 1)])).alias("xi"),
        (h["eta"] + _sum([a * F.cos(2 * j * h["xi"]) * F.sinh(2 * j * h["eta"]) for j, a in enumerate(FORWARD, 1)])).alias("eta"),
    ))[0]
    south = F.when(_hundred(epsg) == 327, SOUTH).otherwise(0.0)
    return F.when(is_utm(epsg), F.struct((EAST + SCALE * RADIUS * held["eta"]).alias("x"), (south + SCALE * RADIUS * held["xi"]).alias("y")))


def from_utm(x: Column, y: Column, epsg: Column) -> Column:
    """struct(lon, lat) in degrees of a point of the zone of a code 326xx or 327xx; null for other codes."""
    south = F.when(_hundred(epsg) == 327, SOUTH).otherwise(0.0)
    xi0, eta0 = (y - south) / (SCALE * RADIUS), (x - EAST) / (SCALE * RADIUS)
    held = F.transform(F.array(F.struct(xi0.alias("xi"), eta0.alias("eta"))), lambda h: F.struct(
        (h["xi"] - _sum([b * F.sin(2 * j * h["xi"]) * F.cosh(2 * j * h["eta"]) for j, b in enumerate(INVERSE, 1)])).alias("xi"),
        (h["eta"] - _sum([b * F.cos(2 * j * h["xi"]) * F.sinh(2 * j * h["eta"]) for j, b in enumerate(INVERSE, 1)])).alias("eta"),
    ))
    turned = F.transform(held, lambda h: F.struct(F.asin(F.sin(h["xi"]) / F.cosh(h["eta"])).alias("chi"), F.atan2(F.sinh(h["eta"]), F.cos(h["xi"])).alias("away")))
    found = F.transform(turned, lambda h: F.struct(F.degrees(_centre(epsg) + h["away"]).alias("lon"), F.degrees(h["chi"] + _sum([d * F.sin(2 * j * h["chi"]) for j, d in enumerate(LATITUDE, 1)])).alias("lat")))[0]
    return F.when(is_utm(epsg), found)


def _hundred(epsg: Column) -> Column:
    return F.floor(epsg / 100)


def is_utm(epsg: Column) -> Column:
    return _hundred(epsg).isin(326, 327) & (epsg % 100).between(1, 60)


def to_4326(x: Column, y: Column, epsg: Column) -> Column:
    """struct(lon, lat) in degrees of coordinates in EPSG 4326, 3857, 326xx or 327xx; null for other codes or null."""
    pair = lambda lon, lat: F.struct(lon.alias("lon"), lat.alias("lat"))
    web = pair(F.degrees(x / SPHERE), F.degrees(F.atan(F.sinh(y / SPHERE))))
    known = x.isNotNull() & y.isNotNull()
    return F.when(known & (epsg == 4326), pair(x.cast("double"), y.cast("double"))).when(known & (epsg == 3857), web).when(known, from_utm(x, y, epsg))


def to_web(lon: Column, lat: Column) -> Column:
    """struct(x, y) in EPSG 3857."""
    return F.struct((F.radians(lon) * SPHERE).alias("x"), (F.asinh(F.tan(F.radians(lat))) * SPHERE).alias("y"))
