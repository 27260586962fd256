"""Distances, boxes, cells, rings and raster windows as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
KM_PER_DEGREE = 111.320


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = EARTH_KM) -> Column:
    """Great-circle distance in the unit of ``radius``."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def box_around(lon: Column, lat: Column, km: Column) -> dict[str, Column]:
    """Corners of the box that holds a circle; near the poles its width is bounded."""
    dlat = km / KM_PER_DEGREE
    dlon = km / (KM_PER_DEGREE * F.greatest(F.cos(F.radians(lat)), F.lit(0.01)))
    return {"min_lon": lon - dlon, "min_lat": lat - dlat, "max_lon": lon + dlon, "max_lat": lat + dlat}


def valid_coordinates(lon: Column, lat: Column) -> Column:
    return F.coalesce(lon.between(-180, 180) & lat.between(-90, 90), F.lit(False))


def cell(value: Column, size: float) -> Column:
    """The number of the grid cell that holds the value."""
    return F.floor(value / size)


def _edges(ring: Column) -> Column:
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.zip_with(F.slice(ring, 1, n), F.slice(ring, 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def on_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether the point lies on an edge of a closed ring."""

    def on(e: Column) -> Column:
        a, b = e["a"], e["b"]
        cross = (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])
        return (F.abs(cross) < 1e-12) & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))

    return F.exists(_edges(ring), on)


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a closed ring array<struct<x,y>> holds the point; its edge counts as inside."""
    edges = _edges(ring)

    def crossed(e: Column) -> Column:
        a, b = e["a"], e["b"]
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"])

    return on_ring(x, y, ring) | (F.size(F.filter(edges, lambda e: F.coalesce(crossed(e), F.lit(False)))) % 2 == 1)


def pixel_of(lon: Column, lat: Column, left: Column, top: Column, width: Column, height: Column) -> dict[str, Column]:
    """Row and column of a north-up raster."""
    return {"row": F.floor((top - lat) / height).cast("int"), "col": F.floor((lon - left) / width).cast("int")}


def clamped_window(row: Column, col: Column, size: int, rows: Column, cols: Column) -> dict[str, Column]:
    """A window of ``size`` about a pixel, clipped to the raster, and what has to be padded before it."""
    half = size // 2
    top, left = row - half, col - half
    return {
        "row_off": F.greatest(top, F.lit(0)),
        "col_off": F.greatest(left, F.lit(0)),
        "height": F.greatest(F.least(top + size, rows) - F.greatest(top, F.lit(0)), F.lit(0)),
        "width": F.greatest(F.least(left + size, cols) - F.greatest(left, F.lit(0)), F.lit(0)),
        "pad_top": F.greatest(-top, F.lit(0)),
        "pad_left": F.greatest(-left, F.lit(0)),
    }


def normal_crs(crs: Column) -> Column:
    """Upper case, without blanks."""
    return F.regexp_replace(F.upper(crs), r"\s+", "")


def in_rings(x: Column, y: Column, rings: Column) -> Column:
    """Whether the point lies in an odd number of closed rings: in a part and not in its hole, whatever their order. Edges count as inside."""
    held = F.transform(rings, lambda ring: F.struct(in_ring(x, y, ring).alias("inside"), on_ring(x, y, ring).alias("edge")))
    odd = F.size(F.filter(held, lambda r: r["inside"] & ~r["edge"])) % 2 == 1
    return odd | F.exists(held, lambda r: r["edge"])
