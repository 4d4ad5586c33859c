"""Distances, region boxes and grid cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..assumptions import PORTFOLIO_BOXES, RAIN_DOMAIN_MARGIN_DEG, SEA_LEVEL_BOXES
from .common import finite_or_null

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    s_lat = F.sin((F.radians(lat2) - F.radians(lat1)) / 2.0)
    s_lon = F.sin((F.radians(lon2) - F.radians(lon1)) / 2.0)
    a = s_lat * s_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * s_lon * s_lon
    return F.lit(2.0 * EARTH_KM) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def in_box(lat: Column, lon: Column, box: tuple) -> Column:
    _, lat0, lat1, lon0, lon1 = box
    return lat.between(lat0, lat1) & lon.between(lon0, lon1)


def first_box(lat: Column, lon: Column, boxes: list[tuple], default: str | None) -> Column:
    """Name of the first box holding the point."""
    out = F
    for box in boxes:
        out = out.when(in_box(lat, lon, box), F.lit(box[0]))
    return out.otherwise(F.lit(default))


def region_of(lat: Column, lon: Column) -> Column:
    """Portfolio region, null outside every box."""
    return first_box(lat, lon, PORTFOLIO_BOXES, None)


def in_regions(lat: Column, lon: Column) -> Column:
    out = F.lit(False)
    for box in PORTFOLIO_BOXES:
        out = out | in_box(lat, lon, box)
    return out


def sea_level_region(lat: Column, lon: Column) -> Column:
    return first_box(lat, lon, SEA_LEVEL_BOXES, "global_mean")


def domain_covers(domain: tuple, lat: Column, lon: Column) -> Column:
    """A rain domain speaks for points inside its box widened by the margin."""
    m = RAIN_DOMAIN_MARGIN_DEG
    _, _, _, lon0, lat0, lon1, lat1 = domain
    return lat.between(lat0 - m, lat1 + m) & lon.between(lon0 - m, lon1 + m)


def to_pm180(lon: Column) -> Column:
    return F.when(lon > 180.0, lon - 360.0).otherwise(lon)


def cell_index(x: Column, deg: float) -> Column:
    """Grid-cell index, half-even, kept as a long so that keys compare exactly."""
    return F.rint(x / F.lit(float(deg))).cast("long")


def raster_index(x: Column, origin: float, step: float) -> Column:
    return F.floor((x - F.lit(origin)) / F.lit(step)).cast("long")


def relief(ground: Column, cell_ground: Column, clamp_m: float) -> Column:
    """Site ground minus cell ground, clamped; null unless both are known."""
    g, c = finite_or_null(ground), finite_or_null(cell_ground)
    both = g.isNotNull() & c.isNotNull()
    return F.when(both, F.least(F.greatest(g - c, F.lit(-clamp_m)), F.lit(clamp_m)))
