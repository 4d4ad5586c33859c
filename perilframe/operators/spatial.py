"""Bounded nearest-neighbour and range joins on the sphere.

No site ever meets every centroid. Work per distinct site location is bounded by geometry:
a ring of nine fine cells first, and only for locations that ring cannot settle, the occupied
cells within reach, pruned by distance bounds before any centroid in them is read. Distances
beyond reach come from a descent through ever finer cells that keeps a few at each level. Copies of
one location are collapsed before the joins, so a location that carries a third of all rows
costs the same as one that carries a single row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import assumptions as A
from ..functions.common import by_shuffle, finite_or_null
from ..functions.geo import EARTH_KM, haversine_km, raster_index


def _cells(deg: float) -> int:
    n = round(360.0 / deg)
    if abs(n * deg - 360.0) > 1e-9:
        raise ValueError("cell size must divide 360 degrees")
    return n


def _cell_y(lat: Column, deg: float) -> Column:
    return F.floor(lat / deg).cast("long")


def _wrap(ix: Column, deg: float) -> Column:
    """Longitude cells wrap at the date line."""
    n = _cells(deg)
    return (F.pmod(ix + n // 2, F.lit(n)) - n // 2).cast("long")


def _cell_x(lon: Column, deg: float) -> Column:
    return _wrap(F.floor(lon / deg).cast("long"), deg)


def _explode_cells(points: DataFrame, deg: float, y0: Column, y1: Column, x0: Column, x1: Column) -> DataFrame:
    last = F.least(x1, x0 + (_cells(deg) - 1))
    rows = points.withColumn("_y", F.explode(F.sequence(y0.cast("long"), y1.cast("long"))))
    rows = rows.withColumn("_x", F.explode(F.sequence(x0.cast("long"), last.cast("long"))))
    return rows.withColumn("_x", _wrap(F.col("_x"), deg))


def _reach_cells(points: DataFrame, deg: float, reach_km: float) -> DataFrame:
    """One row per point and cell that a cap of the given radius can touch."""
    arc = min(reach_km / EARTH_KM, math.pi)
    dlat = math.degrees(arc)
    lat, lon = F.col("lat"), F.col("lon")
    polar = (F.abs(lat) + dlat) >= 90.0
    spread = F.lit(math.sin(min(arc, math.pi / 2))) / F.cos(F.radians(lat))
    dlon = F.when(polar, 180.0).otherwise(F.degrees(F.asin(F.least(spread, F.lit(1.0)))))
    return _explode_cells(points, deg,
                          F.floor(F.greatest(lat - dlat, F.lit(-90.0)) / deg),
                          F.floor(F.least(lat + dlat, F.lit(90.0)) / deg),
                          F.floor((lon - dlon) / deg), F.floor((lon + dlon) / deg))


def _best(pairs: DataFrame, by: list[str]) -> DataFrame:
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("_clat"), F.col("_clon"))
    hit = F.struct(F.round(km, 6).alias("km"), F.col("_cid").alias("cid"))
    return pairs.groupBy(*by, "lat", "lon").agg(F.min(F.when(F.col("_cid").isNotNull(), hit)).alias("_hit"))


def _ring(points: DataFrame, cen: DataFrame, by: list[str], deg: float) -> DataFrame:
    """Nearest centroid within the nine cells around each location, null when they are empty."""
    y, x = F.floor(F.col("lat") / deg), F.floor(F.col("lon") / deg)
    probe = _explode_cells(points, deg, y - 1, y + 1, x - 1, x + 1)
    return _best(probe.join(by_shuffle(cen), [*by, "_y", "_x"], "left"), by)


def _search(points: DataFrame, cen: DataFrame, by: list[str], deg: float, reach_km: float) -> DataFrame:
    """Nearest centroid within reach for locations the ring could not settle."""
    coarse = 2.0 if reach_km < 2000.0 else 30.0
    parent = lambda df: (df.withColumn("_py", _cell_y(F.col("_clat"), coarse))
                         .withColumn("_px", _cell_x(F.col("_clon"), coarse)))
    occupied = (parent(cen).groupBy(*by, "_py", "_px", "_y", "_x")
                .agg(F.min("_clat").alias("_rlat"), F.min_by("_clon", "_clat").alias("_rlon")))
    probe = (_reach_cells(points, coarse, reach_km)
             .withColumnRenamed("_y", "_py").withColumnRenamed("_x", "_px")
             .join(by_shuffle(occupied), [*by, "_py", "_px"]))
    # a known centroid of the cell bounds the answer from above, the cell's extent from below
    upper = haversine_km(F.col("lat"), F.col("lon"), F.col("_rlat"), F.col("_rlon"))
    centre = haversine_km(F.col("lat"), F.col("lon"), (F.col("_y") + 0.5) * deg, (F.col("_x") + 0.5) * deg)
    probe = probe.withColumn("_upper", upper).withColumn(
        "_lower", F.greatest(centre - math.radians(deg) * EARTH_KM, F.lit(0.0)))
    # one row per location and occupied cell within reach: bounded by area, not by data
    w = Window.partitionBy(*by, "lat", "lon")
    kept = (probe.withColumn("_bound", F.min("_upper").over(w))
            .where((F.col("_lower") <= F.col("_bound") + 1e-6) & (F.col("_lower") <= reach_km))
            .select(*by, "lat", "lon", "_y", "_x"))
    return _best(kept.join(by_shuffle(cen), [*by, "_y", "_x"]), by)


def _pyramid(deg: float) -> list[float]:
    """Cell sizes from the whole globe down to deg, each dividing the one before, some five to nine times."""
    n, sizes = _cells(deg), [deg]
    while n > 1:
        step = next((f for f in (4, 5, 6, 7, 8, 9, 3, 2) if n % f == 0), n)
        n //= step
        sizes.append(360.0 / n)
    return sizes[::-1]


def _descend(points: DataFrame, cen: DataFrame, by: list[str], deg: float) -> DataFrame:
    """Nearest centroid at any distance, from coarse cells to fine ones.

    At each level a location keeps only cells that may hold its nearest centroid: those whose lower distance bound is not
    above the distance to a known centroid of some kept cell. A few cells are left at each level, however far the
    centroids are and however many there are.
    """
    at = lambda df, size: df.withColumn("_cy", F.floor(F.col("_clat") / size).cast("long")).withColumn("_cx", F.floor((F.col("_clon") + 180.0) / size).cast("long"))
    cen = cen.drop("_y", "_x").withColumn("_clon", F.when(F.col("_clon") >= 180.0, F.col("_clon") - 360.0).otherwise(F.col("_clon")))
    alive, sizes = points.select(*by, "lat", "lon"), _pyramid(deg)
    kept = alive.withColumn("_py", F.explode(F.array(F.lit(-1), F.lit(0)).cast("array<long>"))).withColumn("_px", F.lit(0).cast("long"))
    here = Window.partitionBy(*by, "lat", "lon")
    for above, size in zip(sizes, sizes[1:], strict=False):
        ratio = round(above / size)
        cells = (at(cen, size).groupBy(*by, "_cy", "_cx").agg(F.min_by(F.struct("_clat", "_clon"), F.struct("_clat", "_clon")).alias("_rep"))
                 .withColumn("_py", F.floor(F.col("_cy") / ratio).cast("long")).withColumn("_px", F.floor(F.col("_cx") / ratio).cast("long")))
        if above == 360.0:
            cells = cells.withColumn("_py", F.when(F.col("_cy") < 0, -1).otherwise(0).cast("long"))
        near = kept.join(by_shuffle(cells), [*by, "_py", "_px"])
        upper = haversine_km(F.col("lat"), F.col("lon"), F.col("_rep._clat"), F.col("_rep._clon"))
        middle = haversine_km(F.col("lat"), F.col("lon"), (F.col("_cy") + 0.5) * size, (F.col("_cx") + 0.5) * size - 180.0)
        near = near.withColumn("_lower", middle - math.radians(size) * EARTH_KM * math.sqrt(0.5)).withColumn("_bound", F.min(upper).over(here))
        kept = near.where(F.col("_lower") <= F.col("_bound") + 1e-6).select(*by, "lat", "lon", F.col("_cy").alias("_py"), F.col("_cx").alias("_px"))
    leaves = at(cen, deg).withColumnRenamed("_cy", "_py").withColumnRenamed("_cx", "_px")
    return _best(kept.join(by_shuffle(leaves), [*by, "_py", "_px"]), by)


def nearest(points: DataFrame, centroids: DataFrame, *, lat: str = "latitude", lon: str = "longitude",
            c_lat: str = "lat", c_lon: str = "lon", c_id: str = "centroid_id",
            by: tuple[str, ...] = (), max_km: float = A.SNAP_KM, deg: float = A.GRID_DEG,
            distance_beyond: bool = False) -> DataFrame:
    """Add centroid_id, dist_km and covered: the nearest centroid within max_km of each point.

    Ties go to the lowest id. Beyond max_km the id is null; with distance_beyond the distance of
    such points is still reported. Columns in `by` must match on both sides, so one call serves
    many hazard layers. Pick `deg` near the centroid spacing.
    """
    keys = list(by)
    loc = (points.select(*keys, F.col(lat).alias("lat"), F.col(lon).alias("lon"))
           .where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).distinct())
    cen = (centroids.groupBy(*keys, F.col(c_lat).alias("_clat"), F.col(c_lon).alias("_clon"))
           .agg(F.min(c_id).alias("_cid"))
           .withColumn("_y", _cell_y(F.col("_clat"), deg)).withColumn("_x", _cell_x(F.col("_clon"), deg)))
    # nothing outside the ring is nearer than the distance to the next meridian but one
    settled_km = F.lit(EARTH_KM) * F.asin(F.cos(F.radians(F.least(F.abs(F.col("lat")) + 2 * deg, F.lit(90.0))))
                                          * math.sin(math.radians(deg)))
    ring = _ring(loc, cen, keys, deg)
    done = F.coalesce(F.col("_hit.km") <= settled_km, F.lit(False))
    open_loc = ring.where(~done).select(*keys, "lat", "lon")
    found = ring.where(done).unionByName(_search(open_loc, cen, keys, deg, max_km))
    if distance_beyond:
        known = found.where(F.col("_hit.km") <= max_km).select(*keys, "lat", "lon")
        far = loc.join(known, [*keys, "lat", "lon"], "left_anti")
        found = found.where(F.col("_hit.km") <= max_km).unionByName(_descend(far, cen, keys, deg))
    near = found.select(*keys, F.col("lat").alias(lat), F.col("lon").alias(lon),
                        F.col("_hit.cid").alias("centroid_id"), F.col("_hit.km").alias("dist_km"))
    out = points.join(by_shuffle(near), [*keys, lat, lon], "left")
    covered = F.coalesce(F.col("dist_km") <= max_km, F.lit(False))
    beyond = F.col("dist_km") if distance_beyond else F.when(covered, F.col("dist_km"))
    return (out.withColumn("covered", covered)
            .withColumn("centroid_id", F.when(F.col("covered"), F.col("centroid_id")))
            .withColumn("dist_km", beyond))


def sample_raster(points: DataFrame, cells: DataFrame, frame: tuple[float, float, float, float], *, lat: str = "latitude", lon: str = "longitude",
                  value: str = "value", nodata: float | None = None) -> DataFrame:
    """points with `value`, the raster value at each of them; null outside the raster, without a cell, or where it holds no data.

    cells: iy, ix, value, one row per cell at most; rows count from the north edge, columns from the west edge. frame is
    (west, north, width and height of a cell in degrees). A value counts if it is finite and not close to `nodata`. One
    equi-join on cell numbers: neither side is looked at twice, and copies of a location cost a shuffle row each.
    """
    west, north, dx, dy = frame
    known = cells.select(F.col("iy").cast("long").alias("_row"), F.col("ix").cast("long").alias("_col"), finite_or_null(F.col(value)).alias(value))
    if nodata is not None:
        known = known.where(~F.coalesce(F.abs(F.col(value) - nodata) <= 1e-8 + 1e-5 * abs(nodata), F.lit(False)))
    at = points.withColumn("_row", raster_index(F.lit(north) - F.col(lat), 0.0, dy)).withColumn("_col", raster_index(F.col(lon), west, dx))
    return at.join(known, ["_row", "_col"], "left").drop("_row", "_col")


def water_snap(sites: DataFrame, water_centroids: DataFrame, *, wind_dist: str = "wind_dist_km",
               deg: float = A.GRID_DEG) -> DataFrame:
    """Snap sites to a water layer only within cell scale of their wind centroid.

    Without the guard an inland site would inherit the depth of a distant wet cell.
    """
    limit = F.greatest(F.coalesce(F.col(wind_dist), F.lit(0.0)), F.lit(0.0)) + A.WATER_SLACK_KM
    near = nearest(sites, water_centroids, deg=deg)
    keep = F.coalesce(F.col("dist_km") <= limit, F.lit(False))
    return (near.withColumn("covered", keep)
            .withColumn("centroid_id", F.when(keep, F.col("centroid_id"))))


def near_any_site(detections: DataFrame, sites: DataFrame, buffer_km: float = A.FIRE_BUFFER_KM,
                  deg: float = A.GRID_DEG) -> DataFrame:
    """Detections inside any site's latitude/longitude box, as a semi join.

    A cell that lies wholly inside some box accepts its detections without looking at a single
    site; only detections in cells crossed by box edges are compared with those boxes.
    """
    dlat = buffer_km / 111.0
    dlon = F.lit(buffer_km) / (F.greatest(F.cos(F.radians(F.col("_slat"))), F.lit(0.1)) * 111.0)
    boxes = (sites.select(F.col("latitude").alias("_slat"), F.col("longitude").alias("_slon")).distinct()
             .withColumn("_dlon", dlon))
    cells = _explode_cells(boxes, deg, F.floor((F.col("_slat") - dlat) / deg), F.floor((F.col("_slat") + dlat) / deg),
                           F.floor((F.col("_slon") - F.col("_dlon")) / deg),
                           F.floor((F.col("_slon") + F.col("_dlon")) / deg))
    margin = 1e-9
    inside = ((F.col("_y") * deg >= F.col("_slat") - dlat + margin)
              & ((F.col("_y") + 1) * deg <= F.col("_slat") + dlat - margin)
              & (F.col("_x") * deg >= F.col("_slon") - F.col("_dlon") + margin)
              & ((F.col("_x") + 1) * deg <= F.col("_slon") + F.col("_dlon") - margin))
    cells = cells.withColumn("_inside", inside)
    full = cells.where("_inside").select("_y", "_x").distinct()
    edge = cells.where("not _inside").join(full, ["_y", "_x"], "left_anti")
    d = (detections.withColumn("_y", _cell_y(F.col("latitude"), deg))
         .withColumn("_x", _cell_x(F.col("longitude"), deg)))
    sure = d.join(full, ["_y", "_x"], "left_semi")
    e = edge.alias("e")
    q = d.alias("d")
    hit = ((F.col("d._y") == F.col("e._y")) & (F.col("d._x") == F.col("e._x"))
           & (F.abs(F.col("d.latitude") - F.col("e._slat")) <= dlat)
           & (F.abs(F.col("d.longitude") - F.col("e._slon")) <= F.col("e._dlon")))
    maybe = q.join(e, hit, "left_semi")
    return sure.unionByName(maybe).drop("_y", "_x")
