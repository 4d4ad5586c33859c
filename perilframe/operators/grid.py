"""Hazard-grid factory: thinning, blending, alignment, scenario fan-out, heat, rain and fire."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import assumptions as A
from ..functions.common import by_shuffle, finite_or_null
from ..functions.curves import flame_damage
from ..functions.geo import cell_index, in_regions
from . import exceedance
from .keyed import keep_one
from .spatial import near_any_site, sample_raster

CELL = ["ix", "iy"]


def with_cell(df: DataFrame, deg: float = A.GRID_DEG, lat: str = "lat", lon: str = "lon") -> DataFrame:
    return df.withColumn("iy", cell_index(F.col(lat), deg)).withColumn("ix", cell_index(F.col(lon), deg))


def cell_centre(df: DataFrame, deg: float = A.GRID_DEG) -> DataFrame:
    return df.withColumn("lat", F.col("iy") * deg).withColumn("lon", F.col("ix") * deg)


def centroid_intensity(intensity: DataFrame, catalog: DataFrame, centroids: DataFrame) -> DataFrame:
    """Return-period intensity per centroid and catalog, dense over centroids, flat rare tail."""
    keys = ["source"]
    rows = (intensity.join(by_shuffle(catalog.select(*keys, "event_id", "freq")), [*keys, "event_id"])
            .withColumn("loss", F.coalesce(finite_or_null(F.col("intensity")), F.lit(0.0))))
    points = exceedance.loss_points(rows, [*keys, "centroid_id"], bounded=True)
    ladders = exceedance.interpolated_ladder(points, [*keys, "centroid_id"])
    every = F.explode(F.array(*[F.lit(x) for x in A.SOURCES])).alias("source")
    universe = (centroids.select(every, "centroid_id", "lat", "lon")
                .join(catalog.select("source").distinct(), "source", "left_semi"))
    dense = exceedance.dense_ladder(universe, ladders, [*keys, "centroid_id"], A.RETURN_PERIODS)
    return dense.select(*keys, "centroid_id", "lat", "lon",
                        *[F.get("ladder", F.lit(i)).alias(c) for i, c in enumerate(A.V_COLS)])


def thin_to_grid(points: DataFrame, keys: list[str], deg: float = A.GRID_DEG,
                 wet_only: bool = False) -> DataFrame:
    """Mean of centroid vectors per grid cell; wet_only drops centroids that are dry at every rung."""
    if wet_only:
        points = points.where(F.greatest(*[F.col(c) for c in A.V_COLS]) > A.WET_EPS)
    return (with_cell(points, deg).groupBy(*keys, *CELL)
            .agg(*[F.avg(c).alias(c) for c in A.V_COLS]))


def blend(parts: DataFrame, keys: list[str], weight: str = "weight", values: list[str] = A.V_COLS) -> DataFrame:
    """Weighted mean over the members that are present; weights renormalise per key."""
    w = F.sum(weight)
    return parts.groupBy(*keys).agg(*[(F.sum(F.col(v) * F.col(weight)) / w).alias(v) for v in values])


def blend_scenarios(per_source: DataFrame, recipe: DataFrame, keys: list[str] = CELL,
                    values: list[str] = A.V_COLS) -> DataFrame:
    """Source grids to scenarios through the recipe (19 rows, so the broadcast is bounded)."""
    parts = per_source.join(F.broadcast(recipe), "source")
    return blend(parts, ["scenario", *keys], values=values)


def ensemble_mean(members: DataFrame, keys: list[str]) -> DataFrame:
    """Equal-weight mean over ensemble members present in each cell."""
    return members.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in A.V_COLS])


def align_to_cells(grid: DataFrame, base: DataFrame, keys: list[str]) -> DataFrame:
    """Re-index a grid onto a base cell set; missing cells become explicit zeros."""
    cells = base.select(*keys).distinct()
    return cells.join(by_shuffle(grid.select(*keys, *A.V_COLS)), keys, "left").fillna(0.0, A.V_COLS)


def rain_rows(present: DataFrame) -> DataFrame:
    """Present-day rainfall grid to every scenario, scaled by warming."""
    factor = A.warming_of(F.col("scenario")) * A.RAIN_PER_C + 1.0
    df = A.each_scenario(present.drop("scenario", "hazard"))
    return df.select("lat", "lon", "scenario", F.lit("prain").alias("hazard"),
                     *[F.bround(F.col(c) * factor, 1).alias(c) for c in A.V_COLS])


def scenario_burn(p: Column, scenario: Column) -> Column:
    return F.least(p * (A.warming_of(scenario) * A.FIRE_UPLIFT_PER_C + 1.0), F.lit(1.0))


def fire_rows(points: DataFrame) -> DataFrame:
    """Burn probability and conditional damage at site points, for every scenario.

    Points that share rounded coordinates keep the first by site_key.
    """
    base = points.select("site_key", F.bround("latitude", 4).alias("lat"), F.bround("longitude", 4).alias("lon"),
                         "bp", "cond")
    base = keep_one(base, ["lat", "lon"], "site_key")
    zero = [F.lit(0.0).alias(c) for c in A.V_COLS[2:]]
    return A.each_scenario(base).select(
        "lat", "lon", "scenario", F.lit("wfire").alias("hazard"),
        F.bround(scenario_burn(F.col("bp"), F.col("scenario")) * 100.0, 4).alias("v10"),
        F.bround(F.col("cond") * 100.0, 1).alias("v25"), *zero)


def fire_at_points(points: DataFrame, raster: DataFrame, key: str = "centroid_id") -> DataFrame:
    """Burn probability and conditional damage at points from a raster table.

    Uncovered points are flagged and carry zero; a missing or negative flame length takes the
    interim ratio and says so. Values above 1 are reported in bp_out_of_range, never rescaled.
    """
    df = points.join(raster.select(key, "bp", "cfl"), key, "left")
    bp, cfl = finite_or_null(F.col("bp")), finite_or_null(F.col("cfl"))
    known = F.coalesce(cfl >= 0.0, F.lit(False))
    return df.select(
        *points.columns, bp.isNotNull().alias("fire_covered"),
        F.coalesce(F.abs(bp) > 1.0 + 1e-6, F.lit(False)).alias("bp_out_of_range"),
        F.coalesce(F.least(F.greatest(bp, F.lit(0.0)), F.lit(1.0)), F.lit(0.0)).alias("bp"),
        F.when(known, flame_damage(cfl)).otherwise(A.FIRE_COND_INTERIM).alias("cond"),
        (~known).alias("cond_interim"))


def burn_probability(hits: DataFrame, keys: list[str]) -> DataFrame:
    """1 - exp(-sum of arrival rates); context only, never a loss input."""
    return hits.groupBy(*keys).agg((F.lit(1.0) - F.exp(-F.sum("freq"))).alias("burn_p"))


def heat_indicators(daily: DataFrame, keys: list[str] = ["cell"]) -> DataFrame:
    """Hot-day counts and cooling degree days per cell and scenario, as yearly means.

    Thresholds are shifted instead of the temperatures, so one pass over the daily rows serves
    all ten scenarios and the rows themselves never fan out. A cell with any missing day value
    is dropped. Input columns: keys, year, tmax, tmean.
    """
    tmax, tmean = finite_or_null(F.col("tmax")), finite_or_null(F.col("tmean"))
    sums = []
    for i, d in enumerate(A.HEAT_DELTA.values()):
        hot = F.sum((tmax > A.HEAT_HOT_C - d).cast("long"))
        danger = F.sum((tmax > A.HEAT_DANGER_C - d).cast("long"))
        cooling = F.sum(F.greatest(tmean - (A.COOLING_BASE_C - d), F.lit(0.0)))
        sums += [hot.alias(f"_h{i}"), danger.alias(f"_d{i}"), cooling.alias(f"_c{i}")]
    bad = F.count_if(tmax.isNull() | tmean.isNull())
    yearly = daily.groupBy(*keys, "year").agg(*sums, bad.alias("_bad"))
    names = [f"_{k}{i}" for i in range(len(A.HEAT_DELTA)) for k in "hdc"]
    cells = yearly.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names], F.sum("_bad").alias("_bad"),
                                      F.count("*").alias("_years")).where(F.col("_bad") == 0)
    per = lambda name: F.col(name) / F.col("_years")
    rows = F.array(*[F.struct(F.lit(s).alias("scenario"), per(f"_h{i}").alias("days32"),
                              per(f"_d{i}").alias("days35"), per(f"_c{i}").alias("cdd"))
                     for i, s in enumerate(A.HEAT_DELTA)])
    return cells.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.*")


def heat_rows(indicators: DataFrame) -> DataFrame:
    """Indicators to grid rows: v10 and v25 day counts, v50 degree days, the rest zero."""
    return indicators.select(
        F.bround("lat", 3).alias("lat"), F.bround("lon", 3).alias("lon"), "scenario",
        F.lit("heat").alias("hazard"), F.bround("days32", 1).alias("v10"),
        F.bround("days35", 1).alias("v25"), F.bround("cdd", 0).alias("v50"),
        *[F.lit(0.0).alias(c) for c in A.V_COLS[3:]])


def confident(detections: DataFrame, minimum: int = A.FIRE_MIN_CONFIDENCE) -> DataFrame:
    """Drop weak fire detections; unknown instruments and unreadable confidences stay."""
    inst = F.upper(F.trim("instrument"))
    low_num = (inst == "MODIS") & (finite_or_null(F.col("confidence").try_cast("double")) < minimum)
    low_txt = (inst == "VIIRS") & (F.lower(F.trim("confidence")) == "l")
    return detections.where(~F.coalesce(low_num, F.lit(False)) & ~F.coalesce(low_txt, F.lit(False)))


def fire_context(detections: DataFrame, sites: DataFrame | None, deg: float = A.GRID_DEG,
                 buffer_km: float = A.FIRE_BUFFER_KM) -> DataFrame:
    """Historical detections per cell near the portfolio; never part of the hazard grid."""
    rows = confident(detections)
    if sites is None:
        rows = rows.where(in_regions(F.col("latitude"), F.col("longitude")))
    else:
        rows = near_any_site(rows, sites, buffer_km)
    year = F.year("acq_date").cast("long")
    cells = (with_cell(rows, deg, "latitude", "longitude").groupBy(*CELL)
             .agg(F.count("*").alias("detections"), F.min(year).alias("first_year"), F.max(year).alias("last_year")))
    return cells.select(F.lit("historical_fire_context").alias("kind"), "iy", "ix",
                        "detections", "first_year", "last_year")


def cell_mean_ground(samples: DataFrame, keys: list[str], value: str = "ground_m") -> DataFrame:
    """Mean land ground per cell: samples below zero are sea floor; no land sample means null."""
    v = finite_or_null(F.col(value))
    return samples.groupBy(*keys).agg(F.bround(F.avg(F.when(v >= 0.0, v)), 1).alias("cell_ground_elev_m"))


def cell_samples(sites: DataFrame, deg: float = A.GRID_DEG, per_side: int = 5) -> DataFrame:
    """Sample points spread over the grid cell that holds each site (25 per site)."""
    step = lambda axis: (F.col(axis) - (per_side - 1) / 2.0) / float(per_side) * deg
    pts = with_cell(sites.select("site_key", "latitude", "longitude"), deg, "latitude", "longitude")
    pts = (pts.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(per_side - 1))))
           .withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(per_side - 1)))))
    return pts.select("site_key", (F.col("iy") * deg + step("_j")).alias("lat"),
                      (F.col("ix") * deg + step("_i")).alias("lon"))


def ground_from_raster(sites: DataFrame, cells: DataFrame, frame: tuple[float, float, float, float], deg: float = A.GRID_DEG, nodata: float | None = None) -> DataFrame:
    """site_key, ground_elev_m at the site and cell_ground_elev_m, the mean land ground of its hazard cell from 25 samples.

    Samples are taken once per hazard cell, however many sites it holds.
    """
    at = sample_raster(sites.select("site_key", "latitude", "longitude"), cells, frame, nodata=nodata)
    here = with_cell(at.withColumn("ground_elev_m", F.bround("value", 1)), deg, "latitude", "longitude")
    spots = cell_samples(here.select(*CELL).distinct().select(F.struct(*CELL).alias("site_key"), (F.col("iy") * deg).alias("latitude"), (F.col("ix") * deg).alias("longitude")), deg)
    seen = sample_raster(spots, cells, frame, lat="lat", lon="lon", nodata=nodata)
    means = cell_mean_ground(seen.select("site_key.*", F.col("value").alias("ground_m")), CELL)
    return here.join(means, CELL).select("site_key", "ground_elev_m", "cell_ground_elev_m")


def dataset_year(ref_year: Column, year_range: Column, name: Column) -> Column:
    """Central year of a catalog entry: reference year, else mean of its range, else years in its name."""
    def mean_year(text: Column, pattern: str) -> Column:
        years = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0)),
                            lambda y: y.cast("double"))
        total = F.aggregate(years, F.lit(0.0), lambda a, y: a + y)
        return F.when(F.size(years) > 0, F.rint(total / F.size(years))).cast("int")
    single = F.regexp_extract(F.coalesce(ref_year.cast("string"), F.lit("")), r"\d{4}", 0).try_cast("int")
    return F.coalesce(single, mean_year(year_range, r"\d{4}"), mean_year(name, r"(?:19|20)\d{2}"))


def pick_members(catalog: DataFrame, scenario: str, most: int | None = None) -> DataFrame:
    """River datasets for one scenario: first preference that exists, nearest year, by name.

    With `most`, members beyond the first so many by name are marked skipped.

    Input columns: name, climate_scenario, year (nullable). The preference lookup reads at most
    three distinct tags.
    """
    family, horizon = (("present", "present") if scenario == "present" else scenario.split("_"))
    target = A.RIVER_TARGET_YEAR[horizon]
    rank = F
    for i, tag in enumerate(A.RIVER_PREFERENCE[family]):
        rank = rank.when(F.lower("climate_scenario") == tag.lower(), F.lit(i))
    cand = catalog.withColumn("_rank", rank.otherwise(F.lit(None))).where(F.col("_rank").isNotNull())
    best = cand.groupBy().agg(F.min("_rank").alias("_rank"))
    cand = cand.join(F.broadcast(best), "_rank", "left_semi")
    # an undated candidate counts as on target only when no candidate carries a year
    dated = cand.groupBy("_rank").agg(F.count("year").alias("_dated"),
                                      F.min(F.abs(F.col("year") - target)).alias("_gap"))
    keep = F.when(F.col("_dated") == 0, F.lit(True)).otherwise(F.abs(F.col("year") - target) == F.col("_gap"))
    near = cand.join(F.broadcast(dated), "_rank").where(keep)
    if most is None:
        return near.select("name", "climate_scenario", "year", F.lit(False).alias("skipped"))
    first = near.select("name").distinct().orderBy("name").limit(most).withColumn("_kept", F.lit(True))
    return near.join(first, "name", "left").select("name", "climate_scenario", "year", F.col("_kept").isNull().alias("skipped"))
