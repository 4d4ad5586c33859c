"""Screening hazard models that fill in where no hazard grid reaches a site.

Anchor tables are literal arrays folded inside the row, so the models add neither a
join nor a shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import assumptions as A
from .curves import heat_band
from .geo import haversine_km, sea_level_region


def _anchor_array(rows: list[tuple], names: list[str]) -> Column:
    return F.expr(A.sql_literal([dict(zip(names, row)) for row in rows]))


def wind_anchor_mean(lat: Column, lon: Column) -> Column:
    """struct(v100, slope): Gaussian distance-weighted mean of the wind anchors."""
    anchors = _anchor_array(A.WIND_ANCHORS, ["lat", "lon", "v", "b"])
    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("v"), F.lit(0.0).alias("b"))

    def add(acc: Column, a: Column) -> Column:
        d = haversine_km(lat, lon, a["lat"], a["lon"]) / A.WIND_ANCHOR_SCALE_KM
        w = F.exp(-(d * d))
        return F.struct((acc["w"] + w).alias("w"), (acc["v"] + w * a["v"]).alias("v"),
                        (acc["b"] + w * a["b"]).alias("b"))

    def close(acc: Column) -> Column:
        thin = acc["w"] < 1e-6
        return F.struct(F.when(thin, A.WIND_FALLBACK[0]).otherwise(acc["v"] / acc["w"]).alias("v100"),
                        F.when(thin, A.WIND_FALLBACK[1]).otherwise(acc["b"] / acc["w"]).alias("slope"))

    return F.aggregate(anchors, zero, add, close)


def coast_km(lat: Column, lon: Column) -> Column:
    """Distance to the nearest coast anchor."""
    anchors = _anchor_array(A.COAST_ANCHORS, ["lat", "lon"])
    return F.aggregate(anchors, F.lit(float("inf")),
                       lambda acc, a: F.least(acc, haversine_km(lat, lon, a["lat"], a["lon"])))


def site_screening(lat: Column, lon: Column) -> dict[str, Column]:
    """Scenario-free screening inputs; compute once per site, then reuse."""
    return {"scr_wind": wind_anchor_mean(lat, lon), "scr_coast_km": coast_km(lat, lon)}


def wind_uplift(scenario: Column) -> Column:
    return A.warming_of(scenario) * A.WIND_UPLIFT_PER_C + 1.0


def wind_vector(scr_wind: Column, scenario: Column) -> dict[int, Column]:
    """Wind speed by return period on a log-return-period line."""
    v100 = scr_wind["v100"] * wind_uplift(scenario)
    at = v100 - scr_wind["slope"] * math.log(100)
    return {rp: F.greatest(at + scr_wind["slope"] * math.log(rp), F.lit(0.0))
            for rp in A.RETURN_PERIODS}


def surge_vector(scr_wind: Column, coast: Column, lat: Column, lon: Column,
                 scenario: Column) -> dict[int, Column]:
    """Coastal depth by return period, lifted by regional sea-level rise."""
    near = F.exp(coast / -40.0)
    present = F.greatest(scr_wind["v100"], F.lit(0.0)) / 74.7
    base = near * 1.8 * (present * 0.5 + 0.5)
    rise = A.sea_level_of(scenario, sea_level_region(lat, lon)) * near
    return {rp: F.greatest(base * s + rise, F.lit(0.0)) for rp, s in A.SURGE_SHAPE.items()}


def continentality(coast: Column) -> Column:
    return F.least(coast, F.lit(400.0)) / 400.0


def river_vector(coast: Column, scenario: Column) -> dict[int, Column]:
    base = (continentality(coast) * 0.7 + 0.3) * 0.8
    uplift = A.warming_of(scenario) * 0.05 + 1.0
    return {rp: base * s * uplift for rp, s in A.RIVER_SHAPE.items()}


def warm_season_rh(coast: Column) -> Column:
    return F.least(F.exp(coast / -60.0) * 0.35 + 0.45, F.lit(0.80))


# Heat-index regression coefficients (deg F, relative humidity in percent).
_HI = {"one": -42.379, "t": 2.04901523, "r": 10.14333127, "tr": -0.22475541, "tt": -6.83783e-3,
       "rr": -5.481717e-2, "ttr": 1.22874e-3, "trr": 8.5282e-4, "ttrr": -1.99e-6}


def heat_index_c(t_c: Column, rh: Column) -> Column:
    """Feels-like temperature from dry-bulb C and relative humidity 0..1."""
    t, r = t_c * 9.0 / 5.0 + 32.0, rh * 100.0
    simple = (t + 61.0 + (t - 68.0) * 1.2 + r * 0.094) * 0.5
    full = (t * _HI["t"] + r * _HI["r"] + t * r * _HI["tr"] + t * t * _HI["tt"] + r * r * _HI["rr"]
            + t * t * r * _HI["ttr"] + t * r * r * _HI["trr"] + t * t * r * r * _HI["ttrr"] + _HI["one"])
    return (F.when(simple >= 80.0, full).otherwise(simple) - 32.0) * 5.0 / 9.0


def dry_bulb_for(target_c: float, rh: Column) -> Column:
    """Dry-bulb temperature whose heat index is the target.

    For a given humidity the regression is a quadratic in temperature, so the threshold is
    its larger root and needs no search.
    """
    r, target = rh * 100.0, target_c * 9.0 / 5.0 + 32.0
    a = r * _HI["ttr"] + r * r * _HI["ttrr"] + _HI["tt"]
    b = r * _HI["tr"] + r * r * _HI["trr"] + _HI["t"]
    c = r * _HI["r"] + r * r * _HI["rr"] + (_HI["one"] - target)
    root = (F.sqrt(b * b - a * c * 4.0) - b) / (a * 2.0)
    other = (-b - F.sqrt(b * b - a * c * 4.0)) / (a * 2.0)
    return (F.greatest(root, other) - 32.0) * 5.0 / 9.0


def half_up(x: Column) -> Column:
    """Nearest whole number, halves upward."""
    return F.floor(x + 0.5).cast("double")


def heat_indicators(lat: Column, coast: Column, scenario: Column, covered: Column,
                    g32: Column, g35: Column, gcdd: Column) -> Column:
    """Hot-day indicators: the grid where it reaches the site, else a latitude climatology."""
    rh = warm_season_rh(coast)
    threshold = dry_bulb_for(35.0, rh)
    d32, d35, cdd = half_up(g32), half_up(g35), half_up(gcdd)
    between = half_up(d35 + (d32 - d35) * (F.lit(35.0) - threshold) / 3.0)
    humid = F.when(threshold >= 35.0, d35).when(threshold <= 32.0, d32).otherwise(between)
    t = (F.lit(34.0) - (F.abs(lat) - 18.0) * 0.35 + continentality(coast) * 6.0
         + A.warming_of(scenario))
    days = lambda limit: half_up(F.lit(200.0) / (F.exp(-(t - limit) / 1.6) + 1.0))
    p = F.least(F.greatest(d35, F.lit(0.5)), F.lit(199.5)) / 200.0
    eff = F.when(covered, F.round(F.log(p / (F.lit(1.0) - p)) * 1.6 + 35.0, 1)).otherwise(F.round(t, 1))
    out32 = F.when(covered, d32).otherwise(days(F.lit(32.0)))
    return F.struct(
        out32.alias("days_over_32"),
        F.when(covered, d35).otherwise(days(F.lit(35.0))).alias("days_over_35"),
        F.when(covered, cdd).otherwise(half_up(F.greatest(t - 18.0, F.lit(0.0)) * 210.0)).alias("cdd"),
        F.when(covered, F.greatest(humid, d35))
        .otherwise(F.greatest(days(threshold), days(F.lit(35.0)))).alias("days_humid_35"),
        eff.alias("effective_c"),
        heat_band(out32).alias("band"))


def wui_percent(wui_class: Column) -> Column:
    """Interim annual burn percent by wildland-urban class, 0 elsewhere."""
    return A.lookup(F.lower(wui_class), A.FIRE_WUI_PERCENT, 0.0)


def fire_uplift(scenario: Column) -> Column:
    return A.warming_of(scenario) * A.FIRE_UPLIFT_PER_C + 1.0
