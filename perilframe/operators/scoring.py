"""Portfolio scoring on the hazard grid: one wide row per site and scenario.

The grid lookup is the only join. After it every peril of a site sits in the same row, so
damage, finance and adaptation are column arithmetic with no further shuffle.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import assumptions as A
from ..functions import interim, profile
from ..functions.common import by_shuffle, clamp, share, total
from ..functions.curves import (band_of, batch_integral, depth_at_structure, flood_damage, ponding_depth,
                                wind_damage)
from ..functions.geo import in_regions, relief
from .spatial import nearest

RPS = A.RETURN_PERIODS
PLACE = ["latitude", "longitude"]


def _vector(column: str) -> dict[int, Column]:
    return {rp: F.get(F.col(column), F.lit(i)) for i, rp in enumerate(RPS)}


def _array(by_rp: dict[int, Column]) -> Column:
    return F.array(*[by_rp[rp] for rp in RPS])


def grid_layers(grid: DataFrame) -> dict[str, list[str]]:
    """Hazard -> scenarios present in a grid: at most hazards x scenarios pairs of metadata.

    Layers outside the two vocabularies serve no site and are left out; unknown_layers lists them.

    Pass the provenance sidecar's layers instead where there is one; then the grid is not read.
    """
    rows = grid.where(F.col("hazard").isin(*A.HAZARDS) & F.col("scenario").isin(*A.SCENARIOS)).select("hazard", "scenario").distinct().collect()
    out: dict[str, list[str]] = {}
    for r in rows:
        out.setdefault(r.hazard, []).append(r.scenario)
    return out


def unknown_layers(grid: DataFrame) -> DataFrame:
    """(hazard, scenario, cells) of a grid's layers that the vocabularies don't have."""
    known = F.coalesce(F.col("hazard").isin(*A.HAZARDS) & F.col("scenario").isin(*A.SCENARIOS), F.lit(False))
    return grid.where(~known).groupBy("hazard", "scenario").agg(F.count(F.lit(1)).alias("cells"))


def cell_sets(cells: DataFrame) -> dict[tuple[str, str], tuple[str, str]]:
    """For each (hazard, grid_scenario), the first one whose cells are the same.

    Sets are told apart by their size, sum and xor of cell hashes; there are as many rows as layers, which the
    vocabularies bound.
    """
    print_ = F.xxhash64("lat", "lon")
    rows = (cells.groupBy("hazard", "grid_scenario").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(print_).alias("x"), F.sum(print_.cast("decimal(20,0)")).alias("s"))
            .orderBy("hazard", "grid_scenario").collect())
    found: dict[tuple, tuple[str, str]] = {}
    return {(r.hazard, r.grid_scenario): found.setdefault((r.n, r.x, r.s), (r.hazard, r.grid_scenario)) for r in rows}


def grid_lookup(sites: DataFrame, grid: DataFrame, scenarios: list[str], deg: float = A.GRID_DEG,
                layers: dict[str, list[str]] | None = None) -> DataFrame:
    """Nearest grid cell per site, hazard and scenario, within the snap limit.

    Result: site_key, scenario and one struct(covered, dist_km, v) per hazard.
    """
    found = location_lookup(sites, grid, scenarios, deg, layers)
    return (sites.select("site_key", "latitude", "longitude").distinct()
            .join(by_shuffle(found), ["latitude", "longitude"]).drop("latitude", "longitude"))


def location_lookup(sites: DataFrame, grid: DataFrame, scenarios: list[str], deg: float = A.GRID_DEG,
                    layers: dict[str, list[str]] | None = None) -> DataFrame:
    """Nearest grid cell per distinct location of the sites, hazard and scenario, within the snap limit.

    A hazard that lacks a scenario is read from its present-day cells. Sites of one location meet its single row at the
    end, so that no step before it repeats a cell for each of them.
    Result: latitude, longitude, scenario and one struct(covered, dist_km, v) per hazard.
    """
    layers = layers or grid_layers(grid)
    serves: dict[tuple[str, str], list[str]] = {}
    for h in A.HAZARDS:
        for sc in scenarios:
            from_sc = sc if sc in layers.get(h, []) else "present"
            if from_sc in layers.get(h, []):
                serves.setdefault((h, from_sc), []).append(sc)
    key = F.concat_ws("|", "hazard", "grid_scenario")
    cells = grid.withColumnRenamed("scenario", "grid_scenario").where(key.isin([f"{h}|{g}" for h, g in serves]))
    cells = cells.withColumn("centroid_id", F.struct("lat", "lon"))
    # Layers of the same cells are looked up once, by the first of them.
    leaders = cell_sets(cells)
    asked = [{"hazard": h, "grid_scenario": g} for h, g in dict.fromkeys(leaders.values())]
    if not asked:
        asked, leaders = [{"hazard": h, "grid_scenario": g} for h, g in serves], {k: k for k in serves}
    places = sites.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).select("latitude", "longitude").distinct()
    points = places.select(*PLACE, F.explode(F.expr(A.sql_literal(asked))).alias("_a")).select(*PLACE, "_a.*")
    first = cells.where(key.isin([f"{a['hazard']}|{a['grid_scenario']}" for a in asked]))
    followers: dict[str, list[dict]] = {}
    for (h, g), (lead_h, lead_g) in leaders.items():
        followers.setdefault(f"{lead_h}|{lead_g}", []).append({"hazard": h, "grid_scenario": g})
    near = nearest(points, first, deg=deg, by=("hazard", "grid_scenario")).where("covered")
    same = F.explode(F.try_element_at(A.constant_map({k: v for k, v in followers.items()}), key)).alias("_a")
    near = near.select(*PLACE, "centroid_id", "dist_km", "covered", same).select(*PLACE, "centroid_id", "dist_km", "covered", "_a.*")
    vec = cells.select("hazard", "grid_scenario", "centroid_id",
                       F.array(*[F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(0.0)) for c in A.V_COLS]).alias("v"))
    hit = near.join(by_shuffle(vec), ["hazard", "grid_scenario", "centroid_id"])
    used_by = F.try_element_at(A.constant_map({f"{h}|{g}": list(v) for (h, g), v in serves.items()}), key)
    hit = hit.withColumn("scenario", F.explode(used_by))
    cell = F.struct(F.col("covered"), F.col("dist_km"), F.col("v"))
    return hit.groupBy(*PLACE, "scenario").agg(
        *[F.first(F.when(F.col("hazard") == h, cell), ignorenulls=True).alias(h) for h in A.HAZARDS])


def site_hazards(sites: DataFrame, grid: DataFrame | None, scenarios: list[str], deg: float = A.GRID_DEG,
                 layers: dict[str, list[str]] | None = None) -> DataFrame:
    """Sites x scenarios with per-peril intensities, grid first, screening model where none reaches.

    Sites are dealt out first: a portfolio is a small file, whose few read tasks would do all the screening.
    """
    screened = sites.repartition("site_key").select("*", *[c.alias(n) for n, c in
                                   interim.site_screening(F.col("latitude"), F.col("longitude")).items()])
    rows = A.each_scenario(screened, scenarios)
    if grid is not None:
        rows = rows.join(by_shuffle(location_lookup(sites, grid, scenarios, deg, layers)), [*PLACE, "scenario"], "left").select(*rows.columns, *A.HAZARDS)
    else:
        empty = "struct<covered:boolean,dist_km:double,v:array<double>>"
        rows = rows.select("*", *[F.lit(None).cast(empty).alias(h) for h in A.HAZARDS])
    lat, lon, sc = F.col("latitude"), F.col("longitude"), F.col("scenario")
    covered = {h: F.coalesce(F.col(f"{h}.covered"), F.lit(False)) for h in A.HAZARDS}
    rise = relief(F.col("ground_elev_m"), F.col("cell_ground_elev_m"), A.RELIEF_CLAMP_M)

    def depth(h: str, screen: dict[int, Column]) -> Column:
        raw = F.when(covered[h], F.col(f"{h}.v")).otherwise(_array(screen))
        return F.transform(raw, lambda d: depth_at_structure(d, rise))

    wui = interim.wui_percent(F.col("wui_class"))
    v = lambda h, i: F.get(F.col(f"{h}.v"), F.lit(i))
    zeros = F.array(*[F.lit(0.0) for _ in RPS])
    surge = interim.surge_vector(F.col("scr_wind"), F.col("scr_coast_km"), lat, lon, sc)
    out = rows.select(
        *rows.columns, *[covered[h].alias(f"on_{h}") for h in A.HAZARDS],
        F.when(covered["tc"], F.col("tc.v")).otherwise(_array(interim.wind_vector(F.col("scr_wind"), sc))).alias("i_tc"),
        depth("cflood", surge).alias("i_cflood"),
        depth("rflood", interim.river_vector(F.col("scr_coast_km"), sc)).alias("i_rflood"),
        F.when(covered["prain"], F.col("prain.v")).otherwise(zeros).alias("i_mm"),
        F.when(covered["wfire"], clamp(v("wfire", 0), 0.0, 100.0))
        .otherwise(wui * interim.fire_uplift(sc)).alias("fire_pct"),
        F.when(covered["wfire"] & (v("wfire", 1) > 0.0), F.least(v("wfire", 1) / 100.0, F.lit(1.0)))
        .otherwise(A.FIRE_COND_INTERIM).alias("fire_cond"),
        (wui > 0.0).alias("has_wui"),
        interim.heat_indicators(lat, F.col("scr_coast_km"), sc, covered["heat"], v("heat", 0), v("heat", 1),
                                v("heat", 2)).alias("heat_ind"))
    # Rows of one location come out of one task. Dealt out again, they are scored by all; the shuffle also keeps screening and
    # damage in separate stages, since fused into one generated method they pass the size the JVM compiles.
    return out.drop(*A.HAZARDS, "scr_wind", "scr_coast_km").withColumn("relief_m", rise).repartition("site_key", "scenario")


NEUTRAL = {"k_haz": 1.0, "k_dmg": 1.0, "k_exp": 1.0, "k_rev": 1.0, "k_reopen": 1.0, "k_tc": 1.0,
           "k_fb": 0.0, "k_red": 0.0, "k_fire": 1.0, "k_heat": 1.0}


def _knob(name: str, given: dict[str, Column] | None) -> Column:
    return given[name] if given and name in given else F.lit(NEUTRAL[name])


def peril_fractions(knobs: dict[str, Column] | None = None) -> dict[str, dict]:
    """Damage rungs per acute peril for a site row and optional knobs, and the annual fraction of fire.

    One formula serves the base view, measures and sensitivity: with neutral knobs it is the base. The annual fractions of
    the other perils are those of annual_fractions.
    """
    haz, dmg = _knob("k_haz", knobs), _knob("k_dmg", knobs)
    bonus = _knob("k_fb", knobs)
    scaled = lambda col, f=(lambda x: x): {rp: f(x * haz) for rp, x in _vector(col).items()}
    one = F.lit(1.0)
    mult = F.col("wind_mult") * _knob("k_tc", knobs) * dmg
    wind = lambda x: F.least(wind_damage(x, F.col("v_half")) * mult, one)
    flood = lambda fb: lambda x: F.least(flood_damage(F.greatest(x, F.lit(0.0)), fb + bonus, F.col("flood_cap")) * dmg, one)
    red = _knob("k_red", knobs)
    plan = {
        "tc": (scaled("i_tc"), wind),
        "cflood": (scaled("i_cflood", lambda x: F.greatest(x - red, F.lit(0.0))), flood(F.col("fb_coast"))),
        "rflood": (scaled("i_rflood"), flood(F.col("fb_river"))),
        "prain": (scaled("i_mm", ponding_depth), flood(F.col("fb_rain"))),
    }
    out = {p: {"rungs": {rp: f(x) for rp, x in vec.items()}} for p, (vec, f) in plan.items()}
    given = F.col("fire_cond") * F.col("fire_vuln") * dmg * _knob("k_fire", knobs)
    burn = F.least(F.col("fire_pct") / 100.0 * haz, one)
    out["wfire"] = {"annual": burn * given,
                    "rungs": {rp: F.when(F.col("fire_pct") >= 100.0 / rp, given).otherwise(0.0) for rp in RPS}}
    return out


_GRADED = ["tc", "cflood", "rflood", "prain"]  # perils with an intensity vector


def annual_fractions(knobs: dict[str, Column] | None = None) -> Column:
    """struct(tc, cflood, rflood, prain): expected annual damage fractions of a site row under optional knobs.

    The same formulas as the rungs, integrated over frequency with the vector extended below 1-in-10. They run over Arrow
    batches: as Column expressions they are interpreted value by value, for every site, scenario and knob set.
    """
    vectors = [F.get(F.col(c), F.lit(i)) for c in ("i_tc", "i_cflood", "i_rflood", "i_mm") for i in range(len(RPS))]
    site = [F.col(c) for c in ("wind_mult", "v_half", "fb_coast", "fb_river", "fb_rain", "flood_cap")]
    knob = [_knob(k, knobs) for k in ("k_haz", "k_dmg", "k_fb", "k_red", "k_tc")]
    return _annual_udf()(*[c.cast("double") for c in [*vectors, *site, *knob]])


@cache
def _annual_udf():
    n, perils, integral = len(RPS), list(_GRADED), batch_integral()
    thresh, drain, pond = A.V_THRESH, A.RAIN_DRAIN_MM, A.RAIN_POND

    @F.pandas_udf(", ".join(f"{p} double" for p in _GRADED))
    def annual(*given: pd.Series) -> pd.DataFrame:
        cols = [c.to_numpy(float) for c in given]
        raw = [np.stack(cols[i * n:(i + 1) * n]) for i in range(len(perils))]
        mult, v_half, coast, river, rain, cap, haz, dmg, bonus, red, k_tc = cols[len(perils) * n:]
        # fmax and fmin pass over a missing value as greatest and least do
        wind = lambda x: np.fmin((1.0 - 1.0 / (np.fmax((x - thresh) / (v_half - thresh), 0.0) ** 3.0 + 1.0)) * (mult * k_tc * dmg), 1.0)

        def flood(fb):
            over = lambda x: np.fmax(np.fmax(x, 0.0) - (fb + bonus), 0.0)
            return lambda x: np.fmin(np.fmin(cap, 1.0 - np.exp(over(x) * -0.6)) * dmg, 1.0)

        vec = [x * haz for x in raw]
        vec[1] = np.fmax(vec[1] - red, 0.0)
        vec[3] = np.fmax(vec[3] - drain, 0.0) / 1000.0 * pond
        curves = [wind, flood(coast), flood(river), flood(rain)]
        with np.errstate(all="ignore"):
            return pd.DataFrame({p: integral(v, f) for p, v, f in zip(perils, vec, curves, strict=True)})

    return annual


def score(hazards: DataFrame, keep_curves: bool = True) -> DataFrame:
    """Add per peril f_<peril> (annual fraction), ead_<peril>, loss_<peril> (array by return period)."""
    fr = peril_fractions()
    value = F.col("asset_value_usd")
    df = (hazards.select("*", annual_fractions().alias("_f"), fr["wfire"]["annual"].alias("f_wfire"))
          .select(*hazards.columns, *[F.col(f"_f.{p}").alias(f"f_{p}") for p in _GRADED], "f_wfire"))
    cols = [(F.col(f"f_{p}") * value).alias(f"ead_{p}") for p in A.ACUTE]
    if keep_curves:
        cols += [F.array(*[fr[p]["rungs"][rp] * value for rp in RPS]).alias(f"loss_{p}") for p in A.ACUTE]
    df = df.select("*", *cols)
    ead = total([F.col(f"ead_{p}") for p in A.ACUTE])
    return (df.withColumn("ead", ead)
            .withColumn("ead_pct", F.when(value != 0.0, F.col("ead") / value * 100.0).otherwise(0.0))
            .withColumn("band", band_of(F.col("ead_pct"))))


def by_hazard(scored: DataFrame, *carry: str) -> DataFrame:
    """Long frame: one row per site, scenario and hazard with ead, ead_pct, band and basis."""
    acute = [F.struct(F.lit(p).alias("hazard"), F.col(f"ead_{p}").alias("ead"),
                      (F.col(f"f_{p}") * 100.0).alias("ead_pct"), band_of(F.col(f"f_{p}") * 100.0).alias("band"),
                      basis(p).alias("basis")) for p in A.ACUTE]
    heat = F.struct(F.lit("heat").alias("hazard"), F.lit(0.0).alias("ead"), F.lit(0.0).alias("ead_pct"),
                    F.col("heat_ind.band").alias("band"), basis("heat").alias("basis"))
    keep = ["site_key", "scenario", *carry]
    return scored.select(*keep, F.explode(F.array(*acute, heat)).alias("_h")).select(*keep, "_h.*")


def basis(hazard: str) -> Column:
    """What a site's figure stands on: grid, interim model, or no data."""
    on = F.col(f"on_{hazard}")
    if hazard == "wfire":
        return F.when(on, "grid").when(F.col("has_wui"), "interim").otherwise("none")
    return F.when(on, "grid").otherwise("none" if hazard == "prain" else "interim")


def modelled_count() -> Column:
    return total([F.col(f"on_{h}").cast("int") for h in A.HAZARDS])


def hazard_source() -> Column:
    """grid:a+b|interim:c|none:d, with a dash for an empty group."""
    def group(kind: str) -> Column:
        names = F.array_compact(F.array(*[F.when(basis(h) == kind, F.lit(h)) for h in A.HAZARDS]))
        text = F.array_join(names, "+")
        return F.concat(F.lit(kind + ":"), F.when(text == "", "-").otherwise(text))
    return F.concat_ws("|", group("grid"), group("interim"), group("none"))


def export_source() -> Column:
    n = modelled_count()
    full = len(A.HAZARDS)
    return F.when(n == full, "hazard_grid").otherwise(
        F.concat(F.lit("hazard_grid_degraded_"), n.cast("string"), F.lit(f"of{full}")))


def dominant(prefix: str = "ead_", perils: list[str] = A.ACUTE) -> Column:
    """Peril with the largest value; the first in peril order on ties, up to rounding noise."""
    top = F.greatest(*[F.col(prefix + p) for p in perils])
    out = F
    for p in perils:
        out = out.when(F.col(prefix + p) >= top - F.abs(top) * 1e-12, F.lit(p))
    return out.otherwise(None)


def loss_at(rp: int, perils: list[str] = A.ACUTE) -> Column:
    """Loss of all acute perils at one return period."""
    i = RPS.index(rp)
    return total([F.get(F.col(f"loss_{p}"), F.lit(i)) for p in perils])


def portfolio_by_hazard(scored: DataFrame) -> DataFrame:
    """Insured value, expected damage, share of value and summed return-period losses per hazard."""
    cells = [F.struct(F.lit(p).alias("hazard"), F.col(f"ead_{p}").alias("ead"), F.col(f"loss_{p}").alias("loss"))
             for p in A.ACUTE]
    long = scored.select("scenario", "asset_value_usd", F.explode(F.array(*cells)).alias("_h"))
    agg = long.groupBy("scenario", "_h.hazard").agg(
        F.sum("asset_value_usd").alias("tiv"), F.sum("_h.ead").alias("ead"),
        *[F.sum(F.get("_h.loss", F.lit(i))).alias(f"loss_rp{rp}") for i, rp in enumerate(RPS)])
    return agg.withColumn("ead_pct", share(F.col("ead"), F.col("tiv")) * 100.0)


def driver_shares(scored: DataFrame) -> DataFrame:
    """Portfolio damage split by peril."""
    sums = scored.groupBy("scenario").agg(*[F.sum(f"ead_{p}").alias(p) for p in A.ACUTE])
    whole = total([F.col(p) for p in A.ACUTE])
    cells = [F.struct(F.lit(p).alias("hazard"), F.col(p).alias("ead"), share(F.col(p), whole).alias("share"))
             for p in A.ACUTE]
    return sums.select("scenario", F.explode(F.array(*cells)).alias("_h")).select("scenario", "_h.*")


def group_rollup(scored: DataFrame) -> DataFrame:
    """Brand, named-insured and portfolio rollups in one pass (grouping sets)."""
    df = scored.select(
        "scenario", F.coalesce("brand", F.lit("Unbranded")).alias("brand"),
        profile.insured_of(F.col("named_insured")).alias("insured"), "asset_value_usd", "ead",
        *[f"ead_{p}" for p in A.ACUTE], F.col("heat_ind.days_over_32").alias("days"))
    agg = (df.groupingSets([("scenario", "brand"), ("scenario", "insured"), ("scenario",)],
                           "scenario", "brand", "insured")
           .agg(F.grouping("brand").alias("_gb"), F.grouping("insured").alias("_gi"),
                F.count("*").alias("n"), F.sum("asset_value_usd").alias("tiv"), F.sum("ead").alias("ead"),
                *[F.sum(f"ead_{p}").alias(f"ead_{p}") for p in A.ACUTE], F.max("days").alias("heat_days")))
    level = F.when(F.col("_gb") == 0, "brand").when(F.col("_gi") == 0, "insured").otherwise("portfolio")
    pct = share(F.col("ead"), F.col("tiv")) * 100.0
    return agg.select("scenario", level.alias("level"),
                      F.coalesce("brand", "insured", F.lit("all")).alias("name"), "n", "tiv", "ead",
                      *[f"ead_{p}" for p in A.ACUTE], "heat_days", pct.alias("ead_pct"), band_of(pct).alias("band"))


def band_migration(scored: DataFrame) -> DataFrame:
    """Damage, change against present, and sites per band, one row per scenario."""
    agg = scored.groupBy("scenario").agg(
        F.sum("ead").alias("ead"), F.sum("asset_value_usd").alias("tiv"),
        *[F.count_if(F.col("band") == b).alias(b.lower()) for b in ["Minimal", "Low", "Moderate", "High", "Severe"]])
    base = agg.where(F.col("scenario") == "present").select(F.col("ead").alias("_present"), F.lit(1).alias("_k"))
    out = agg.withColumn("_k", F.lit(1)).join(F.broadcast(base), "_k", "left")
    return (out.withColumn("ead_pct", share(F.col("ead"), F.col("tiv")) * 100.0)
            .withColumn("vs_present_pct", F.when(F.col("_present") > 0.0, (F.col("ead") / F.col("_present") - 1.0) * 100.0))
            .drop("_present", "_k"))


def most_common(df: DataFrame, keys: list[str], column: str, order: str = "site_key") -> DataFrame:
    """Most frequent non-blank value per key; ties go to the value seen first."""
    text = F.trim(F.col(column))
    counts = (df.where(text != "").groupBy(*keys, text.alias(column))
              .agg(F.count("*").alias("_n"), F.min(order).alias("_o")))
    return counts.groupBy(*keys).agg(F.max_by(column, F.struct("_n", -F.col("_o"))).alias(column))


def site_groups(scored: DataFrame) -> DataFrame:
    """One row per physical site: value, damage by peril, band, display name, brand and trust.

    Trust is read on the member with the largest value.
    """
    df = scored.withColumn("group_key", profile.site_group_key(F.col("site_id"), F.col("latitude"), F.col("longitude")))
    k = ["scenario", "group_key"]
    first = F.struct("site_key", "latitude", "longitude", "name")
    agg = df.groupBy(*k).agg(
        F.count("*").alias("members"), F.sum("asset_value_usd").alias("value"), F.sum("ead").alias("ead"),
        *[F.sum(f"ead_{p}").alias(f"ead_{p}") for p in A.ACUTE],
        F.max("heat_ind.days_over_32").alias("heat_days"), F.min_by(first, "site_key").alias("_first"),
        F.max_by(modelled_count(), F.struct("asset_value_usd", -F.col("site_key"))).alias("modelled"),
        F.max_by("site_key", F.struct("asset_value_usd", -F.col("site_key"))).alias("lead_site"))
    named = most_common(df, k, "site_name")
    plain = most_common(df, k, "name").withColumnRenamed("name", "_name")
    brand = most_common(df, k, "brand")
    pct = share(F.col("ead"), F.col("value")) * 100.0
    out = agg.join(named, k, "left").join(plain, k, "left").join(brand, k, "left")
    return out.select(
        *k, F.coalesce("site_name", "_name", "_first.name").alias("name"), F.coalesce("brand", F.lit("")).alias("brand"),
        F.col("_first.latitude").alias("latitude"), F.col("_first.longitude").alias("longitude"), "members", "value",
        "ead", *[f"ead_{p}" for p in A.ACUTE], "heat_days", pct.alias("ead_pct"), band_of(pct).alias("band"),
        F.when(F.greatest(*[F.col(f"ead_{p}") for p in A.ACUTE]) > 0.0, dominant()).alias("dominant"),
        "modelled", "lead_site")


def group_insured(scored: DataFrame) -> DataFrame:
    """Who carries the damage inside each physical site."""
    df = scored.withColumn("group_key", profile.site_group_key(F.col("site_id"), F.col("latitude"), F.col("longitude")))
    by = df.groupBy("scenario", "group_key", profile.insured_of(F.col("named_insured")).alias("insured")).agg(
        F.count("*").alias("n"), F.sum("asset_value_usd").alias("value"), F.sum("ead").alias("ead"))
    whole = by.groupBy("scenario", "group_key").agg(F.sum("ead").alias("_whole"))
    pct = share(F.col("ead"), F.col("value")) * 100.0
    return (by.join(whole, ["scenario", "group_key"])
            .select("scenario", "group_key", "insured", "n", "value", "ead", pct.alias("ead_pct"),
                    band_of(pct).alias("band"), (share(F.col("ead"), F.col("_whole")) * 100.0).alias("share_pct")))


def peril_authority(scored: DataFrame, grid: DataFrame, n_scenarios: int = len(A.SCENARIOS)) -> DataFrame:
    """Per hazard: cells, scenarios, sites reached, and whether the layer is complete."""
    cells = grid.groupBy("hazard").agg(F.count("*").alias("cells"), F.countDistinct("scenario").alias("scenarios"))
    pairs = [F.struct(F.lit(h).alias("hazard"), F.col(f"on_{h}").alias("on")) for h in A.HAZARDS]
    reach = (scored.select(F.explode(F.array(*pairs)).alias("_h")).groupBy("_h.hazard")
             .agg(F.count_if("_h.on").alias("sites_modelled"), F.count("*").alias("sites")))
    out = reach.join(F.broadcast(cells), "hazard", "left").fillna(0, ["cells", "scenarios"])
    full = (F.col("scenarios") >= n_scenarios) & (F.col("sites_modelled") == F.col("sites"))
    return out.withColumn("complete", full)


def quadrant(scored: DataFrame) -> DataFrame:
    """Capital-allocation quadrant: value against its median, damage share against 0.75 percent."""
    from .exceedance import value_at_rank
    keyed = scored.select("scenario", "site_key", F.col("asset_value_usd").alias("value"), "ead_pct")
    low = value_at_rank(keyed, ["scenario"], "value", lambda n: F.floor((n - 1) / 2).cast("long"))
    high = value_at_rank(keyed, ["scenario"], "value", lambda n: F.floor(n / 2).cast("long"))
    mid = (low.withColumnRenamed("value", "_lo").join(high.select("scenario", F.col("value").alias("_hi")), "scenario")
           .select("scenario", ((F.col("_lo") + F.col("_hi")) / 2.0).alias("median_value")))
    rich, hot = F.col("value") >= F.col("median_value"), F.col("ead_pct") >= 0.75
    label = (F.when(rich & hot, "high_value_high_loss").when(hot, "low_value_high_loss")
             .when(rich, "high_value_low_loss").otherwise("low_value_low_loss"))
    return keyed.join(F.broadcast(mid), "scenario").withColumn("quadrant", label)


def sites_outside_regions(sites: DataFrame) -> DataFrame:
    """Sites that no region box holds, to be named rather than passed over; a site without coordinates is outside."""
    inside = F.coalesce(in_regions(F.col("latitude"), F.col("longitude")), F.lit(False))
    return sites.where(~inside).select("site_key", "name", "latitude", "longitude")
