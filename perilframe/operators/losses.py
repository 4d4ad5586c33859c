"""Event losses: intensities at sites, damage, joint perils, blending over catalogs.

`event_intensity` is the one table that grows without bound. It meets the site map by centroid
once, is reduced per (catalog, event, site), and only per-catalog results meet the recipe.
Physical scaling (hazard, damage, exposure, measures) enters as optional knob columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import assumptions as A
from ..functions.common import blank_to_null, by_shuffle, money
from ..functions.curves import flood_damage, ponding_depth, wind_damage
from . import exceedance

SITE_KNOBS = ["asset_value_usd", "wind_mult", "v_half", "fb_coast", "fb_river", "fb_rain",
              "flood_cap", "fire_vuln"]


def site_intensity(intensity: DataFrame, site_map: DataFrame) -> DataFrame:
    """Intensity at each covered site; a site outside coverage simply has no rows (zero)."""
    return intensity.join(by_shuffle(site_map), "centroid_id").drop("centroid_id")


def _knob(df: DataFrame, name: str, default: float) -> Column:
    return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)


def wind_loss(df: DataFrame, v: str = "intensity") -> Column:
    frac = wind_damage(F.col(v) * _knob(df, "haz_mult", 1.0), F.col("v_half"))
    frac = F.least(frac * F.col("wind_mult") * _knob(df, "wind_dmg_mult", 1.0) * _knob(df, "dmg_scale", 1.0),
                   F.lit(1.0))
    return frac * F.col("asset_value_usd") * _knob(df, "exp_mult", 1.0)


def _flood_loss(df: DataFrame, depth: Column, freeboard: Column) -> Column:
    frac = flood_damage(depth, freeboard + _knob(df, "fb_bonus", 0.0), F.col("flood_cap"))
    return (F.least(frac * _knob(df, "dmg_scale", 1.0), F.lit(1.0)) * F.col("asset_value_usd")
            * _knob(df, "exp_mult", 1.0))


def surge_loss(df: DataFrame, depth: str = "depth") -> Column:
    d = F.greatest(F.col(depth) * _knob(df, "haz_mult", 1.0) - _knob(df, "cf_depth_red", 0.0), F.lit(0.0))
    return _flood_loss(df, d, F.col("fb_coast"))


def river_loss(df: DataFrame, depth: str = "depth") -> Column:
    d = F.greatest(F.col(depth) * _knob(df, "haz_mult", 1.0), F.lit(0.0))
    return _flood_loss(df, d, F.col("fb_river"))


def rain_loss(df: DataFrame, scenario: Column, mm: str = "mm") -> Column:
    scaled = F.col(mm) * (A.warming_of(scenario) * A.RAIN_PER_C + 1.0) * _knob(df, "haz_mult", 1.0)
    return _flood_loss(df, ponding_depth(scaled), F.col("fb_rain"))


def fire_terms(df: DataFrame, scenario: Column) -> tuple[Column, Column]:
    """(annual probability, loss given fire): warming raises the arrival rate, not the loss."""
    uplift = A.warming_of(scenario) * A.FIRE_UPLIFT_PER_C + 1.0
    p = F.least(F.col("bp") * _knob(df, "haz_mult", 1.0) * uplift, F.lit(1.0))
    frac = F.least(F.col("cond") * F.col("fire_vuln") * _knob(df, "dmg_scale", 1.0)
                   * _knob(df, "fire_mult", 1.0), F.lit(1.0))
    return p, frac * F.col("asset_value_usd") * _knob(df, "exp_mult", 1.0)


def joint_event_losses(wind: DataFrame, surge: DataFrame, keys: list[str]) -> DataFrame:
    """Wind and surge of the same event and site add; a side that is absent counts as zero.

    Inputs carry keys and `wind_loss` / `surge_loss`; the result has both and `loss`. Rows are
    stacked and summed, which needs one shuffle where a full outer join needs two.
    """
    rows = (wind.select(*keys, "wind_loss", F.lit(0.0).alias("surge_loss"))
            .unionByName(surge.select(*keys, F.lit(0.0).alias("wind_loss"), "surge_loss")))
    return (rows.groupBy(*keys).agg(F.sum("wind_loss").alias("wind_loss"), F.sum("surge_loss").alias("surge_loss"))
            .withColumn("loss", F.col("wind_loss") + F.col("surge_loss")))


def expected_annual(df: DataFrame, keys: list[str], loss: str = "loss", name: str = "ead") -> DataFrame:
    """Sum of frequency times loss."""
    return df.groupBy(*keys).agg(F.sum(F.col("freq") * F.col(loss)).alias(name))


def present_weights(recipe: DataFrame, catalog: DataFrame) -> DataFrame:
    """Recipe rows whose source exists, weights renormalised per scenario.

    A scenario blends at most two sources, so the regrouped totals are tiny.
    """
    have = catalog.select("source").distinct()
    live = F.broadcast(recipe).join(have, "source", "left_semi")
    total = live.groupBy("scenario").agg(F.sum("weight").alias("_total"))
    return live.join(F.broadcast(total), "scenario").select(
        "scenario", "source", (F.col("weight") / F.col("_total")).alias("weight"))


def blend_values(per_source: DataFrame, weights: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Weighted sum over catalogs with normalised weights; an absent row counts as zero."""
    parts = per_source.join(F.broadcast(weights), "source")
    return parts.groupBy("scenario", *keys).agg(
        *[F.sum(F.col(v) * F.col("weight")).alias(v) for v in values])


def blend_ladders(per_source: DataFrame, weights: DataFrame, keys: list[str], size: int,
                  column: str = "ladder") -> DataFrame:
    """Weighted sum of ladders rung by rung."""
    parts = per_source.join(F.broadcast(weights), "source")
    rungs = [F.sum(F.get(column, F.lit(i)) * F.col("weight")) for i in range(size)]
    return parts.groupBy("scenario", *keys).agg(F.array(*rungs).alias(column))


def add_ladders(df: DataFrame, keys: list[str], size: int, column: str = "ladder") -> DataFrame:
    """Comonotonic sum: losses add at equal return period."""
    rungs = [F.sum(F.get(column, F.lit(i))) for i in range(size)]
    return df.groupBy(*keys).agg(F.array(*rungs).alias(column))


def portfolio_curve(event_losses: DataFrame, keys: list[str], loss: str = "loss") -> DataFrame:
    """Portfolio exceedance losses: sum over sites per event, then interpolate."""
    per_event = event_losses.groupBy(*keys, "event_id", "freq").agg(F.sum(loss).alias("loss"))
    points = exceedance.loss_points(per_event, keys)
    return exceedance.interpolated_ladder(points, keys)


def sparse_events(joint: DataFrame, floor_usd: float = A.EVENT_FLOOR_USD) -> DataFrame:
    """Per-event, per-site losses worth keeping: positive frequency, loss at or above the floor.

    The event's name is its id when the catalog names it, else source:event_id.
    """
    name = F.coalesce(blank_to_null(F.col("event_name")),
                      F.concat_ws(":", "source", F.col("event_id").cast("string")))
    return (joint.where((F.col("freq") > 0.0) & (F.col("loss") >= floor_usd))
            .withColumn("event", name).withColumn("loss_usd", money(F.col("loss"))))


def event_set_parts(joint: DataFrame, weights: DataFrame, places: DataFrame, keys: list[str] = ["country"],
                    floor_usd: float = A.EVENT_FLOOR_USD) -> DataFrame:
    """One row per scenario, country and source: weight, total AAL and the AAL kept by the floor.

    Sources stay separate. places has the countries that hold sites. Weights come from the catalog alone: a source whose
    events reach no site of a country is a part of zero with its weight, so that the others are not scaled up for it.
    """
    kept = F.when((F.col("freq") > 0.0) & (F.col("loss") >= floor_usd),
                  F.col("freq") * money(F.col("loss"))).otherwise(0.0)
    per = joint.groupBy("source", *keys).agg(
        F.sum(F.col("freq") * F.col("loss")).alias("aal_usd"), F.sum(kept).alias("kept_aal_usd"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    parts = A.each_scenario(places.select(*keys).distinct()).join(weights, "scenario")
    return (parts.join(per, ["source", *keys], "left")
            .select("scenario", *keys, "source", F.bround("weight", 6).alias("weight"), zero("aal_usd"), zero("kept_aal_usd")))


def insured_rollup(site_ead: DataFrame, sites: DataFrame, keys: list[str] = ["scenario"]) -> DataFrame:
    """Direct AAL per named insured; blank names gather under Unspecified."""
    who = F.coalesce(blank_to_null(F.col("named_insured")), F.lit("Unspecified"))
    return (site_ead.join(sites.select("site_key", "named_insured"), "site_key")
            .groupBy(*keys, who.alias("insured")).agg(F.sum("ead").alias("direct_aal_usd")))


def compact_hits(hits: DataFrame, by: list[str], catalog: DataFrame) -> DataFrame:
    """Sum event frequency over equal intensities of a site before any per-sample fan-out.

    Expected annual loss only depends on (site, intensity, total frequency), so this is lossless
    and shrinks the rows that sensitivity sweeps have to repeat.
    """
    return (hits.join(by_shuffle(catalog.select("source", "event_id", "freq")), ["source", "event_id"])
            .where(F.col("freq") > 0.0).groupBy(*by).agg(F.sum("freq").alias("freq")))
