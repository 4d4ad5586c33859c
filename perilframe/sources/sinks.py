"""Exports and writers. Frames keep their frozen column order; rounding happens here only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import assumptions as A
from ..functions.common import money, share, total
from ..functions.curves import band_of
from ..functions.text import provenance
from ..operators import scoring
from ..operators.tcor import component_columns

GRID_COLUMNS = ["lat", "lon", "scenario", "hazard", *A.V_COLS]


def grid_frame(grid: DataFrame) -> DataFrame:
    """Hazard-grid artifact in its published column order."""
    return grid.select("lat", "lon", "scenario", "hazard", *[F.bround(c, 2).alias(c) for c in A.V_COLS])


def write_grid(grid: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """One folder per hazard and scenario, rows ordered by cell so that box filters skip files."""
    out = grid_frame(grid).repartitionByRange("hazard", "scenario", "lat", "lon").sortWithinPartitions("hazard", "scenario", "lat", "lon")
    writer = out.write.mode(mode).partitionBy("hazard", "scenario").format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)


def layer_counts(grid: DataFrame) -> DataFrame:
    """Provenance layers: cells per hazard and scenario."""
    return grid.groupBy("hazard", "scenario").agg(F.count("*").alias("cells"))


def sidecar(grid: DataFrame, method: str, skipped: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """One JSON row of provenance: layers of a fixed vocabulary, skipped layers with reasons."""
    layers = F.array_sort(F.collect_list(F.struct("hazard", "scenario", "cells")))
    skip = F.expr(A.sql_literal([{"hazard": h, "scenario": s, "reason": w} for h, s, w in skipped])) if skipped else F.expr("array()")
    return layer_counts(grid).agg(layers.alias("layers")).select(
        F.to_json(F.struct(F.lit(method).alias("method"), "layers", skip.alias("skipped"))).alias("value"))


def combine_sidecars(layers: list[DataFrame]) -> DataFrame:
    """Layers of several sidecars; a later one replaces an earlier one per hazard, scenario and country."""
    from ..operators.keyed import last_wins
    full = [x if "country" in x.columns else x.withColumn("country", F.lit("")) for x in layers]
    return last_wins(full, ["hazard", "scenario", "country"])


def write_fire_context(context: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Historical fire activity; its own file and columns, never a hazard layer."""
    context.select("kind", *[c for c in context.columns if c != "kind"]).write.mode(mode).option("header", True).csv(path)


def pack_sites(site_ead: DataFrame, sites: DataFrame, returns: DataFrame | None = None) -> DataFrame:
    """Per-site rows of the results pack in portfolio order, money rounded to cents."""
    df = A.each_scenario(sites.select("site_key", "name", "named_insured", "site_id")).join(site_ead, ["scenario", "site_key"], "left")
    if returns is not None:
        df = df.join(returns, ["scenario", "site_key"], "left")
    z = lambda c: money(F.coalesce(F.col(c), F.lit(0.0)))
    extra = [z(f"loss_rp{rp}").alias(f"loss_rp{rp}_usd") for rp in A.SITE_RPS] if returns is not None else []
    return df.select("scenario", "site_key", "name", F.coalesce(F.nullif(F.trim("named_insured"), F.lit("")), F.lit("Unspecified")).alias("named_insured"),
                     "site_id", z("acute").alias("direct_ead_usd"), *extra, F.struct(*[z(p).alias(p) for p in A.ACUTE]).alias("by_peril"))


def write_pack(site_rows: DataFrame, portfolio: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Results pack as two JSON datasets, one line per site and one per scenario.

    A nested document with every site inside one value would pass through one task; line-delimited
    rows carry the same content and stay distributed.
    """
    site_rows.repartition("scenario", "site_key").write.mode(mode).partitionBy("scenario").json(f"{path}/per_site")
    portfolio.write.mode(mode).json(f"{path}/portfolio")


def portfolio_export(fin: DataFrame) -> DataFrame:
    """Portfolio export: legacy perils first, appended perils last, source stated per row."""
    legacy, appended = ["tc", "cflood", "rflood"], ["wfire", "prain"]
    rating = lambda p: band_of(F.col(f"f_{p}") * 100.0)
    usd = lambda c: F.round(c if isinstance(c, Column) else F.col(c), 0)
    return fin.select(
        F.col("site_key").alias("site_id"), "name", "brand", "latitude", "longitude", "asset_value_usd", usd("revenue_usd").alias("annual_revenue_usd"),
        "construction", "year_built", "defended", "scenario", scoring.export_source().alias("hazard_source"),
        *[usd(f"ead_{p}").alias(f"ead_{p}_usd") for p in legacy], usd("ead").alias("ead_physical_total_usd"), F.round("ead_pct", 3).alias("ead_physical_pct"),
        *[rating(p).alias(f"rating_{p}") for p in legacy], F.col("heat_ind.band").alias("rating_heat"),
        F.col("heat_ind.days_over_32").alias("heat_days_over_32"), F.col("heat_ind.days_over_35").alias("heat_days_over_35"), F.col("heat_ind.cdd").alias("heat_cdd"),
        usd("direct_ead").alias("direct_damage_aal_usd"), usd("bi_ead").alias("business_interruption_aal_usd"), usd("heat_cost").alias("heat_revenue_at_risk_usd"),
        usd("total_aal").alias("total_climate_aal_usd"), F.round(share(F.col("total_aal"), F.col("revenue_usd")) * 100.0, 3).alias("total_aal_pct_revenue"),
        *[usd(F.get("direct_rp", F.lit(i))).alias(f"loss_rp{rp}_physical_usd") for i, rp in enumerate(A.RETURN_PERIODS)],
        *[usd(f"ead_{p}").alias(f"ead_{p}_usd") for p in appended], *[rating(p).alias(f"rating_{p}") for p in appended])


def broker_evidence(fin: DataFrame) -> DataFrame:
    """Renewal evidence: verified attributes beside the present-day modelled damage."""
    now = fin.where(F.col("scenario") == "present")
    return now.select(
        "name", "brand", "latitude", "longitude", "asset_value_usd", "annual_revenue_usd", "construction", "year_built", "roof_type", "roof_year",
        "opening_protection", "first_floor_elev_m", "equipment_elevated", "defended", "wui_class", "defensible_space_m", "roof_class_a",
        F.round("ead", 0).alias("modeled_direct_ead_usd_present"), scoring.dominant().alias("modeled_top_peril_present"),
        F.round(scoring.loss_at(100), 0).alias("modeled_loss_rp100_usd_present"), scoring.hazard_source().alias("hazard_source"))


def action_list(queue: DataFrame, plan: DataFrame | None = None) -> DataFrame:
    """Live actions, then the event-based plan rows. Ranks restart per source and scenario.

    Ranks come from a distributed count of better-ranked actions, not a one-task sort.
    """
    from ..operators.exceedance import cumulative
    rows = queue.withColumn("_one", F.lit(1.0))
    above = cumulative(rows, ["scenario"], "bcr", "_one").select("scenario", "bcr", "cum_before")
    live = rows.join(above, ["scenario", "bcr"]).select(
        F.lit("live_model").alias("source"), (F.col("cum_before") + 1).cast("long").alias("rank"), F.col("name").alias("site"),
        F.col("measure_name").alias("measure"), F.col("target").alias("targets"), F.round("averted", 0).alias("averted_usd_per_yr"), F.round("cost", 0).alias("cost_usd"),
        F.round("bcr", 2).alias("bcr"), F.when(F.col("funded"), "funded").otherwise("unfunded").alias("status"), "scenario")
    if plan is None:
        return live
    status = F.when(F.col("year").isNotNull(), F.concat(F.lit("year_"), F.col("year").cast("string"))).otherwise("deferred")
    packed = plan.select(F.lit("event_plan").alias("source"), F.col("position").cast("long").alias("rank"), F.col("name").alias("site"), F.col("measure_name").alias("measure"),
                         F.col("peril").alias("targets"), F.round("averted", 0).alias("averted_usd_per_yr"), F.round("cost", 0).alias("cost_usd"), F.round("bcr", 2).alias("bcr"),
                         status.alias("status"), F.lit(A.PLAN_SCENARIOS[0]).alias("scenario"))
    return live.unionByName(packed)


def tcor_export(rows: DataFrame, calibrated: Column | None = None) -> DataFrame:
    """Portfolio total-cost export with provenance per component and the missing fields named."""
    df = component_columns(rows)
    usd = lambda c: F.round(c, 0)
    return df.select(
        F.coalesce("site_id", F.col("site_key").cast("string")).alias("site_id"), "name", "brand", "campus_code", "latitude", "longitude",
        F.col("asset_value_usd").alias("tiv_usd"), "scenario", usd("total").alias("tcor_total_usd"), usd("retained_property").alias("retained_property_usd"),
        usd("c_prop").alias("retained_property_cat_usd"), usd("c_freq").alias("frequency_layer_usd"), usd("c_bi").alias("retained_bi_usd"),
        usd("bi_waiting").alias("bi_waiting_usd"), usd("bi_overage").alias("bi_overage_usd"), usd("premium").alias("premium_allocated_usd"),
        usd("premium_technical").alias("premium_technical_usd"), usd("premium_actual").alias("premium_actual_usd"), usd("c_admin").alias("admin_risk_control_usd"),
        usd("indirect").alias("indirect_flagged_excluded_usd"), F.when(F.col("estimate"), "estimate").otherwise("complete").alias("confidence"),
        F.array_join("missing", "; ").alias("missing_fields"), provenance(F.lit("event"), calibrated).alias("prov_retained_property"),
        provenance(F.lit("default terms")).alias("prov_retained_bi"), provenance(F.col("premium_basis")).alias("prov_premium"))


def decision_export(rows: DataFrame, drivers: DataFrame, best: DataFrame) -> DataFrame:
    """Decision list ranked by total cost, with driver, best opportunity and payback."""
    from ..operators.exceedance import cumulative
    df = component_columns(rows).withColumn("_one", F.lit(1.0))
    above = cumulative(df, ["scenario"], "total", "_one").select("scenario", "total", "cum_before")
    df = df.join(above, ["scenario", "total"]).join(drivers, ["scenario", "site_key"], "left").join(best, ["scenario", "site_key"], "left")
    return df.select("scenario", (F.col("cum_before") + 1).cast("long").alias("rank"), "site_key", "name", "brand", F.round("total", 0).alias("tcor_total_usd"), "dominant_component",
                     F.col("driver").alias("top_climate_driver"), F.round("driver_ead", 0).alias("driver_gross_ead_usd"), F.col("measure").alias("top_opportunity"),
                     F.round("averted", 0).alias("opportunity_averted_usd_per_yr"), F.round("cost", 0).alias("opportunity_cost_usd"),
                     F.when((F.col("averted") > 0.0) & (F.col("cost") > 0.0), F.round(F.col("cost") / F.col("averted"), 2)).alias("opportunity_payback_years"),
                     F.round("premium", 0).alias("premium_allocated_usd"), F.when(F.col("estimate"), "estimate").otherwise("complete").alias("confidence"))


def component_breakdown(rows: DataFrame) -> DataFrame:
    """Long component table: metric, component, value, basis."""
    s = component_columns(rows).groupBy("scenario").agg(
        *[F.sum(c).alias(c) for c in ("c_prop", "c_freq", "c_bi", "c_prem", "c_admin", "total", "gross_property", "bi_gross", "retained_property", "retained_bi", "indirect")])
    entry = lambda m, k, v, b: F.struct(F.lit(m).alias("metric"), F.lit(k).alias("component"), v.alias("value_usd"), F.lit(b).alias("basis"))
    c = F.col
    cells = [entry("tcor_component", k, c(f"c_{k}"), b) for k, b in (("prop", "rare_property"), ("freq", "frequent"), ("bi", "interruption"), ("prem", "premium"), ("admin", "fixed"))]
    cells += [entry("tcor_total", "total", c("total"), "sum_of_components"),
              entry("gross_modeled_loss", "gross", c("gross_property") + c("bi_gross"), "gross"),
              entry("transferred", "transfer", c("gross_property") - c("retained_property") + c("bi_gross") - c("retained_bi"), "gross_less_retained"),
              entry("indirect_flagged", "indirect", c("indirect"), "not_in_total")]
    return s.select("scenario", F.explode(F.array(*cells)).alias("_c")).select("scenario", "_c.*")


def site_detail(rows: DataFrame, drivers_long: DataFrame, opportunities: DataFrame) -> DataFrame:
    """Site detail as sections: waterfall, driver, opportunity, quality."""
    c = F.col
    entry = lambda f, v, u: F.struct(F.lit("waterfall").alias("section"), F.lit(f).alias("field"), v.alias("value"), F.lit(u).alias("unit"))
    w = [entry("gross_modeled_loss", c("gross_property"), "usd_per_yr"), entry("transferred", c("gross_property") - c("retained_property"), "usd_per_yr"),
         entry("retained_property", c("retained_property"), "usd_per_yr"), entry("frequency_layer", c("frequent"), "usd_per_yr"), entry("retained_bi", c("retained_bi"), "usd_per_yr"),
         entry("premium", c("premium"), "usd_per_yr"), entry("admin_risk_control", c("admin") + c("mitigation"), "usd_per_yr"), entry("tcor_total", c("total"), "usd_per_yr")]
    base = rows.select("scenario", "site_key", F.explode(F.array(*w)).alias("_c")).select("scenario", "site_key", "_c.*")
    drv = drivers_long.select("scenario", "site_key", F.lit("driver").alias("section"), F.col("hazard").alias("field"), F.col("ead").alias("value"), F.lit("usd_per_yr_gross_ead").alias("unit"))
    opp = opportunities.select("scenario", "site_key", F.lit("opportunity").alias("section"), F.col("measure").alias("field"), F.col("averted").alias("value"), F.lit("usd_per_yr_averted").alias("unit"))
    quality = rows.select("scenario", "site_key", F.explode("missing").alias("field")).select(
        "scenario", "site_key", F.lit("quality").alias("section"), "field", F.lit(None).cast("double").alias("value"), F.lit("missing").alias("unit"))
    return base.unionByName(drv).unionByName(opp).unionByName(quality)


def site_detail_json(rows: DataFrame) -> DataFrame:
    """One JSON text per site and scenario."""
    return rows.select("scenario", "site_key", F.to_json(F.struct(*rows.columns)).alias("value"))


def field_features(grid: DataFrame, hazard: str, scenario: str, layers: dict[str, list[str]]) -> DataFrame:
    """Map field rows of one hazard: its cells at the scenario, or at present and saying so."""
    have = layers.get(hazard, [])
    use = scenario if scenario in have else "present"
    value = F.col("v10") if hazard in ("heat", "wfire") else F.col("v100")
    note = F.lit(None if use == scenario else "present").cast("string")
    return grid.where((F.col("hazard") == hazard) & (F.col("scenario") == use)).select(
        "lon", "lat", F.greatest(value, F.lit(0.0)).alias("v"), F.lit("grid").alias("basis"), note.alias("partial_from"))


def interim_field(spark, hazard: str, scenario: str, bbox: tuple[float, float, float, float], step: float = 0.5) -> DataFrame:
    """Screening surface on a mesh where no grid is loaded; fire and rain have none by design."""
    from ..functions import interim
    lon0, lat0, lon1, lat1 = bbox
    ny, nx = round((lat1 - lat0) / step), round((lon1 - lon0) / step)
    mesh = spark.range(nx * ny).select((F.floor(F.col("id") / nx) * step + lat0 + step / 2).alias("lat"), (F.col("id") % nx * step + lon0 + step / 2).alias("lon"))
    mesh = mesh.select("*", *[c.alias(n) for n, c in interim.site_screening(F.col("lat"), F.col("lon")).items()])
    sc, false, none = F.lit(scenario), F.lit(False), F.lit(None).cast("double")
    if hazard == "tc":
        v = interim.wind_vector(F.col("scr_wind"), sc)[100]
    elif hazard == "cflood":
        v = interim.surge_vector(F.col("scr_wind"), F.col("scr_coast_km"), F.col("lat"), F.col("lon"), sc)[100]
    elif hazard == "rflood":
        v = interim.river_vector(F.col("scr_coast_km"), sc)[100]
    elif hazard == "heat":
        v = interim.heat_indicators(F.col("lat"), F.col("scr_coast_km"), sc, false, none, none, none)["days_over_32"]
    else:
        raise ValueError(f"{hazard} has no interim field; load a grid")
    return mesh.select(F.round("lon", 2).alias("lon"), F.round("lat", 2).alias("lat"), F.greatest(v, F.lit(0.0)).alias("v")).where("v > 0")
