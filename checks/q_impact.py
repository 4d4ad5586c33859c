"""Event-based queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from perilframe import assumptions as A
from perilframe.functions import profile
from perilframe.functions.curves import annuity
from perilframe.operators import exceedance, grid, keyed, losses, spatial
from perilframe.plans import impact as I
from perilframe.plans import standin as S

from .context import DEG, impact, r, rounded
from .registry import register
from .sql_parts import CTE, curve, d, hav, query, rnd, values, wind_mult, flood_mdd, wind_mdd, pond


@register("site_wind_ead", query(f"""
SELECT m.site_key, k.name, m.centroid_id, {rnd('m.km', 4)} AS dist_km, {rnd('k.wind_mult', 6)} AS wind_mult,
 {rnd('coalesce(sum(j.freq*j.wind_loss),0)', 2)} AS ead_usd
FROM site_cell m JOIN knobs k USING (site_key) LEFT JOIN (SELECT * FROM joint WHERE source='present') j ON j.site_key=m.site_key
GROUP BY m.site_key, k.name, m.centroid_id, m.km, k.wind_mult"""))
def site_wind_ead(spark, sf):
    im = impact(spark, sf)
    ead = im.source_ead.where(F.col("source") == "present").select("site_key", "tc")
    base = im.site_map.where("covered").join(im.sites.select("site_key", "name", "wind_mult"), "site_key")
    return base.join(ead, "site_key", "left").select(
        "site_key", "name", "centroid_id", r("dist_km", 4).alias("dist_km"), r("wind_mult", 6).alias("wind_mult"),
        r(F.coalesce("tc", F.lit(0.0))).alias("ead_usd"))


@register("nearest_centroid_any_distance", query(f"""
SELECT site_key, CASE WHEN km<=200 THEN centroid_id END AS centroid_id, {rnd('km', 4)} AS dist_km, km<=200 AS covered FROM site_near"""))
def nearest_any(spark, sf):
    near = spatial.nearest(S.sites(spark, sf), S.centroids(spark, sf), deg=DEG, distance_beyond=True)
    return near.select("site_key", "centroid_id", r("dist_km", 4).alias("dist_km"), "covered")


@register("water_snap", query(f"""
SELECT s.site_key, CASE WHEN w.km<=greatest(n.km,0)+10 THEN w.centroid_id END AS centroid_id, w.km<=greatest(n.km,0)+10 AS covered
FROM sites s JOIN site_cell n USING (site_key) JOIN
(SELECT site_key, centroid_id, round({hav('latitude', 'longitude', 'lat', 'lon')},6) AS km FROM sites, (SELECT DISTINCT cen.* FROM cen JOIN surge USING (centroid_id))
 QUALIFY row_number() OVER (PARTITION BY site_key ORDER BY round({hav('latitude', 'longitude', 'lat', 'lon')},6), centroid_id)=1) w USING (site_key)"""))
def water_snap(spark, sf):
    im = impact(spark, sf)
    wet = S.centroids(spark, sf).join(S.surge(spark, sf).select("centroid_id"), "centroid_id", "left_semi")
    pts = im.site_map.where("covered").select("site_key", "latitude", "longitude", F.col("dist_km").alias("wind_dist_km"))
    return spatial.water_snap(pts, wet, deg=DEG).select("site_key", "centroid_id", "covered")


@register("site_rp_ladder", query(f"""
SELECT site_key, scenario, CAST(rp AS INTEGER) AS rp, {rnd('loss', 2)} AS loss_usd FROM lad_joint WHERE loss>0"""))
def site_rp_ladder(spark, sf):
    lad = impact(spark, sf).ladders(("tc_joint",))
    rows = exceedance.explode_ladder(lad, A.LADDER_RPS)
    return rows.where(F.col("loss") > 0.0).select("site_key", "scenario", "rp", r("loss").alias("loss_usd"))


@register("frequent_ladders", query(f"""
SELECT site_key, scenario, peril, CAST(rp AS INTEGER) AS rp, {rnd('loss', 2)} AS loss_usd FROM
(SELECT site_key, scenario, 'rflood' AS peril, rp, loss FROM lad_river UNION ALL SELECT site_key, scenario, 'prain', rp, loss FROM lad_rain
 UNION ALL SELECT site_key, scenario, 'wfire', rp, CASE WHEN p>=1/CAST(rp AS DOUBLE) THEN loss ELSE 0 END FROM fire_l, {values([(x,) for x in A.LADDER_RPS])} t(rp))
WHERE loss>0"""))
def frequent_ladders(spark, sf):
    rows = exceedance.explode_ladder(impact(spark, sf).ladders(("rflood", "prain", "wfire")), A.LADDER_RPS)
    return rows.where(F.col("loss") > 0.0).select("site_key", "scenario", "peril", "rp", r("loss").alias("loss_usd"))


@register("event_ep_curve", query(f"""
SELECT scenario, CAST(rp AS INTEGER) AS rp, {rnd('loss', 0)} AS loss_usd FROM storm_curve"""))
def event_ep_curve(spark, sf):
    rows = exceedance.explode_ladder(impact(spark, sf).storm_curve(), A.RETURN_PERIODS)
    return rows.select("scenario", "rp", r("loss", 0).alias("loss_usd"))


@register("acute_ep_curves", query(f"""
SELECT scenario, peril, CAST(rp AS INTEGER) AS rp, {rnd('sum(loss)', 0)} AS loss_usd FROM
(SELECT scenario, unnest([peril,'acute']) AS peril, rp, loss FROM
 (SELECT scenario, 'joint' AS peril, rp, loss FROM storm_curve UNION ALL SELECT scenario, 'rflood', rp, loss FROM river_curve
  UNION ALL SELECT scenario, 'prain', rp, loss FROM rain_curve UNION ALL SELECT scenario, 'wfire', rp, loss FROM fire_curve)) GROUP BY 1,2,3
HAVING sum(loss)>0"""))
def acute_ep_curves(spark, sf):
    rows = exceedance.explode_ladder(impact(spark, sf).curves(), A.RETURN_PERIODS)
    return rows.where(F.col("loss") > 0.0).select("scenario", "peril", "rp", r("loss", 0).alias("loss_usd"))


@register("joint_wind_surge", query(f"""
SELECT source, event_id, site_key, {rnd('wind_loss', 2)} AS wind_usd, {rnd('surge_loss', 2)} AS surge_usd, {rnd('loss', 2)} AS joint_usd FROM joint"""))
def joint_wind_surge(spark, sf):
    return impact(spark, sf).joint.select("source", "event_id", "site_key", r("wind_loss").alias("wind_usd"),
                                          r("surge_loss").alias("surge_usd"), r("loss").alias("joint_usd"))


@register("acute_by_peril", query(f"""
SELECT scenario, peril, {rnd('aal', 0)} AS aal_usd FROM (SELECT scenario, unnest([peril,'acute']) AS peril, ead FROM site_peril) GROUP BY 1,2
""".replace("{rnd('aal', 0)}", "").replace(rnd('aal', 0), rnd('sum(ead)', 0))))
def acute_by_peril(spark, sf):
    return impact(spark, sf).portfolio_aal().select("scenario", "peril", r("aal", 0).alias("aal_usd"))


@register("site_acute_by_country", query(f"""
SELECT e.scenario, s.country, s.site_key, {rnd('coalesce(e.acute,0)', 2)} AS acute_usd FROM
(SELECT site_key, country, sc.scenario FROM sites, scen sc) s LEFT JOIN site_ead e ON e.site_key=s.site_key AND e.scenario=s.scenario
""".replace("SELECT e.scenario", "SELECT s.scenario")))
def site_acute_by_country(spark, sf):
    im = impact(spark, sf)
    every = A.each_scenario(im.sites.select("site_key", "country"))
    return every.join(im.site_ead, ["scenario", "site_key"], "left").select(
        "scenario", "country", "site_key", r(F.coalesce("acute", F.lit(0.0))).alias("acute_usd"))


@register("named_insured_rollup", query(f"""
SELECT scenario, coalesce(named_insured,'Unspecified') AS insured, {rnd('sum(acute)', 0)} AS direct_aal_usd
FROM site_ead JOIN sites USING (site_key) GROUP BY 1,2"""))
def named_insured_rollup(spark, sf):
    im = impact(spark, sf)
    rows = losses.insured_rollup(im.site_ead.withColumnRenamed("acute", "ead"), im.sites)
    return rows.select("scenario", "insured", r("direct_aal_usd", 0).alias("direct_aal_usd"))


@register("event_set_sparse", query("SELECT * FROM events_s"))
def event_set_sparse(spark, sf):
    return impact(spark, sf).event_site_loss(scenarios=["present", "ssp245_2050"]).withColumn("loss_usd", r("loss_usd"))


@register("event_set_parts", query(f"SELECT scenario, country, source, weight, {rnd('aal', 0)} AS aal_usd, {rnd('kept', 0)} AS kept_aal_usd FROM parts"))
def event_set_parts(spark, sf):
    im = impact(spark, sf)
    return rounded(losses.event_set_parts(im.joint, im.weights, im.sites), {"aal_usd": 0, "kept_aal_usd": 0})


@register("weights_normalised", query(f"SELECT scenario, source, {rnd('weight', 6)} AS weight FROM weights"))
def weights_normalised(spark, sf):
    return rounded(losses.present_weights(A.recipe_table(spark), S.catalog(spark, sf)), {"weight": 6})


_mx = I.EVENT_MEASURES


def _eval_sql(scen: str, knob: str) -> str:
    """Per (measure, site) annual damage under knob columns of table `k`."""
    w = f"(SELECT source, weight FROM weights WHERE scenario='{scen}')"
    cap = "least(k.flood_cap, coalesce(k.cap_max, 1))"
    warm = A.WARMING[scen]
    return f"""
SELECT measure, site_key, sum(e) AS e FROM (
 SELECT k.measure, k.site_key, c.freq*w.weight*least({wind_mdd('x.intensity', 'k.v_half')}*k.wind_mult*k.wind_dmg_mult,1)*k.asset_value_usd AS e
 FROM wind x JOIN cat c USING (source, event_id) JOIN {w} w USING (source) JOIN site_cell m USING (centroid_id) JOIN {knob} k USING (site_key)
 UNION ALL SELECT k.measure, k.site_key, c.freq*w.weight*{flood_mdd('greatest(x.depth-k.cf_depth_red,0)', 'k.fb_coast+k.fb_bonus', cap)}*k.asset_value_usd
 FROM surge x JOIN cat c USING (source, event_id) JOIN {w} w USING (source) JOIN site_cell m USING (centroid_id) JOIN {knob} k USING (site_key)
 UNION ALL SELECT k.measure, k.site_key, c.freq/n*{flood_mdd('x.depth', 'k.fb_river+k.fb_bonus', cap)}*k.asset_value_usd
 FROM river x JOIN cat c USING (event_id) JOIN river_n USING (scenario) JOIN site_cell m USING (centroid_id) JOIN {knob} k USING (site_key) WHERE scenario='{scen}'
 UNION ALL SELECT k.measure, k.site_key, c.freq*{flood_mdd(pond(f'x.mm*{d(1 + .07 * warm)}'), 'k.fb_rain+k.fb_bonus', cap)}*k.asset_value_usd
 FROM rain x JOIN cat c USING (event_id) JOIN site_cell m USING (centroid_id) JOIN {knob} k USING (site_key)
 UNION ALL SELECT k.measure, k.site_key, f.p*f.loss*k.fire_mult FROM fire_l f JOIN {knob} k USING (site_key) WHERE f.scenario='{scen}')
GROUP BY 1,2"""


_SC = "ssp245_2050"
_base_sql = {"base_e": f"SELECT site_key, tc, cflood, rflood, prain, wfire, acute FROM site_ead WHERE scenario='{_SC}'"}
_ev = {**_base_sql, "epairs": f"""
SELECT k.*, m.measure, m.wm AS wind_dmg_mult, m.fb AS fb_bonus, m.red AS cf_depth_red, {d(1.0)} AS fire_mult, CAST(NULL AS DOUBLE) AS cap_max, k.asset_value_usd*m.pct/100 AS cost
FROM knobs k LEFT JOIN base_e b USING (site_key) CROSS JOIN {values([(m['measure'], m['scope'], m['wind_dmg_mult'], m['fb_bonus'], m['cf_depth_red'], m['cost_pct']) for m in _mx])} m(measure, scope, wm, fb, red, pct)
WHERE CASE scope WHEN 'flood' THEN coalesce(b.cflood,0)+coalesce(b.rflood,0)>100 WHEN 'coastal' THEN coalesce(b.cflood,0)>100 ELSE true END""",
        "eafter": _eval_sql(_SC, "epairs"),
        "eav": """SELECT p.measure, p.site_key, p.cost, greatest(coalesce(b.acute,0)-coalesce(a.e,0),0) AS averted
FROM epairs p LEFT JOIN base_e b USING (site_key) LEFT JOIN eafter a ON a.measure=p.measure AND a.site_key=p.site_key"""}
_an = annuity(25, 0.03)


@register("event_measure_appraisal", query(f"""
SELECT measure, {rnd('sum(averted)', 0)} AS averted, count(*) AS sites_in_scope, {rnd('sum(cost)', 0)} AS cost,
 {rnd(f'sum(averted)*{d(_an)}/sum(cost)', 5)} AS bcr FROM eav GROUP BY 1""", _ev))
def event_measure_appraisal(spark, sf):
    im = impact(spark, sf)
    pairs = I.event_measure_pairs(im.sites, im.base_by_site(_SC))
    s = I.adaptation_summary(im.measure_averted(pairs, _SC))
    return rounded(s.select("measure", "averted", "sites_in_scope", "cost", "bcr"), {"averted": 0, "cost": 0, "bcr": 5})


_wm_metal = wind_mult("'metal'", d(2026.0), "opening_protection")
_wm_imp = wind_mult("roof_type", "roof_year", "'impact'")
_cat = {**_base_sql, "cpairs0": f"""
SELECT k.*, coalesce(b.cflood,0) AS ecf, coalesce(b.cflood,0)+coalesce(b.rflood,0) AS efl, m.*, {_wm_metal} AS wmet, {_wm_imp} AS wimp
FROM knobs k LEFT JOIN base_e b USING (site_key) CROSS JOIN {values([(k, p, m, y, pk, pct) for k, _, p, m, y, pk, pct in I.CATALOG])} m(measure, peril, modelled, life, pk, pct)""",
        "cpairs1": """
SELECT *, CASE measure
 WHEN 'reroof' THEN CASE WHEN roof_type IS NULL AND roof_year IS NULL THEN 'roof_unknown' WHEN wmet>=wind_mult-1e-9 THEN 'roof_good' END
 WHEN 'openings' THEN CASE WHEN opening_protection IS NULL THEN 'openings_unknown' WHEN opening_protection='impact' THEN 'openings_good' END
 WHEN 'tiedown' THEN CASE WHEN coalesce(construction IN ('frame','masonry'),false) AND year_built<2002 THEN NULL ELSE 'frame_not_eligible' END
 WHEN 'floodproof' THEN CASE WHEN efl<=100 THEN 'flood_below_scope' END
 WHEN 'utility' THEN CASE WHEN equipment_elevated THEN 'equipment_raised' WHEN efl<=100 THEN 'flood_below_scope' END
 WHEN 'elevate' THEN CASE WHEN stories>2 THEN 'too_tall' WHEN efl<=100 THEN 'flood_below_scope' END
 WHEN 'buffer' THEN CASE WHEN ecf<=100 THEN 'surge_below_scope' END
 WHEN 'defensible' THEN CASE WHEN wui_class IS NOT NULL AND coalesce(defensible_space_m,0)<30 THEN NULL ELSE 'outside_wui_or_clear' END
 WHEN 'roof_class_a' THEN CASE WHEN wui_class IS NOT NULL AND NOT roof_class_a THEN NULL ELSE 'outside_wui_or_class_a' END
 ELSE CASE WHEN backup_power='full' THEN 'power_backed_up' END END AS reason FROM cpairs0""",
        "cpairs": f"""
SELECT *, CASE measure WHEN 'reroof' THEN wmet/wind_mult WHEN 'openings' THEN wimp/wind_mult WHEN 'tiedown' THEN {d(.85)} ELSE 1 END AS wind_dmg_mult,
 CASE measure WHEN 'floodproof' THEN {d(.5)} WHEN 'elevate' THEN {d(1.5)} ELSE 0 END AS fb_bonus, CASE measure WHEN 'buffer' THEN {d(.3)} ELSE 0 END AS cf_depth_red,
 CASE measure WHEN 'defensible' THEN {d(.7)} WHEN 'roof_class_a' THEN {d(.6)} ELSE 1 END AS fire_mult, CASE measure WHEN 'utility' THEN {d(.5)} END AS cap_max,
 keys*pk AS cost FROM cpairs1 WHERE reason IS NULL""",
        "cafter": _eval_sql(_SC, "cpairs"),
        "cproj": f"""
SELECT p.site_key, p.name, p.measure, b.acute-coalesce(a.e,0) AS averted, p.cost, CAST(least(p.life,25) AS INTEGER) AS annuity_years,
 (b.acute-coalesce(a.e,0))*(1-power({d(1.03)},-least(p.life,25)))/{d(.03)}/p.cost AS bcr0
FROM cpairs p JOIN base_e b USING (site_key) LEFT JOIN cafter a ON a.measure=p.measure AND a.site_key=p.site_key
WHERE p.modelled AND p.cost>0 AND b.acute-coalesce(a.e,0)>1e-6"""}


@register("catalog_scope", query(f"""
SELECT site_key, measure, reason IS NULL AS applies, reason, {rnd('CASE WHEN reason IS NULL THEN keys*pk ELSE 0 END', 2)} AS cost FROM cpairs1""", _cat))
def catalog_scope(spark, sf):
    im = impact(spark, sf)
    p = I.catalog_pairs(im.sites, im.base_by_site(_SC))
    return p.select("site_key", "measure", "applies", "reason", r("cost").alias("cost"))


def catalog_averted(spark, sf):
    im = impact(spark, sf)
    pairs = I.catalog_pairs(im.sites, im.base_by_site(_SC)).where("applies")
    return im.measure_averted(pairs, _SC).where(F.col("averted") > 1e-6)


@register("catalog_projects", query(f"SELECT site_key, measure, {rnd('averted', 2)} AS averted, {rnd('cost', 2)} AS cost, annuity_years, {rnd('bcr0', 4)} AS bcr FROM cproj", _cat))
def catalog_projects(spark, sf):
    years = F.least("life", F.lit(A.HORIZON_YEARS))
    factors = {int(y): annuity(y, A.DISCOUNT_RATE) for y in (10, 20, 25)}
    av = catalog_averted(spark, sf).where(F.col("modelled") & (F.col("cost") > 0.0))
    return av.select("site_key", "measure", r("averted", 2).alias("averted"), r("cost").alias("cost"), years.alias("annuity_years"),
                     r(F.col("averted") * A.lookup(years, factors, 0.0) / F.col("cost"), 4).alias("bcr"))


@register("capital_plan_top", query(f"""
SELECT name, measure, {rnd('cost', 2)} AS cost, {rnd('bcr0', 3)} AS bcr FROM cproj ORDER BY round(bcr0,3) DESC, name, measure LIMIT 20""", _cat))
def capital_plan_top(spark, sf):
    plan = I.capital_plan(I.catalog_projects(catalog_averted(spark, sf)))
    return plan.select("name", "measure", r("cost").alias("cost"), r("bcr", 3).alias("bcr"))
