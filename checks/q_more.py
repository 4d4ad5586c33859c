"""Gates, exports, sweeps, planning, payoff and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from perilframe import assumptions as A
from perilframe.operators import adaptation as ad
from perilframe.operators import finance as fo
from perilframe.operators import claims, gates, losses, payoff, planning, sensitivity, tcor
from perilframe.operators.lineage import written
from perilframe.plans import impact as I
from perilframe.plans import standin as S
from perilframe.sources import sinks

from .context import DEG, S2, events, fin, impact, insured, location_ladders, measures, r, rounded, scored
from .q_impact import _cat, catalog_averted
from .q_score import X2, _mrows
from .q_tcor import Model
from .registry import register
from .sql_parts import CTE, d, flood_mdd, hav, pond, query, rnd, values, wind_mdd


# --- gates --------------------------------------------------------------------------------------

_cells = " UNION ALL ".join(f"SELECT '{h}' AS hazard, lat, lon FROM ucen WHERE {c}" for h, c in
                            [("tc", "true"), ("cflood", "centroid_id%2=0"), ("rflood", "centroid_id%3=0"), ("heat", "true"), ("wfire", "centroid_id%4=0"), ("prain", "true")])


@register("coverage_audit", query(f"""
SELECT hazard, site_key, name, {rnd('km', 3)} AS dist_km FROM (SELECT hazard, site_key, name, min({hav('latitude', 'longitude', 'lat', 'lon')}) AS km FROM sites, cells GROUP BY 1,2,3) WHERE km>200""", {"cells": _cells}))
def coverage_audit(spark, sf):
    df = gates.coverage_audit(S.sites(spark, sf), S.hazard_grid(spark, sf, ["present"]), deg=DEG)
    return rounded(df, {"dist_km": 3})


@register("gate_grid", query("""
SELECT 'missing_scenarios' AS "check", 'prain' AS hazard, 'all' AS scenario, 'warn' AS severity, CAST(9 AS DOUBLE) AS value FROM (SELECT count(*) AS n FROM ucen) WHERE n>0
UNION ALL SELECT 'dry_zeros_missing', h, s.scenario, 'warn', round(CAST(n AS DOUBLE)/t,6) FROM (SELECT count(*) FILTER (WHERE centroid_id%2=0) AS c, count(*) FILTER (WHERE centroid_id%3=0) AS r, count(*) AS t FROM ucen), (SELECT scenario FROM scen) s, LATERAL (SELECT unnest(['cflood','rflood']) AS h, unnest([c,r]) AS n) WHERE n<0.9*t
UNION ALL SELECT 'mostly_wet', h, 'all', 'warn', round(100*w/n,6) FROM (SELECT 'cflood' AS h, CAST(count(*) FILTER (WHERE p_size/10.0-0.8>0) AS DOUBLE) AS w, count(*) AS n FROM ucen WHERE centroid_id%2=0 UNION ALL SELECT 'rflood', count(*) FILTER (WHERE p_size/12.5-0.8>0), count(*) FROM ucen WHERE centroid_id%3=0) WHERE 100*w/n>60
"""))
def gate_grid(spark, sf):
    f = gates.grid_findings(gates.grid_stats(S.hazard_grid(spark, sf)))
    return rounded(f.where(F.col("check").isin("missing_scenarios", "dry_zeros_missing", "mostly_wet")), {"value": 6})


@register("gate_grid_all")
def gate_grid_all(spark, sf):
    """Every finding on the stand-in grid."""
    return gates.grid_findings(gates.grid_stats(S.hazard_grid(spark, sf)))


@register("gate_provenance", query("SELECT 'silent_layer' AS \"check\", 'prain' AS hazard, 'present' AS scenario, 'warn' AS severity, CAST(1 AS DOUBLE) AS value FROM (SELECT count(*) AS n FROM part) WHERE n>0 "
                                   "UNION ALL SELECT 'ghost_layer', 'prain', 'ssp585_2080', 'fail', CAST(1 AS DOUBLE) FROM (SELECT count(*) AS n FROM part) WHERE n>0"))
def gate_provenance(spark, sf):
    grid = S.hazard_grid(spark, sf)
    layers = sinks.layer_counts(grid).select("hazard", F.when((F.col("hazard") == "prain"), "ssp585_2080").otherwise(F.col("scenario")).alias("scenario"))
    return gates.provenance_findings(layers, grid)


@register("gate_pack", query("""
SELECT scenario, round(abs(sum(acute)-sum(tc+cflood+rflood+prain+wfire))/greatest(sum(acute),1),6)+0.0 AS gap FROM site_ead GROUP BY 1""".replace("+0.0", "+" + d(0.0))))
def gate_pack(spark, sf):
    e = impact(spark, sf).site_ead
    gap = F.abs(F.sum("acute") - F.sum(sum((F.col(p) for p in A.ACUTE), F.lit(0.0)))) / F.greatest(F.sum("acute"), F.lit(1.0))
    return e.groupBy("scenario").agg(r(gap, 6).alias("gap"))


@register("gate_pack_findings")
def gate_pack_findings(spark, sf):
    """Pack rules over portfolio, curves, event sets and ladders, of all scenarios and perils."""
    im = impact(spark, sf, keep=True)
    e = im.site_ead
    port = e.groupBy("scenario").agg(F.sum("acute").alias("direct_aal"), *[F.sum(p).alias(p) for p in A.ACUTE])
    sums = e.groupBy("scenario").agg(F.sum("acute").alias("site_sum"))
    curves = im.curves().where("peril = 'acute'").select("scenario", "ladder")
    parts = losses.event_set_parts(im.joint, im.weights, im.sites)
    joint = im.storm_ead.groupBy("scenario").agg(F.sum("joint").alias("joint"))
    out = gates.pack_findings(port, sums, curves).unionByName(gates.event_findings(im.event_site_loss(), parts, im.sites, joint))
    ladders = written(im.ladders())  # both rules on ladders read them
    return out.unionByName(gates.ladder_findings(ladders)).unionByName(gates.site_loss_findings(im.site_return_losses(ladders)))


@register("registry_check", query("SELECT kind, count(*) AS entries, CAST(0 AS BIGINT) AS wrong FROM (SELECT unnest(['warming','sea_level']) AS kind, unnest([9,45]) AS n), LATERAL (SELECT unnest(range(n)) AS i), (SELECT count(*) AS c FROM region) WHERE c>0 GROUP BY 1"))
def registry_check(spark, sf):
    t = A.assumption_table(spark)
    bad = gates.registry_findings(t).select(F.col("scenario"), F.col("hazard").alias("region"), F.lit(1).alias("_b"))
    live = S.table(spark, sf, "region").agg(F.count("*").alias("c")).where("c > 0")
    return t.join(bad, ["scenario", "region"], "left").join(F.broadcast(live.select(F.lit("x").alias("_x"))), F.lit("x") == F.col("_x")).groupBy("kind").agg(F.count("*").alias("entries"), F.count("_b").alias("wrong"))


# --- exports ------------------------------------------------------------------------------------

_ACUTE = "+".join(f"ead_{p}" for p in A.ACUTE)


@register("bi_export_wide", query(f"""
SELECT site_key AS site_id, scenario, {', '.join(f'{rnd(f"ead_{p}", 0)} AS ead_{p}_usd' for p in A.ACUTE)}, {rnd('ead', 0)} AS ead_physical_total_usd, {rnd('direct_ead', 0)} AS direct_damage_aal_usd,
 {rnd('bi_ead', 0)} AS business_interruption_aal_usd, {rnd('heat_cost', 0)} AS heat_revenue_at_risk_usd, d32 AS heat_days_over_32, d35 AS heat_days_over_35, cdd AS heat_cdd,
 CASE WHEN n=6 THEN 'hazard_grid' ELSE 'hazard_grid_degraded_'||n||'of6' END AS hazard_source FROM (SELECT *, {'+'.join(f'CAST(on_{h} AS INTEGER)' for h in A.HAZARDS)} AS n FROM fin)""", X2))
def bi_export_wide(spark, sf):
    df = sinks.portfolio_export(fin(spark, sf))
    cols = ["site_id", "scenario", *[f"ead_{p}_usd" for p in A.ACUTE], "ead_physical_total_usd", "direct_damage_aal_usd", "business_interruption_aal_usd", "heat_revenue_at_risk_usd",
            "heat_days_over_32", "heat_days_over_35", "heat_cdd", "hazard_source"]
    return rounded(df.select(*cols), {c: 0 for c in cols if c.endswith("_usd")})


@register("broker_evidence", query(f"""
SELECT name, {rnd('ead', 0)} AS modeled_direct_ead_usd_present, {rnd('l', 0)} AS modeled_loss_rp100_usd_present FROM sc JOIN (SELECT scenario, site_key, sum(loss) AS l FROM lrp WHERE rp=100 GROUP BY 1,2) USING (scenario, site_key) WHERE scenario='present'""", X2))
def broker_evidence(spark, sf):
    df = sinks.broker_evidence(fin(spark, sf)).select("name", "modeled_direct_ead_usd_present", "modeled_loss_rp100_usd_present")
    return rounded(df, {"modeled_direct_ead_usd_present": 0, "modeled_loss_rp100_usd_present": 0})


@register("action_list", query(f"SELECT scenario, site_key, {rnd('cost', 0)} AS cost_usd, CASE WHEN bcr>=1 THEN 'funded' ELSE 'unfunded' END AS status FROM mrow".replace("site_key", "name AS site"), _mrows))
def action_list(spark, sf):
    """Action rows with their status; ranks are left out because equal BCRs tie up to rounding."""
    q = ad.fund_at_breakeven(measures(spark, sf))
    return rounded(sinks.action_list(q).select("scenario", "site", "cost_usd", "status"), {"cost_usd": 0})


@register("tcor_export")
def tcor_export(spark, sf):
    return sinks.tcor_export(Model(spark, sf).total())


@register("field_features", query(f"SELECT lat, lon, {rnd('p_size*' + d(.5) + '+34', 4)} AS v, 'grid' AS basis FROM ucen"))
def field_features(spark, sf):
    df = sinks.field_features(S.hazard_grid(spark, sf, ["present"]), "tc", "present", S.grid_layers())
    return rounded(df.select("lat", "lon", "v", "basis"), {"v": 4})


# --- sweeps and plans ---------------------------------------------------------------------------


def _wind_rows(spark, sf):
    im = impact(spark, sf)
    return im.compact("present").where("peril = 'tc'").join(im.sites.select("site_key", "wind_mult", "asset_value_usd"), "site_key")


_vs = values([(float(40 + 5 * i),) for i in range(23)])


@register("v_half_sweep", query(f"""
SELECT v.v_half, {rnd(f"sum(c.freq*least({wind_mdd('w.intensity', 'v.v_half')}*k.wind_mult,1)*k.asset_value_usd)", 0)} AS wind_aal
FROM wind w JOIN cat c USING (source, event_id) JOIN site_cell m USING (centroid_id) JOIN knobs k USING (site_key), {_vs} v(v_half) WHERE w.source='present' GROUP BY 1""".replace("JOIN knobs k USING (site_key), ", "JOIN knobs k USING (site_key) CROSS JOIN ")))
def v_half_sweep(spark, sf):
    return rounded(sensitivity.v_half_sweep(_wind_rows(spark, sf), 5.0), {"wind_aal": 0})


_wind_now = f"wind w JOIN cat c USING (source, event_id) JOIN site_cell m USING (centroid_id) JOIN knobs k USING (site_key)"
_model = lambda v: f"sum(c.freq*least({wind_mdd('w.intensity', v)}*k.wind_mult,1)*k.asset_value_usd)"
_calib = {"fixed": "SELECT (SELECT sum(cflood+rflood) FROM site_ead WHERE scenario='present') AS f, (SELECT sum((c_acctbal+1000)*20) FROM customer) AS o, (SELECT count(*) FROM customer) AS n",
          "own": f"SELECT {_model('k.v_half')} AS a FROM {_wind_now} WHERE w.source='present'",
          "coarse": f"SELECT v, a+f AS m FROM (SELECT v.v, {_model('v.v')} AS a FROM {_wind_now} CROSS JOIN (SELECT CAST(unnest(range(40,151)) AS DOUBLE) AS v) v WHERE w.source='present' GROUP BY 1), fixed",
          "start": "SELECT max(v) AS v0 FROM coarse, fixed WHERE m>=o",
          "fine": f"SELECT v, a+f AS m FROM (SELECT v.v, {_model('v.v')} AS a FROM {_wind_now} CROSS JOIN (SELECT v0+i*{d(0.01)} AS v FROM start, (SELECT unnest(range(101)) AS i)) v WHERE w.source='present' GROUP BY 1), fixed",
          "cross_": "SELECT max(v+(m-o)/(m-k)*(w-v)) AS fit FROM (SELECT v, m, lead(v) OVER (ORDER BY v) AS w, lead(m) OVER (ORDER BY v) AS k FROM fine), fixed WHERE m>=o AND k<o"}


@register("fitted_curve", query(f"""
SELECT n AS matched, {rnd('o', 0)} AS observed_usd, {rnd('a+f', 0)} AS modelled_usd, {rnd('o/(a+f)', 5)} AS bias,
 {rnd("CASE WHEN o>=(SELECT max(m) FROM coarse) THEN 40 WHEN o<=(SELECT min(m) FROM coarse) THEN 150 ELSE fit END", 3)} AS fitted_v_half, {d(A.V_HALF)} AS published_v_half,
 NOT (o<(SELECT max(m) FROM coarse) AND o>(SELECT min(m) FROM coarse)) AS clipped, NOT (o/(a+f) BETWEEN 0.5 AND 2) AS review FROM fixed, own, cross_""", _calib))
def fitted_curve(spark, sf):
    """Half-damage speed fitted to the observed losses of all sites, with the bias of the model as it is."""
    im = impact(spark, sf)
    rows = im.compact("present").where("peril = 'tc'").join(im.sites.select("site_key", "wind_mult", "v_half", "asset_value_usd"), "site_key")
    flood = im.site_ead.where("scenario = 'present'").select("site_key", (F.col("cflood") + F.col("rflood")).alias("flood_usd"))
    pairs = claims.backtest(im.site_ead.where("scenario = 'present'").select("site_key", F.col("acute").alias("ead")), im.sites, S.observed(spark, sf))
    df = sensitivity.calibration(rows, flood, pairs)
    return rounded(df, {"observed_usd": 0, "modelled_usd": 0, "bias": 5, "fitted_v_half": 3})


_u = lambda k: (f"({d(A.MC_FACTORS[k][0])}+(CAST((((i+1)*{sensitivity.DRAWS[k][1]})%{sensitivity.PRIME}*(i+1+{sensitivity.DRAWS[k][2]}))%{sensitivity.PRIME} AS DOUBLE)/{d(float(sensitivity.PRIME))})"  # noqa: E731
                f"*({d(A.MC_FACTORS[k][1])}-{d(A.MC_FACTORS[k][0])}))")


def _factor_sql(scen: str, table: str) -> str:
    """Annual damage of every peril for each row (id, h, g, e) of a table of factors."""
    w = f"(SELECT source, weight FROM weights WHERE scenario='{scen}')"
    at = f"JOIN site_cell m USING (centroid_id) JOIN knobs k USING (site_key) CROSS JOIN {table} s"
    flood = lambda depth, fb: f"least({flood_mdd(depth, fb, 'k.flood_cap')}*s.g,1)*k.asset_value_usd*s.e"
    return f"""
SELECT '{scen}' AS scenario, id, sum(t) AS t FROM (
 SELECT s.id, c.freq*w.weight*least({wind_mdd('x.intensity*s.h', 'k.v_half')}*k.wind_mult*s.g,1)*k.asset_value_usd*s.e AS t FROM wind x JOIN cat c USING (source, event_id) JOIN {w} w USING (source) {at}
 UNION ALL SELECT s.id, c.freq*w.weight*{flood('greatest(x.depth*s.h,0)', 'k.fb_coast')} FROM surge x JOIN cat c USING (source, event_id) JOIN {w} w USING (source) {at}
 UNION ALL SELECT s.id, c.freq/n*{flood('greatest(x.depth*s.h,0)', 'k.fb_river')} FROM river x JOIN cat c USING (event_id) JOIN river_n USING (scenario) {at} WHERE x.scenario='{scen}'
 UNION ALL SELECT s.id, c.freq*{flood(pond(f"x.mm*{d(1 + .07 * A.WARMING[scen])}*s.h"), 'k.fb_rain')} FROM rain x JOIN cat c USING (event_id) {at}
 UNION ALL SELECT s.id, least(f.p*s.h,1)*least(f.loss/k.asset_value_usd*s.g,1)*k.asset_value_usd*s.e FROM fire_l f JOIN knobs k USING (site_key) CROSS JOIN {table} s WHERE f.scenario='{scen}' AND k.asset_value_usd>0)
GROUP BY 2"""


_mc = {"draws": f"SELECT i AS id, {_u('haz')} AS h, {_u('dmg')} AS g, {_u('exp')} AS e FROM (SELECT unnest(range({A.MC_SAMPLES})) AS i)",
       "ends": f"SELECT * FROM {values([(f'{k}:{side}', *[A.MC_FACTORS[k][i] if k == f else 1.0 for f in A.MC_FACTORS]) for k in A.MC_FACTORS for i, side in enumerate(('lo', 'hi'))])} t(id, h, g, e)",
       **{f"mc{i}": _factor_sql(sc, "draws") for i, sc in enumerate(S2)}, **{f"end{i}": _factor_sql(sc, "ends") for i, sc in enumerate(S2)}}


@register("mc_bands", query(f"""
SELECT scenario, {rnd('quantile_cont(t,0.05)', 0)} AS p5, {rnd('quantile_cont(t,0.5)', 0)} AS p50, {rnd('quantile_cont(t,0.95)', 0)} AS p95 FROM
(SELECT * FROM mc0 UNION ALL SELECT * FROM mc1) GROUP BY 1""", _mc))
def mc_bands(spark, sf):
    """Bands of annual acute damage over three hundred joint draws, all perils."""
    return rounded(sensitivity.bands(impact(spark, sf).sampled_aal(S2), by=["scenario"]), {"p5": 0, "p50": 0, "p95": 0})


@register("mc_drivers", query(f"""
SELECT scenario, split_part(id,':',1) AS factor, {rnd('max(t)-min(t)', 0)} AS swing FROM (SELECT * FROM end0 UNION ALL SELECT * FROM end1) GROUP BY 1,2""", _mc))
def mc_drivers(spark, sf):
    """Swing of annual acute damage between the ends of each factor, one at a time."""
    return rounded(impact(spark, sf).driver_swings(S2), {"swing": 0})


@register("year_loss_table")
def year_loss_table(spark, sf):
    """Simulated retained storm losses: one catalog per country and year, Poisson occurrences."""
    ev = events(spark, sf).where("scenario = 'present'")
    groups = tcor.event_retained(ev, insured(spark, sf))
    weights = ev.select("country", "source", "weight").distinct()
    years = sensitivity.catalog_years(spark, weights)
    per = groups.groupBy("country", "source", "event_id", "freq").agg(F.sum("retained").alias("retained"))
    occ = sensitivity.occurrences(per, ["country", "source", "event_id"])
    hit = occ.join(F.broadcast(years), ["country", "source", "year"]).join(per.drop("freq"), ["country", "source", "event_id"])
    table = sensitivity.year_losses([hit.select("year", (F.col("n") * F.col("retained")).alias("loss"))], spark)
    return sensitivity.year_summary(table)


_YEARLY = 50_000_000
_plan = {**_cat, "plan0": f"""
SELECT coalesce(s.named_insured,'Unspecified') AS portfolio, c.site_key, c.name, c.measure, s.wish, round(c.bcr0,3) AS bcr,
 CASE WHEN s.wish IS NULL THEN round(c.cost,2) ELSE round(round(c.cost,2)*{d(A.RENOVATION_SYNERGY)},2) END AS cost
FROM cproj c JOIN (SELECT site_key, named_insured, CASE WHEN renovation_year BETWEEN 2026 AND 2028 THEN CAST(renovation_year-2025 AS INTEGER) END AS wish FROM sites) s USING (site_key)"""}


@register("capital_plan_phased", query(f"""
SELECT portfolio, row_number() OVER (PARTITION BY portfolio ORDER BY year IS NULL, k) AS position, site_key, name, measure, {rnd('cost', 2)} AS cost, {rnd('bcr', 3)} AS bcr, wish IS NOT NULL AS synergy, year, year IS NULL AS deferred
FROM (WITH RECURSIVE o AS MATERIALIZED (SELECT *, CAST(round(cost*100) AS BIGINT) AS cents, row_number() OVER (PARTITION BY portfolio ORDER BY bcr DESC, name, measure) AS k FROM plan0),
 f AS (SELECT DISTINCT portfolio, CAST(0 AS BIGINT) AS k, CAST({_YEARLY * 100} AS BIGINT) AS a, CAST({_YEARLY * 100} AS BIGINT) AS b, CAST({_YEARLY * 100} AS BIGINT) AS c, CAST(NULL AS INTEGER) AS year FROM o
  UNION ALL SELECT portfolio, k, a-CASE WHEN y=1 THEN cents ELSE 0 END, b-CASE WHEN y=2 THEN cents ELSE 0 END, c-CASE WHEN y=3 THEN cents ELSE 0 END, y FROM
   (SELECT f.portfolio, o.k, f.a, f.b, f.c, o.cents, CASE WHEN wish=1 AND cents<=a THEN 1 WHEN wish=2 AND cents<=b THEN 2 WHEN wish=3 AND cents<=c THEN 3 WHEN cents<=a THEN 1 WHEN cents<=b THEN 2 WHEN cents<=c THEN 3 END AS y
    FROM f JOIN o ON o.portfolio=f.portfolio AND o.k=f.k+1))
 SELECT o.*, f.year FROM f JOIN o ON o.portfolio=f.portfolio AND o.k=f.k)""", _plan))
def capital_plan_phased(spark, sf):
    """Every fundable project of every named insured, phased under a yearly budget each."""
    reno = S.sites(spark, sf).select("site_key", F.coalesce("named_insured", F.lit("Unspecified")).alias("portfolio"), planning.renovation_year().alias("reno_year"))
    projects = I.catalog_projects(catalog_averted(spark, sf)).join(reno, "site_key")
    plan = planning.phase(projects, float(_YEARLY))
    return rounded(plan.select("portfolio", "position", "site_key", "name", "measure", "cost", "bcr", "synergy", "year", "deferred"), {"cost": 2, "bcr": 3})


@register("action_queue_budget", query(f"""
SELECT scenario, site_key, measure, {rnd('cost', 2)} AS cost, {rnd('bcr', 6)} AS bcr, coalesce(funded,false) AS funded
FROM (WITH RECURSIVE o AS MATERIALIZED (SELECT scenario, site_key, ord, CAST(round(cost*100) AS BIGINT) AS cents, row_number() OVER (PARTITION BY scenario ORDER BY round(bcr,6) DESC, site_key, ord) AS k FROM mrow WHERE round(bcr,6)>=1),
 f AS (SELECT DISTINCT scenario, CAST(0 AS BIGINT) AS k, CAST({_YEARLY * 100} AS BIGINT) AS a, false AS funded FROM o
  UNION ALL SELECT f.scenario, o.k, a-CASE WHEN cents<=a THEN cents ELSE 0 END, cents<=a FROM f JOIN o ON o.scenario=f.scenario AND o.k=f.k+1)
 SELECT m.*, f.funded FROM mrow m LEFT JOIN o USING (scenario, site_key, ord) LEFT JOIN f ON f.scenario=o.scenario AND f.k=o.k)""", _mrows))
def action_queue_budget(spark, sf):
    rows = measures(spark, sf, S2).withColumn("action_id", F.col("site_key") * 16 + F.col("ordinal")).withColumn("bcr", r("bcr", 6))
    done = ad.fund_within_budget(rows, float(_YEARLY), by=["scenario"])
    return rounded(done.select("scenario", "site_key", "measure", "cost", "bcr", "funded"), {"cost": 2, "bcr": 6})


@register("payoff_split")
def payoff_split(spark, sf):
    """Certain and negotiated value per measure and scenario, on grid ladders."""
    f = fin(spark, sf)
    pay = payoff.payoffs(f, tcor.interim_ladders(f), insured(spark, sf))
    return pay.groupBy("scenario", "measure").agg(F.count("*").alias("sites"), F.sum("certain").alias("certain"), F.sum("premium_saving").alias("premium_saving"))


_scope = {**_mrows, "whole": "SELECT scenario FROM mrow GROUP BY 1 HAVING count(DISTINCT measure)=(SELECT count(DISTINCT measure) FROM mrow)"}


@register("plan_scenario", query(f"""
SELECT scenario, count(*) AS actions, {rnd('sum(cost)', 0)} AS cost FROM mrow
WHERE scenario=(SELECT scenario FROM whole ORDER BY CASE scenario WHEN 'ssp245_2050' THEN 0 WHEN 'present' THEN 1 END LIMIT 1) GROUP BY 1""", _scope))
def plan_scenario(spark, sf):
    """Actions of the scenario that capital plans are appraised on."""
    rows = planning.plan_scenario(measures(spark, sf))
    return rows.groupBy("scenario").agg(F.count("*").alias("actions"), r(F.sum("cost"), 0).alias("cost"))


@register("payback_order", query("""
SELECT scenario, row_number() OVER (PARTITION BY scenario ORDER BY p NULLS LAST, name, measure) AS position, site_key, measure, p AS payback_years
FROM (SELECT *, CASE WHEN round(averted,4)>0 THEN round(round(cost,2)/round(averted,4),6) END AS p FROM mrow)""", _mrows))
def payback_order(spark, sf):
    rows = measures(spark, sf).withColumn("averted", r("averted", 4)).withColumn("cost", r("cost", 2))
    return planning.payback_order(rows, ["scenario"]).select("scenario", "position", "site_key", "measure", "payback_years")
