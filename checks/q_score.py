"""Grid scoring, finance and adaptation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from perilframe import assumptions as A
from perilframe.functions import profile
from perilframe.functions.curves import annuity
from perilframe.operators import adaptation as ad
from perilframe.operators import finance as fo
from perilframe.operators import scoring
from perilframe.plans import standin as S

from .context import S2, S4, fin, hazards, measures, r, rounded, scored
from .registry import register
from .sql_parts import S2 as _S2
from .sql_parts import band, case, d, eval_cte, hazards_cte, query, rnd, scored_cte, values

X2 = {**hazards_cte(S2), **scored_cte()}
X4 = {**hazards_cte(S4), **scored_cte()}
ACUTE = A.ACUTE
_TOT = "+".join(f"ead_{p}" for p in ACUTE)
_HB = "CASE WHEN d32>160 THEN 'Severe' WHEN d32>100 THEN 'High' WHEN d32>45 THEN 'Moderate' WHEN d32>10 THEN 'Low' ELSE 'Minimal' END"


def long_sql(body: str = "") -> str:
    parts = [f"SELECT site_key, scenario, '{p}' AS hazard, ead_{p} AS ead, f_{p}*100 AS ead_pct, {band(f'(f_{p}*100)')} AS band, "
             + (f"CASE WHEN on_{p} THEN 'grid' WHEN has_wui THEN 'interim' ELSE 'none' END" if p == "wfire" else
                f"CASE WHEN on_{p} THEN 'grid' ELSE '{'none' if p == 'prain' else 'interim'}' END") + " AS basis FROM sc" for p in ACUTE]
    parts.append(f"SELECT site_key, scenario, 'heat', 0, 0, {_HB}, CASE WHEN on_heat THEN 'grid' ELSE 'interim' END FROM sc")
    return " UNION ALL ".join(parts)


@register("grid_scores", query(f"SELECT site_key, scenario, hazard, {rnd('ead', 2)} AS ead_usd, {rnd('ead_pct', 6)} AS ead_pct, band, basis FROM lng", {**X2, "lng": long_sql()}))
def grid_scores(spark, sf):
    return rounded(scoring.by_hazard(scored(spark, sf)), {"ead": 2, "ead_pct": 6}).withColumnRenamed("ead", "ead_usd")


@register("site_hazard_inputs", query(f"""
SELECT site_key, scenario, {', '.join(f"{rnd(f'max(CASE WHEN peril=' + chr(39) + p + chr(39) + f' THEN v{rp} END)', 5)} AS {p}_{rp}" for p in ('tc', 'cflood', 'rflood', 'prain') for rp in (10, 100, 500))},
 {rnd('any_value(pct)', 6)} AS fire_pct, any_value(cond) AS fire_cond, any_value(d32) AS days_over_32, any_value(d35) AS days_over_35, any_value(cdd) AS cdd, any_value(dhum) AS days_humid_35
FROM pv JOIN fire USING (site_key, scenario) JOIN heat USING (site_key, scenario) GROUP BY 1,2""", X2))
def site_hazard_inputs(spark, sf):
    h = hazards(spark, sf)
    at = {10: 0, 100: 3, 500: 5}
    cols = [r(F.get(c, F.lit(i)), 5).alias(f"{p}_{rp}") for p, c in (("tc", "i_tc"), ("cflood", "i_cflood"), ("rflood", "i_rflood"), ("prain", "i_mm")) for rp, i in at.items()]
    heat = [F.col(f"heat_ind.{n}").alias(n) for n in ("days_over_32", "days_over_35", "cdd", "days_humid_35")]
    return h.select("site_key", "scenario", *cols, r("fire_pct", 6).alias("fire_pct"), "fire_cond", *heat)


@register("interim_only_scores", query(f"SELECT site_key, scenario, {rnd('ead', 2)} AS ead_usd, band FROM sc WHERE NOT on_tc", X2))
def interim_only_scores(spark, sf):
    return scored(spark, sf).where(~F.col("on_tc")).select("site_key", "scenario", r("ead").alias("ead_usd"), "band")


@register("portfolio_by_hazard", query(f"""
SELECT scenario, peril AS hazard, {rnd('sum(asset_value_usd)', 0)} AS tiv, {', '.join(f"{rnd(f'sum(CASE WHEN rp={rp} THEN loss END)', 0)} AS loss_rp{rp}" for rp in A.RETURN_PERIODS)}
FROM lrp JOIN sites USING (site_key) GROUP BY 1,2""".replace("{rnd('sum(asset_value_usd)', 0)}", "").replace(rnd('sum(asset_value_usd)', 0), rnd("sum(CASE WHEN rp=10 THEN asset_value_usd END)", 0)), X2))
def portfolio_by_hazard(spark, sf):
    df = scoring.portfolio_by_hazard(scored(spark, sf)).drop("ead", "ead_pct")
    return rounded(df, {c: 0 for c in df.columns if c not in ("scenario", "hazard")})


@register("risk_drivers", query(f"""
SELECT scenario, hazard, {rnd('sum(ead)', 0)} AS ead, {rnd('sum(ead)/any_value(t)', 6)} AS share FROM lng JOIN (SELECT scenario, sum(ead) AS t FROM lng GROUP BY 1) USING (scenario) WHERE hazard<>'heat' GROUP BY 1,2""", {**X2, "lng": long_sql()}))
def risk_drivers(spark, sf):
    return rounded(scoring.driver_shares(scored(spark, sf)), {"ead": 0, "share": 6})


@register("rollup_brand_insured", query(f"""
SELECT scenario, CASE WHEN grouping(brand)=0 THEN 'brand' WHEN grouping(ins)=0 THEN 'insured' ELSE 'portfolio' END AS level, coalesce(brand, ins, 'all') AS name,
 count(*) AS n, {rnd('sum(asset_value_usd)', 0)} AS tiv, {rnd('sum(ead)', 0)} AS ead, max(d32) AS heat_days, {rnd('sum(ead)/sum(asset_value_usd)*100', 6)} AS ead_pct, {band('(sum(ead)/sum(asset_value_usd)*100)')} AS band
FROM (SELECT *, coalesce(named_insured,'Unspecified') AS ins FROM sc) GROUP BY GROUPING SETS ((scenario, brand), (scenario, ins), (scenario))""", X2))
def rollup_brand_insured(spark, sf):
    df = scoring.group_rollup(scored(spark, sf))
    return rounded(df.select("scenario", "level", "name", "n", "tiv", "ead", "heat_days", "ead_pct", "band"), {"tiv": 0, "ead": 0, "ead_pct": 6})


@register("band_migration", query(f"""
SELECT scenario, {rnd('sum(ead)', 0)} AS ead, {', '.join(f"count(*) FILTER (WHERE band='{b}') AS {b.lower()}" for b in ['Minimal', 'Low', 'Moderate', 'High', 'Severe'])},
 {rnd("(sum(ead)/(SELECT sum(ead) FROM sc WHERE scenario='present')-1)*100", 6)} AS vs_present_pct FROM sc GROUP BY 1""", X4))
def band_migration(spark, sf):
    df = scoring.band_migration(scored(spark, sf, S4)).drop("tiv", "ead_pct")
    return rounded(df, {"ead": 0, "vs_present_pct": 6})


_gk = "CASE WHEN site_id IS NOT NULL THEN 'id:'||lower(site_id) ELSE 'geo:'||printf('%.5f',latitude)||','||printf('%.5f',longitude) END"
_mod = "+".join(f"CAST(on_{h} AS INTEGER)" for h in A.HAZARDS)
_grp = {"g": f"SELECT *, {_gk} AS group_key, {_mod} AS modelled FROM sc",
        "gn": """SELECT scenario, group_key, coalesce(max(CASE WHEN rk=1 AND f='s' THEN v END), max(CASE WHEN rk=1 AND f='n' THEN v END)) AS name, max(CASE WHEN rk=1 AND f='b' THEN v END) AS brand FROM
(SELECT *, row_number() OVER (PARTITION BY scenario, group_key, f ORDER BY n DESC, o) AS rk FROM
 (SELECT scenario, group_key, f, v, count(*) AS n, min(site_key) AS o FROM
  (SELECT scenario, group_key, site_key, 's' AS f, site_name AS v FROM g UNION ALL SELECT scenario, group_key, site_key, 'n', name FROM g UNION ALL SELECT scenario, group_key, site_key, 'b', brand FROM g)
  WHERE v IS NOT NULL AND v<>'' GROUP BY 1,2,3,4)) GROUP BY 1,2"""}


@register("site_groups", query(f"""
SELECT scenario, group_key, n.name, n.brand, count(*) AS members, {rnd('sum(asset_value_usd)', 0)} AS value, {rnd('sum(ead)', 0)} AS ead, max(d32) AS heat_days,
 {band('(sum(ead)/sum(asset_value_usd)*100)')} AS band, arg_max(modelled, asset_value_usd) AS modelled, arg_max(site_key, asset_value_usd) AS lead_site
FROM g JOIN gn n USING (scenario, group_key) GROUP BY 1,2,3,4""", {**X2, **_grp}))
def site_groups(spark, sf):
    df = scoring.site_groups(scored(spark, sf))
    return rounded(df.select("scenario", "group_key", "name", "brand", "members", "value", "ead", "heat_days", "band", "modelled", "lead_site"), {"value": 0, "ead": 0})


@register("group_insured", query(f"""
SELECT scenario, group_key, coalesce(named_insured,'Unspecified') AS insured, count(*) AS n, {rnd('sum(ead)', 0)} AS ead, {rnd('CASE WHEN any_value(t)<>0 THEN sum(ead)/any_value(t)*100 ELSE 0 END', 5)} AS share_pct
FROM g JOIN (SELECT scenario, group_key, sum(ead) AS t FROM g GROUP BY 1,2) USING (scenario, group_key) GROUP BY 1,2,3""", {**X2, **_grp}))
def group_insured(spark, sf):
    df = scoring.group_insured(scored(spark, sf))
    return rounded(df.select("scenario", "group_key", "insured", "n", "ead", "share_pct"), {"ead": 0, "share_pct": 5})


def _src_sql() -> str:
    b = {p: (f"CASE WHEN on_{p} THEN 'grid' WHEN has_wui THEN 'interim' ELSE 'none' END" if p == "wfire" else f"CASE WHEN on_{p} THEN 'grid' ELSE '{'none' if p == 'prain' else 'interim'}' END") for p in A.HAZARDS}
    g = lambda k: f"'{k}:'||coalesce(nullif(concat_ws('+', {', '.join(f'CASE WHEN ({b[h]})=' + chr(39) + k + chr(39) + f' THEN ' + chr(39) + h + chr(39) + ' END' for h in A.HAZARDS)}),''),'-')"
    return f"concat_ws('|', {g('grid')}, {g('interim')}, {g('none')})"


@register("trust_coverage", query(f"SELECT site_key, scenario, {_mod} AS modelled, {_src_sql()} AS hazard_source FROM sc", X2))
def trust_coverage(spark, sf):
    return scored(spark, sf).select("site_key", "scenario", scoring.modelled_count().alias("modelled"), scoring.hazard_source().alias("hazard_source"))


@register("dominant_peril", query(f"""
SELECT site_key, scenario, CASE WHEN greatest({', '.join(f'ead_{p}' for p in ACUTE)})>0 THEN CASE {' '.join(f"WHEN ead_{p}>=greatest({', '.join(f'ead_{q}' for q in ACUTE)})*(1-1e-12) THEN '{p}'" for p in ACUTE)} END END AS dominant, {_HB} AS heat_rating, band FROM sc""", X2))
def dominant_peril(spark, sf):
    top = F.greatest(*[F.col(f"ead_{p}") for p in ACUTE])
    return scored(spark, sf).select("site_key", "scenario", F.when(top > 0.0, scoring.dominant()).alias("dominant"), F.col("heat_ind.band").alias("heat_rating"), "band")


@register("peril_authority", query(f"""
SELECT h.hazard, c.cells, c.scenarios, CAST(sum(CASE WHEN {case('h.hazard', {}, 'NULL').replace('CASE h.hazard', 'CASE h.hazard ' + ' '.join(f"WHEN '{x}' THEN on_{x}" for x in A.HAZARDS))} THEN 1 ELSE 0 END) AS BIGINT) AS sites_modelled, count(*) AS sites
FROM (SELECT * FROM sc WHERE scenario='present'), {values([(x,) for x in A.HAZARDS])} h(hazard) JOIN
(SELECT hazard, count(*) AS cells, count(DISTINCT scenario) AS scenarios FROM ucen, {values([(x,) for x in S2])} s(scenario), {values([(x,) for x in A.HAZARDS])} q(hazard)
 WHERE hazard IN ('tc','heat') OR (hazard='cflood' AND centroid_id%2=0) OR (hazard='rflood' AND centroid_id%3=0) OR (hazard='wfire' AND centroid_id%4=0) OR (hazard='prain' AND scenario='present') GROUP BY 1) c ON c.hazard=h.hazard GROUP BY 1,2,3""", X2))
def peril_authority(spark, sf):
    return scoring.peril_authority(scored(spark, sf).where("scenario = 'present'"), S.hazard_grid(spark, sf, S2)).drop("complete").select("hazard", "cells", "scenarios", "sites_modelled", "sites")


@register("quadrant", query(f"""
SELECT s.scenario, site_key, {rnd('m', 2)} AS median_value, CASE WHEN asset_value_usd>=m AND ead_pct>=0.75 THEN 'high_value_high_loss' WHEN ead_pct>=0.75 THEN 'low_value_high_loss' WHEN asset_value_usd>=m THEN 'high_value_low_loss' ELSE 'low_value_low_loss' END AS quadrant
FROM sc s JOIN (SELECT scenario, median(asset_value_usd) AS m FROM sc GROUP BY 1) USING (scenario)""".replace("s.scenario, site_key", "scenario, site_key"), X2))
def quadrant(spark, sf):
    return scoring.quadrant(scored(spark, sf)).select("scenario", "site_key", r("median_value").alias("median_value"), "quadrant")


@register("field_domain", query(f"""
SELECT hazard, scenario, CASE WHEN v>0 THEN {rnd('v', 4)} ELSE 1 END AS hi FROM (SELECT *, row_number() OVER (PARTITION BY hazard, scenario ORDER BY v) AS rn, count(*) OVER (PARTITION BY hazard, scenario) AS n FROM
 (SELECT 'tc' AS hazard, s.scenario, (p_size*{d(.5)}+34)*(1+{d(.02)}*s.w) AS v FROM ucen, scen s UNION ALL SELECT 'heat', s.scenario, p_size*3+s.w*10 FROM ucen, scen s))
WHERE rn=least(CAST(floor({d(.995)}*n) AS BIGINT), n-1)+1"""))
def field_domain(spark, sf):
    from perilframe.operators.exceedance import floor_rank, value_at_rank
    g = S.hazard_grid(spark, sf).where(F.col("hazard").isin("tc", "heat"))
    v = F.when(F.col("hazard") == "heat", F.col("v10")).otherwise(F.col("v100"))
    top = value_at_rank(g.select("hazard", "scenario", v.alias("v")), ["hazard", "scenario"], "v", floor_rank(0.995))
    return top.select("hazard", "scenario", F.when(F.col("v") > 0.0, r("v", 4)).otherwise(1.0).alias("hi"))


# --- finance ----------------------------------------------------------------------------------

_rps = A.RETURN_PERIODS
_port = {"sitev": f"SELECT scenario, site_key, rp, sum(loss)*(1+any_value(gop)/any_value(asset_value_usd)) AS v FROM lrp JOIN knobs USING (site_key) GROUP BY 1,2,3",
         "var": f"SELECT scenario, rp, sqrt(greatest({d(.7)}*sum(v*v)+{d(.3)}*power(sum(v),2),0)) AS v FROM sitev GROUP BY 1,2",
         "port": f"""SELECT scenario, count(*) AS sites, sum(asset_value_usd) AS value, sum(revenue_usd) AS revenue, sum(direct_ead) AS direct_ead, sum(bi_ead) AS bi_ead, sum(heat_cost) AS heat_cost, sum(total_aal) AS total_aal FROM fin GROUP BY 1"""}
XP = {**X2, **_port}


@register("fin_sites", query(f"SELECT site_key, scenario, {rnd('direct_ead', 2)} AS direct_ead, {rnd('bi_ead', 2)} AS bi_ead, {rnd('heat_cost', 2)} AS heat_cost, {rnd('total_aal', 2)} AS total_aal FROM fin", X2))
def fin_sites(spark, sf):
    c = ["direct_ead", "bi_ead", "heat_cost", "total_aal"]
    return rounded(fin(spark, sf).select("site_key", "scenario", *c), {x: 2 for x in c})


@register("fin_portfolio_var", query(f"""
SELECT p.scenario, sites, {', '.join(f'{rnd(c, 0)} AS {c}' for c in ('value', 'revenue', 'direct_ead', 'bi_ead', 'heat_cost', 'total_aal'))}, {rnd('total_aal/value*100', 6)} AS aal_pct_value,
 {', '.join(f"{rnd(f'max(CASE WHEN rp={x} THEN v END)', 0)} AS var{x}" for x in _rps)} FROM port p JOIN var v ON v.scenario=p.scenario GROUP BY ALL""", XP))
def fin_portfolio_var(spark, sf):
    c = ["value", "revenue", "direct_ead", "bi_ead", "heat_cost", "total_aal"]
    df = fo.portfolio(fin(spark, sf)).select("scenario", "sites", *c, "aal_pct_value", *[f"var{x}" for x in _rps])
    return rounded(df, {x: 0 for x in c} | {f"var{x}": 0 for x in _rps} | {"aal_pct_value": 6})


@register("cost_split", query(f"""
SELECT scenario, cut, name, {rnd('sum(cost)', 0)} AS cost FROM (
 {' UNION ALL '.join(f"SELECT scenario, 'peril' AS cut, '{p}' AS name, ead_{p}+gop*f_{p} AS cost FROM fin" for p in ACUTE)} UNION ALL SELECT scenario, 'peril', 'heat', heat_cost FROM fin
 UNION ALL SELECT scenario, 'type', 'direct', direct_ead FROM fin UNION ALL SELECT scenario, 'type', 'interruption', bi_ead FROM fin UNION ALL SELECT scenario, 'type', 'heat', heat_cost FROM fin
 UNION ALL SELECT scenario, 'brand', brand, total_aal FROM fin) GROUP BY 1,2,3""", X2))
def cost_split(spark, sf):
    return rounded(fo.cost_split(fin(spark, sf)), {"cost": 0})


@register("disclosure", query(f"""
SELECT scenario, {rnd('(direct_ead+bi_ead)/value*100', 5)} AS acute_pct, {rnd('heat_cost/value*100', 5)} AS chronic_pct, {rnd('total_aal/value*100', 5)} AS total_pct,
 {rnd('v.v/value*100', 5)} AS tail100_pct FROM port JOIN (SELECT scenario, v FROM var WHERE rp=100) v USING (scenario)""", XP))
def disclosure(spark, sf):
    df = fo.disclosure(fo.with_tail(fo.portfolio(fin(spark, sf)), None)).drop("tail_basis")
    return rounded(df, {c: 5 for c in df.columns if c != "scenario"})


@register("canonical_tail", query(f"""
SELECT p.scenario, {rnd('coalesce(s.loss, v.v)', 0)} AS tail100, CASE WHEN s.loss IS NOT NULL THEN 'joint event tail (direct damage)' ELSE 'correlation blend (direct + interruption)' END AS tail_basis
FROM port p JOIN (SELECT scenario, v FROM var WHERE rp=100) v USING (scenario) LEFT JOIN (SELECT scenario, loss FROM storm_curve WHERE rp=100 AND scenario='present') s USING (scenario)""".replace("p.scenario", "scenario"), XP))
def canonical_tail(spark, sf):
    from .context import impact
    pack = impact(spark, sf).storm_curve(scenarios=["present"])
    df = fo.with_tail(fo.portfolio(fin(spark, sf)), pack)
    return df.select("scenario", r("tail100", 0).alias("tail100"), "tail_basis")


@register("event_vs_grid", query(f"""
SELECT scenario, {rnd('e.a', 0)} AS event_direct_aal, {rnd('direct_ead', 0)} AS grid_direct_aal FROM port LEFT JOIN (SELECT scenario, sum(acute) AS a FROM site_ead GROUP BY 1) e USING (scenario)""", XP))
def event_vs_grid(spark, sf):
    from .context import impact
    e = impact(spark, sf).site_ead.where(F.col("scenario").isin(S2)).groupBy("scenario").agg(F.sum("acute").alias("a"))
    return fo.portfolio(fin(spark, sf)).join(e, "scenario", "left").select("scenario", r("a", 0).alias("event_direct_aal"), r("direct_ead", 0).alias("grid_direct_aal"))


@register("site_shares", query(f"""
SELECT scenario, site_key, {rnd('cs', 6)} AS cost_share, {rnd('vs', 6)} AS value_share, CASE WHEN cs>vs*{d(1.5)} THEN 'concentration' WHEN cs<vs*{d(.6)} THEN 'diversifier' ELSE 'in line' END AS flag FROM
(SELECT scenario, site_key, total_aal/sum(total_aal) OVER w*100 AS cs, asset_value_usd/sum(asset_value_usd) OVER w*100 AS vs FROM fin WINDOW w AS (PARTITION BY scenario))""", X2))
def site_shares(spark, sf):
    return rounded(fo.site_shares(fin(spark, sf)).select("scenario", "site_key", "cost_share", "value_share", "flag"), {"cost_share": 6, "value_share": 6})


@register("overview_kpis", query(f"""
SELECT scenario, count(*) AS sites, {rnd('sum(asset_value_usd)', 0)} AS tiv, {rnd('avg(d32)', 5)} AS avg_days_32, {rnd('avg(d35)', 5)} AS avg_days_35, {rnd('avg(dhum)', 5)} AS avg_days_humid,
 count(*) FILTER (WHERE band IN ('High','Severe')) AS high_severe FROM sc GROUP BY 1""", X2))
def overview_kpis(spark, sf):
    return rounded(fo.overview(scored(spark, sf)), {"tiv": 0, "avg_days_32": 5, "avg_days_35": 5, "avg_days_humid": 5})


_costs = [*[f"ead_{p}+gop*f_{p}" for p in ACUTE], "heat_cost"]
_mx = f"greatest({', '.join(_costs)})"


@register("decision_rows", query(f"""
SELECT f.scenario, f.site_key, CASE {' '.join(f"WHEN {c}>={_mx}*(1-1e-12) THEN '{p}'" for c, p in zip(_costs, [*ACUTE, 'heat']))} END AS dominant, {rnd(_mx, 2)} AS dominant_cost, {rnd('l.l', 2)} AS damage_100,
 {rnd('greatest(dep,0)', 5)} AS depth_100, {rnd('365*l.l/asset_value_usd', 3)} AS downtime_100
FROM fin f JOIN (SELECT scenario, site_key, sum(loss) AS l FROM lrp WHERE rp=100 GROUP BY 1,2) l USING (scenario, site_key)
JOIN (SELECT scenario, site_key, max(CASE peril WHEN 'prain' THEN greatest(v100-75,0)/1000*{d(.55)} WHEN 'tc' THEN 0 ELSE v100 END) AS dep FROM pv GROUP BY 1,2) USING (scenario, site_key)""".replace("f.scenario, f.site_key", "scenario, site_key"), X2))
def decision_rows(spark, sf):
    df = fo.decision_rows(fin(spark, sf)).select("scenario", "site_key", "dominant", "dominant_cost", "damage_100", "depth_100", "downtime_100")
    return rounded(df, {"dominant_cost": 2, "damage_100": 2, "depth_100": 5, "downtime_100": 3})


_pv = {x: f"max(CASE WHEN rp={x} THEN v END)" for x in _rps}


def _layer(expr: str) -> str:
    f = [1 / x for x in _rps]
    w = [0.5 * ((f[i - 1] if i else f[0]) - (f[i + 1] if i + 1 < len(f) else f[i])) for i in range(len(f))]
    w[-1] = 0.5 * (f[-2] - f[-1]) + f[-1]
    return "sum(" + expr + "*" + "CASE rp " + " ".join(f"WHEN {x} THEN {d(y)}" for x, y in zip(_rps, w)) + " END)"


@register("layer_sweep", query(f"""
SELECT scenario, attach_rp, {rnd('aal*least(b/t,1)', 0)} AS below, {rnd('aal*least(l/t,1)', 0)} AS layer, {rnd('greatest(aal-aal*least(b/t,1)-aal*least(l/t,1),0)', 0)} AS above, {rnd('aal*least(l/t,1)*' + d(1.5), 0)} AS premium FROM
(SELECT v.scenario, a.rp AS attach_rp, any_value(p.direct_ead+p.bi_ead) AS aal, {_layer('v.v').replace('rp', 'v.rp')} AS t, {_layer('least(v.v,a.v)').replace('CASE rp', 'CASE v.rp')} AS b, {_layer('least(greatest(v.v-a.v,0),greatest(e.v-a.v,0))').replace('CASE rp', 'CASE v.rp')} AS l
 FROM var v JOIN var a ON a.scenario=v.scenario AND a.rp<250 JOIN var e ON e.scenario=v.scenario AND e.rp=250 JOIN port p ON p.scenario=v.scenario GROUP BY 1,2)""", XP))
def layer_sweep(spark, sf):
    df = fo.retention_sweep(fo.portfolio(fin(spark, sf))).select("scenario", "attach_rp", "below", "layer", "above", "premium")
    return rounded(df, {c: 0 for c in ("below", "layer", "above", "premium")})


@register("act_by", query(f"""
SELECT site_key, CASE WHEN min(y) IS NULL THEN 'high_value_low_loss' WHEN min(y)=2026 THEN 'now' ELSE CAST(min(y) AS VARCHAR) END AS act_by FROM
(SELECT site_key, CASE WHEN total_aal/asset_value_usd*10000>75 THEN CASE scenario WHEN 'present' THEN 2026 ELSE CAST(right(scenario,4) AS INTEGER) END END AS y FROM fin) GROUP BY 1""", X4))
def act_by(spark, sf):
    return fo.urgency(fin(spark, sf, S4), "ssp245")


# --- adaptation -------------------------------------------------------------------------------

_sets = {k: kn for k, _, _, kn, _, _, _ in ad.MEASURES}
_af = annuity(25, 0.03)
_mrows = {**X2, **eval_cte(_sets, "m"), "mrow": f"""
SELECT f.scenario, f.site_key, f.name, t.ks AS measure, m.ord, m.enabled, f.total_aal-(t.direct+t.bi+t.heat) AS averted, f.asset_value_usd*m.pct/100+m.flat AS cost,
 (f.total_aal-(t.direct+t.bi+t.heat))*{d(_af)}/(f.asset_value_usd*m.pct/100+m.flat) AS bcr
FROM fin f JOIN m_tot t USING (scenario, site_key) JOIN {values([(k, i, pct, flat, on) for i, (k, _, _, _, pct, flat, on) in enumerate(ad.MEASURES)])} m(measure, ord, pct, flat, enabled) ON m.measure=t.ks
WHERE CASE t.ks WHEN 'flood' THEN ead_cflood+ead_rflood>100 WHEN 'buffer' THEN ead_cflood>100 WHEN 'cool' THEN d35>15 WHEN 'fire' THEN fire_pct>0 ELSE true END"""}


@register("measure_rows", query(f"SELECT scenario, site_key, measure, {rnd('averted', 2)} AS averted, {rnd('cost', 2)} AS cost, {rnd('bcr', 5)} AS bcr FROM mrow", _mrows))
def measure_rows(spark, sf):
    return rounded(measures(spark, sf).select("scenario", "site_key", "measure", "averted", "cost", "bcr"), {"averted": 2, "cost": 2, "bcr": 5})


@register("measure_appraisal", query(f"""
SELECT scenario, measure, count(*) AS sites_in_scope, {rnd('sum(averted)', 0)} AS averted, {rnd('sum(cost)', 0)} AS cost, {rnd(f'sum(averted)*{d(_af)}/sum(cost)', 5)} AS bcr FROM mrow GROUP BY 1,2""", _mrows))
def measure_appraisal(spark, sf):
    return rounded(ad.appraisal(measures(spark, sf)).drop("benefit"), {"averted": 0, "cost": 0, "bcr": 5})


@register("combined_measures", query(f"""
SELECT scenario, {rnd('a', 0)} AS averted, {rnd('c', 0)} AS cost, {rnd(f'a*{d(_af)}/c', 5)} AS bcr FROM
(SELECT scenario, sum(f.total_aal-(t.direct+t.bi+t.heat)) AS a FROM fin f JOIN e_tot t USING (scenario, site_key) GROUP BY 1) JOIN (SELECT scenario, sum(cost) AS c FROM mrow WHERE enabled GROUP BY 1) USING (scenario)""",
                                     {**_mrows, **eval_cte({"on": ad.enabled_knobs()}, "e")}))
def combined_measures(spark, sf):
    f = fin(spark, sf)
    return rounded(ad.combined_enabled(f, ad.measure_rows(f)), {"averted": 0, "cost": 0, "bcr": 5})


@register("best_measure", query(f"SELECT scenario, site_key, measure, {rnd('bcr', 5)} AS bcr FROM mrow QUALIFY row_number() OVER (PARTITION BY scenario, site_key ORDER BY bcr DESC, ord)=1", _mrows))
def best_measure(spark, sf):
    return rounded(ad.best_measure(measures(spark, sf)).select("scenario", "site_key", "measure", "bcr"), {"bcr": 5})


@register("top_measures", query(f"SELECT scenario, site_key, CAST(rank AS INTEGER) AS rank, measure, {rnd('bcr', 5)} AS bcr FROM (SELECT *, row_number() OVER (PARTITION BY scenario, site_key ORDER BY bcr DESC, ord) AS rank FROM mrow) WHERE rank<=3", _mrows))
def top_measures(spark, sf):
    return rounded(ad.top_measures(measures(spark, sf)).select("scenario", "site_key", "rank", "measure", "bcr"), {"bcr": 5})


@register("tolerance_lanes", query(f"""
SELECT f.scenario, f.site_key, {rnd('total_aal/asset_value_usd*10000', 4)} AS bps, {rnd('coalesce(b.bcr,0)', 5)} AS best_bcr, b.measure AS best_measure, CASE WHEN b.bcr>=1 THEN 'capex' ELSE 'transfer' END AS lane
FROM fin f LEFT JOIN (SELECT * FROM mrow QUALIFY row_number() OVER (PARTITION BY scenario, site_key ORDER BY bcr DESC, ord)=1) b ON b.scenario=f.scenario AND b.site_key=f.site_key
WHERE total_aal/asset_value_usd*10000>75""", _mrows))
def tolerance_lanes(spark, sf):
    f = fin(spark, sf)
    df = ad.tolerance_breaches(f, ad.best_measure(ad.measure_rows(f)))
    return rounded(df.select("scenario", "site_key", "bps", "best_bcr", "best_measure", "lane"), {"bps": 4, "best_bcr": 5})


_tset = {"central": {}} | {f"{k}_{s}": kn for k, _, lo, hi in ad.FACTORS for s, kn in (("lo", lo), ("hi", hi))}


@register("tornado", query(f"""
SELECT scenario, factor, {rnd('lo', 0)} AS lo, {rnd('hi', 0)} AS hi, {rnd('central', 0)} AS central, {rnd('greatest(central-sqrt(sum(power(greatest(central-lo,0),2)) OVER w),0)', 0)} AS low,
 {rnd('central+sqrt(sum(power(greatest(hi-central,0),2)) OVER w)', 0)} AS high FROM
(SELECT scenario, split_part(ks,'_',1) AS factor, min(t) AS lo, max(t) AS hi FROM tt WHERE ks<>'central' GROUP BY 1,2) JOIN (SELECT scenario, t AS central FROM tt WHERE ks='central') USING (scenario)
WINDOW w AS (PARTITION BY scenario)""", {**X2, **eval_cte(_tset, "t"), "tt": "SELECT scenario, ks, sum(direct+bi+heat) AS t FROM t_tot GROUP BY 1,2"}))
def tornado(spark, sf):
    df = ad.tornado(fin(spark, sf)).drop("swing")
    return rounded(df, {c: 0 for c in ("lo", "hi", "central", "low", "high")})


_g = 1.02 ** 24


@register("cost_waterfall", query(f"""
SELECT {rnd('t', 0)} AS today, {rnd(f't*{d(_g - 1)}', 0)} AS growth, {rnd(f'(f-t)*{d(_g)}', 0)} AS climate, {rnd(f'f*{d(_g)}', 0)} AS future, {rnd(f'(f-a)*{d(_g)}', 0)} AS averted, {rnd(f'a*{d(_g)}', 0)} AS residual FROM
(SELECT sum(CASE WHEN scenario='present' THEN total_aal END) AS t, sum(CASE WHEN scenario<>'present' THEN total_aal END) AS f, sum(CASE WHEN scenario<>'present' THEN t.direct+t.bi+t.heat END) AS a
 FROM fin JOIN e_tot t USING (scenario, site_key))""", {**X2, **eval_cte({"on": ad.enabled_knobs()}, "e")}))
def cost_waterfall(spark, sf):
    df = ad.waterfall(fin(spark, sf), "ssp245_2050")
    return rounded(df, {c: 0 for c in df.columns})


@register("action_queue_breakeven", query(f"""
SELECT scenario, count(*) AS actions, count(*) FILTER (WHERE bcr>=1) AS funded, {rnd('sum(CASE WHEN bcr>=1 THEN cost END)', 0)} AS funded_cost FROM mrow GROUP BY 1""", _mrows))
def action_queue_breakeven(spark, sf):
    q = ad.fund_at_breakeven(measures(spark, sf))
    return q.groupBy("scenario").agg(F.count("*").alias("actions"), F.count_if("funded").alias("funded"), r(F.sum(F.when(F.col("funded"), F.col("cost"))), 0).alias("funded_cost"))


@register("exec_actions", query(f"""
SELECT f.site_key, f.name, {rnd('f.total_aal', 2)} AS total_aal, b.measure, {rnd('b.cost/b.averted', 5)} AS payback_years FROM (SELECT * FROM fin WHERE scenario='present') f
LEFT JOIN (SELECT * FROM mrow WHERE scenario='present' QUALIFY row_number() OVER (PARTITION BY site_key ORDER BY bcr DESC, ord)=1) b ON b.site_key=f.site_key ORDER BY f.total_aal DESC LIMIT 25""", _mrows))
def exec_actions(spark, sf):
    f = fin(spark, sf)
    top = f.where("scenario = 'present'").orderBy(F.col("total_aal").desc()).limit(25).select("scenario", "site_key", "name", "total_aal")
    best = ad.best_measure(ad.measure_rows(f.where("scenario = 'present'")))
    return top.join(best, ["scenario", "site_key"], "left").select(
        "site_key", "name", r("total_aal").alias("total_aal"), "measure", r(F.col("cost") / F.col("averted"), 5).alias("payback_years"))
