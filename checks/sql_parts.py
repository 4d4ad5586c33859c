"""Shared SQL fragments of the oracle queries: the stand-in tables and model steps as CTEs.

The SQL is written in its own shape (long rows, plain windows, full cross products of small
tables) so that agreement with the Spark operators means something.
"""

from __future__ import annotations

import math
import re

from perilframe import assumptions as A

RPS = A.RETURN_PERIODS
S2 = ["present", "ssp245_2050"]
S4 = ["present", "ssp245_2030", "ssp245_2050", "ssp245_2080"]


def d(x: float) -> str:
    """A double literal."""
    return f"CAST({x!r} AS DOUBLE)"


def values(rows: list[tuple]) -> str:
    cell = lambda v: ("NULL" if v is None else f"'{v}'" if isinstance(v, str) else
                      ("true" if v else "false") if isinstance(v, bool) else str(v) if isinstance(v, int) else d(v))
    return "(VALUES " + ", ".join("(" + ", ".join(cell(v) for v in r) + ")" for r in rows) + ")"


def case(key: str, table: dict, default: str) -> str:
    lit = lambda v: f"'{v}'" if isinstance(v, str) else d(v)
    return "CASE " + key + " " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table.items()) + f" ELSE {default} END"


def hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (f"(2*{d(6371.0)}*asin(sqrt(least(power(sin((radians({lat2})-radians({lat1}))/2),2)"
            f"+cos(radians({lat1}))*cos(radians({lat2}))*power(sin((radians({lon2})-radians({lon1}))/2),2),1.0))))")


def box(lat: str, lon: str, boxes: list[tuple], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {lat} BETWEEN {a} AND {b} AND {lon} BETWEEN {c} AND {e} THEN '{n}'"
                              for n, a, b, c, e in boxes) + f" ELSE {default} END"


def wind_mdd(v: str, half: str) -> str:
    t = f"greatest(({v}-{d(A.V_THRESH)})/({half}-{d(A.V_THRESH)}),0)"
    return f"(power({t},3)/(1+power({t},3)))"


def flood_mdd(depth: str, fb: str, cap: str) -> str:
    return f"(CASE WHEN ({depth})-({fb})<=0 THEN 0 ELSE least({cap},1-exp({d(-0.6)}*(({depth})-({fb})))) END)"


def pond(mm: str) -> str:
    return f"(greatest(({mm})-75,0)/{d(1000.0)}*{d(0.55)})"


def band(p: str) -> str:
    return (f"CASE WHEN {p}>=1.5 THEN 'Severe' WHEN {p}>=0.75 THEN 'High' WHEN {p}>=0.25 THEN 'Moderate' "
            f"WHEN {p}>0.001 THEN 'Low' ELSE 'Minimal' END")


def rnd(x: str, n: int) -> str:
    return f"round({x},{n})+{d(0.0)}"


W = case("sc.scenario", A.WARMING, "0")
SRC = "[" + ",".join(f"'{s}'" for s in A.SOURCES) + "]"
SCN = "[" + ",".join(f"'{s}'" for s in A.SCENARIOS) + "]"


def pick(key: str, n: int, vals: list) -> str:
    return "CASE " + key + f"%{n} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(vals) if v is not None) + " END"


CTE: dict[str, str] = {}

CTE["sites"] = f"""
SELECT c_custkey AS site_key, c_name AS name, c_mktsegment AS brand,
 {pick('c_nationkey', 3, ['USA', 'PRI', 'VIR'])} AS country,
 CASE WHEN c_custkey%50=49 THEN {d(19.64)} ELSE ((c_custkey*37)%1300+2400)/{d(100.0)} END AS latitude,
 CASE WHEN c_custkey%50=49 THEN {d(-155.99)} ELSE ((c_custkey*53)%2600-10000)/{d(100.0)} END AS longitude,
 (c_acctbal+1000)*{d(3333.3391)} AS asset_value_usd,
 CASE WHEN c_custkey%6=0 THEN (c_acctbal+1000)*{d(3333.3391)}*{d(0.4)} END AS annual_revenue_usd,
 {pick('c_custkey', 4, ['frame', 'masonry', 'engineered', None])} AS construction,
 CAST((c_custkey*7)%65+1960 AS DOUBLE) AS year_built, c_custkey%5=0 AS defended,
 {pick('c_custkey', 6, ['shingle', 'metal', 'tile', 'membrane', None, None])} AS roof_type,
 CASE WHEN c_custkey%6<4 THEN CAST((c_custkey*3)%35+1990 AS DOUBLE) END AS roof_year,
 {pick('c_custkey', 4, ['impact', 'partial', 'none', None])} AS opening_protection,
 CASE WHEN c_custkey%9=0 THEN CAST(c_custkey%5 AS DOUBLE) END AS first_floor_elev_m,
 c_custkey%11=0 AS equipment_elevated,
 {pick('c_custkey', 10, [*A.ARCHETYPES, None, 'unlisted_form'])} AS archetype,
 CASE WHEN c_custkey%4=1 THEN (c_custkey%30)/{d(10.0)} END AS ground_elev_m,
 CASE WHEN c_custkey%4=1 THEN (c_custkey%20)/{d(10.0)} END AS cell_ground_elev_m,
 CAST(c_custkey%9+1 AS DOUBLE) AS stories, CAST(c_custkey%300+50 AS DOUBLE) AS keys,
 CASE WHEN c_custkey%7<>0 THEN 'C'||(c_custkey//6) END AS campus_code,
 {pick('c_custkey', 3, ['HOA', 'Operating company', None])} AS named_insured,
 CASE WHEN c_custkey%8<2 THEN 'P'||(c_custkey//8) END AS site_id,
 CASE WHEN c_custkey%8<2 THEN 'Place '||(c_custkey//8) END AS site_name,
 CASE WHEN c_custkey%4=0 THEN (c_acctbal+1000)*{d(3333.3391)}*{d(0.004)} END AS premium_annual_usd,
 CASE WHEN c_custkey%5=0 THEN (c_acctbal+1000)*{d(3333.3391)}*{d(0.05)} END AS bi_ee_usd,
 CASE WHEN c_custkey%9=1 THEN {d(5000.0)} END AS mitigation_annual_usd,
 CASE WHEN c_custkey%10=4 THEN {d(1.0)} END AS timeshare_share,
 {pick('c_custkey', 8, ['interface', 'intermix'])} AS wui_class,
 CASE WHEN c_custkey%8<2 THEN CAST(c_custkey%60 AS DOUBLE) END AS defensible_space_m,
 c_custkey%7=3 AS roof_class_a,
 CASE WHEN c_custkey%13=0 THEN CAST(c_custkey%5+2026 AS DOUBLE) END AS renovation_year,
 {pick('c_custkey', 5, ['full', 'partial'])} AS backup_power
FROM customer"""


def wind_mult(roof: str = "roof_type", year: str = "roof_year", opening: str = "opening_protection") -> str:
    con = case("construction", A.CONSTRUCTION_FACTOR, "1")
    age = f"(2026-({year}))"
    rf = (f"CASE WHEN {year} IS NULL OR {year}<=1800 THEN 1 WHEN greatest({age},0)<=10 THEN {d(0.9)} "
          f"WHEN greatest({age},0)<=20 THEN 1 ELSE {d(1.2)} END")
    det = f"({con})*({case(roof, A.ROOF_TYPE_FACTOR, '1')})*({rf})*({case(opening, A.OPENING_FACTOR, '1')})"
    old = f"({con})*(CASE WHEN year_built>1800 AND year_built<1995 THEN {d(1.15)} WHEN year_built>=2010 THEN {d(0.9)} ELSE 1 END)"
    return (f"least(greatest(CASE WHEN {roof} IS NOT NULL OR {year} IS NOT NULL OR {opening} IS NOT NULL THEN {det} ELSE {old} END,"
            f"{d(0.5)}),{d(1.6)})")


_arch = lambda i, dflt: case("archetype", {k: v[i] for k, v in A.ARCHETYPES.items() if v[i] is not None}, dflt)
CTE["knobs0"] = f"""
SELECT *, {wind_mult()} AS wind_mult, {_arch(0, '1')}*{d(A.V_HALF)} AS v_half,
 CASE WHEN first_floor_elev_m>=0 THEN least(first_floor_elev_m,3) WHEN defended THEN {d(0.5)} ELSE 0 END + {_arch(1, '0')} AS bonus,
 CASE WHEN equipment_elevated THEN {d(0.5)} ELSE {d(0.75)} END AS own_cap, {_arch(2, 'NULL')} AS arch_cap,
 (CASE WHEN roof_class_a THEN {d(0.6)} ELSE 1 END)*(CASE WHEN defensible_space_m>=30 THEN {d(0.7)} ELSE 1 END) AS fire_vuln,
 CASE WHEN annual_revenue_usd>0 THEN annual_revenue_usd ELSE asset_value_usd*{d(0.35)} END AS revenue_usd
FROM sites"""
CTE["knobs"] = f"""
SELECT *, greatest(bonus+{d(1.1)},0) AS fb_coast, greatest(bonus+{d(0.6)},0) AS fb_river, greatest(bonus+{d(0.15)},0) AS fb_rain,
 CASE WHEN arch_cap IS NULL THEN own_cap WHEN equipment_elevated THEN least(arch_cap,own_cap) ELSE arch_cap END AS flood_cap,
 revenue_usd*{d(0.3)} AS gop,
 CASE WHEN ground_elev_m IS NOT NULL AND cell_ground_elev_m IS NOT NULL
      THEN least(greatest(ground_elev_m-cell_ground_elev_m,-10),10) END AS relief
FROM knobs0"""
CTE["cen"] = f"""
SELECT p_partkey AS centroid_id, ((p_partkey*61)%1300+2400)/{d(100.0)} AS lat, ((p_partkey*17)%2600-10000)/{d(100.0)} AS lon,
 p_size FROM part"""
CTE["ucen"] = "SELECT * FROM cen QUALIFY row_number() OVER (PARTITION BY lat, lon ORDER BY centroid_id)=1"
CTE["site_near"] = f"""
SELECT site_key, centroid_id, round({hav('latitude', 'longitude', 'lat', 'lon')},6) AS km
FROM (SELECT site_key, latitude, longitude FROM sites) s, ucen c
QUALIFY row_number() OVER (PARTITION BY site_key ORDER BY round({hav('latitude', 'longitude', 'lat', 'lon')},6), centroid_id)=1"""
CTE["site_cell"] = "SELECT site_key, centroid_id, km FROM site_near WHERE km<=200"
CTE["cat"] = f"""
SELECT o_orderkey AS event_id, {SRC}[o_orderkey%10+1] AS source, 1/CAST(o_orderkey%95+5 AS DOUBLE) AS freq,
 CASE WHEN o_orderkey%3=0 THEN 'EV'||o_orderkey END AS event_name FROM orders"""
CTE["wind"] = f"""
SELECT {SRC}[l_orderkey%10+1] AS source, l_orderkey AS event_id, l_partkey AS centroid_id, max(l_quantity*{d(1.5)}+20) AS intensity
FROM lineitem GROUP BY 1,2,3"""
CTE["surge"] = f"""
SELECT {SRC}[l_orderkey%10+1] AS source, l_orderkey AS event_id, l_partkey AS centroid_id, max(greatest(l_quantity/10-1,0)) AS depth
FROM lineitem GROUP BY 1,2,3 HAVING max(greatest(l_quantity/10-1,0))>0 AND {SRC}[l_orderkey%10+1]<>'rcp26_2060'"""
CTE["rain"] = f"""
SELECT l_orderkey AS event_id, l_partkey AS centroid_id, max(l_quantity*{d(24.3271)}) AS mm
FROM lineitem WHERE l_orderkey%10=0 GROUP BY 1,2"""
CTE["river"] = f"""
SELECT {SCN}[l_orderkey%10+1] AS scenario, 'm'||((l_orderkey//10)%2) AS member, l_orderkey AS event_id, l_partkey AS centroid_id,
 max(greatest(l_quantity/8-{d(2.5)},0)) AS depth
FROM lineitem GROUP BY 1,2,3,4 HAVING max(greatest(l_quantity/8-{d(2.5)},0))>0"""
CTE["raster"] = f"""
SELECT p_partkey AS centroid_id, CASE WHEN p_partkey%11<>0 THEN p_size/{d(7000.0)} END AS bp,
 CASE WHEN p_partkey%5<>0 THEN p_size/{d(4.0)} END AS cfl FROM part"""
CTE["recipe"] = f"SELECT * FROM {values(A.recipe_rows())} t(scenario, source, weight)"
CTE["weights"] = """
SELECT scenario, source, weight/sum(weight) OVER (PARTITION BY scenario) AS weight
FROM recipe WHERE source IN (SELECT source FROM cat)"""
CTE["scen"] = f"""
SELECT scenario, w, 1+{d(0.07)}*w AS rain_k, 1+{d(0.14)}*w AS fire_k FROM {values([(k, float(v)) for k, v in A.WARMING.items()])} t(scenario, w)"""
CTE["wl"] = f"""
SELECT w.source, w.event_id, k.site_key, least({wind_mdd('w.intensity', 'k.v_half')}*k.wind_mult,1)*k.asset_value_usd AS wind_loss
FROM wind w JOIN site_cell m USING (centroid_id) JOIN knobs k USING (site_key)"""
CTE["sl"] = f"""
SELECT s.source, s.event_id, k.site_key, {flood_mdd('s.depth', 'k.fb_coast', 'k.flood_cap')}*k.asset_value_usd AS surge_loss
FROM surge s JOIN site_cell m USING (centroid_id) JOIN knobs k USING (site_key)"""
CTE["joint"] = """
SELECT source, event_id, site_key, coalesce(wind_loss,0) AS wind_loss, coalesce(surge_loss,0) AS surge_loss,
 coalesce(wind_loss,0)+coalesce(surge_loss,0) AS loss, c.freq, c.event_name, s.country
FROM wl FULL JOIN sl USING (source, event_id, site_key) JOIN cat c USING (source, event_id) JOIN sites s USING (site_key)"""
CTE["storm_ead"] = """
SELECT w.scenario, e.site_key, sum(e.tc*w.weight) AS tc, sum(e.cflood*w.weight) AS cflood
FROM (SELECT source, site_key, sum(freq*wind_loss) AS tc, sum(freq*surge_loss) AS cflood FROM joint GROUP BY 1,2) e
JOIN weights w USING (source) GROUP BY 1,2"""
CTE["river_n"] = "SELECT scenario, count(DISTINCT member) AS n FROM river GROUP BY 1"
CTE["river_l"] = f"""
SELECT r.scenario, r.member, r.event_id, k.site_key, k.country, c.freq, {flood_mdd('r.depth', 'k.fb_river', 'k.flood_cap')}*k.asset_value_usd AS loss
FROM river r JOIN site_cell m USING (centroid_id) JOIN knobs k USING (site_key) JOIN cat c USING (event_id)"""
CTE["rain_l"] = f"""
SELECT sc.scenario, r.event_id, k.site_key, k.country, c.freq,
 {flood_mdd(pond('r.mm*sc.rain_k'), 'k.fb_rain', 'k.flood_cap')}*k.asset_value_usd AS loss
FROM rain r JOIN site_cell m USING (centroid_id) JOIN knobs k USING (site_key) JOIN cat c USING (event_id), scen sc"""
_cond = (f"CASE WHEN cfl IS NULL OR cfl<0 THEN {d(0.35)} WHEN cfl<=2 THEN {d(0.02)} WHEN cfl<=4 THEN {d(0.1)} "
         f"WHEN cfl<=8 THEN {d(0.3)} WHEN cfl<=12 THEN {d(0.55)} ELSE {d(0.8)} END")
CTE["fire_l"] = f"""
SELECT sc.scenario, k.site_key, k.country, least(r.bp*sc.fire_k,1) AS p, least(({_cond})*k.fire_vuln,1)*k.asset_value_usd AS loss
FROM raster r JOIN site_cell m USING (centroid_id) JOIN knobs k USING (site_key), scen sc WHERE r.bp IS NOT NULL"""
CTE["site_peril"] = """
SELECT scenario, site_key, 'tc' AS peril, tc AS ead FROM storm_ead
UNION ALL SELECT scenario, site_key, 'cflood', cflood FROM storm_ead
UNION ALL SELECT scenario, site_key, 'rflood', sum(freq*loss)/any_value(n) FROM river_l JOIN river_n USING (scenario) GROUP BY 1,2
UNION ALL SELECT scenario, site_key, 'prain', sum(freq*loss) FROM rain_l GROUP BY 1,2
UNION ALL SELECT scenario, site_key, 'wfire', p*loss FROM fire_l"""
CTE["site_ead"] = "SELECT scenario, site_key, " + ", ".join(
    f"sum(CASE WHEN peril='{p}' THEN ead ELSE 0 END) AS {p}" for p in A.ACUTE) + ", sum(ead) AS acute FROM site_peril GROUP BY 1,2"


def curve(src: str, keys: str, loss: str = "loss", order: str = "event_id", freq: str = "freq", rps: list[int] = RPS,
          step: bool = False) -> str:
    """Long (keys, rp, loss) exceedance losses by plain windows."""
    rp = values([(r,) for r in rps])
    cum = (f"SELECT {keys}, {loss} AS l, sum({freq}) OVER w AS cum FROM {src} WHERE {freq}>0 AND {loss}>0 "
           f"WINDOW w AS (PARTITION BY {keys} ORDER BY {loss} DESC, {order} ROWS UNBOUNDED PRECEDING)")
    k = ", ".join("b." + x.strip() for x in keys.split(","))
    if step:
        return (f"SELECT {k}, r.rp, max(CASE WHEN b.cum>=1/CAST(r.rp AS DOUBLE)-1e-12 THEN b.l ELSE 0 END) AS loss "
                f"FROM ({cum}) b, {rp} r(rp) GROUP BY {k}, r.rp")
    br = (f"SELECT *, 1/cum AS hi, lag(1/cum) OVER v AS up, lag(l) OVER v AS lup FROM ({cum}) "
          f"WINDOW v AS (PARTITION BY {keys} ORDER BY cum)")
    val = ("CASE WHEN b.up IS NULL THEN b.l ELSE b.l+(ln(CAST(r.rp AS DOUBLE))-ln(b.hi))/(ln(b.up)-ln(b.hi))*(b.lup-b.l) END")
    inside = ("1/CAST(r.rp AS DOUBLE)<=b.cum+1e-12 AND (b.up IS NULL OR 1/CAST(r.rp AS DOUBLE)>1/b.up+1e-12)")
    return f"SELECT {k}, r.rp, max({val}) AS loss FROM ({br}) b, {rp} r(rp) WHERE {inside} GROUP BY {k}, r.rp"


CTE["storm_curve"] = f"""
SELECT w.scenario, e.rp, sum(e.loss*w.weight) AS loss FROM
({curve('(SELECT country, source, event_id, freq, sum(loss) AS loss FROM joint GROUP BY 1,2,3,4)', 'country, source')}) e JOIN weights w USING (source) GROUP BY 1,2"""
CTE["river_curve"] = f"""
SELECT e.scenario, e.rp, sum(e.loss/n) AS loss FROM
({curve('(SELECT scenario, member, country, event_id, freq, sum(loss) AS loss FROM river_l GROUP BY 1,2,3,4,5)', 'scenario, member, country')}) e
JOIN river_n USING (scenario) GROUP BY 1,2"""
CTE["rain_curve"] = f"""SELECT scenario, rp, sum(loss) AS loss FROM
({curve('(SELECT scenario, country, event_id, freq, sum(loss) AS loss FROM rain_l GROUP BY 1,2,3,4)', 'scenario, country')}) GROUP BY 1,2"""
CTE["fire_curve"] = f"SELECT scenario, rp, sum(loss) AS loss FROM ({curve('fire_l', 'scenario, country', order='site_key', freq='p')}) GROUP BY 1,2"


def lad(src: str, keys: str, loss: str = "loss", rps: list[int] = A.LADDER_RPS) -> str:
    return curve(src, keys, loss=loss, rps=rps, step=True)


CTE["lad_joint"] = f"""
SELECT w.scenario, e.site_key, e.rp, sum(e.loss*w.weight) AS loss FROM ({lad('joint', 'source, site_key')}) e JOIN weights w USING (source) GROUP BY 1,2,3"""
CTE["lad_river"] = f"""
SELECT e.scenario, e.site_key, e.rp, sum(e.loss/n) AS loss FROM ({lad('river_l', 'scenario, member, site_key')}) e JOIN river_n USING (scenario) GROUP BY 1,2,3"""
CTE["lad_rain"] = lad('rain_l', 'scenario, site_key')
CTE["parts"] = """
SELECT w.scenario, n.country, w.source, round(w.weight,6) AS weight, coalesce(j.aal,0) AS aal, coalesce(j.kept,0) AS kept
FROM weights w CROSS JOIN (SELECT DISTINCT country FROM sites) n LEFT JOIN
(SELECT country, source, sum(freq*loss) AS aal, sum(CASE WHEN loss>=1000 THEN freq*round(loss,2) ELSE 0 END) AS kept FROM joint GROUP BY 1,2) j
ON j.country=n.country AND j.source=w.source"""
CTE["events_s"] = """
SELECT w.scenario, j.country, j.source, round(w.weight,6) AS weight, j.event_id,
 coalesce(j.event_name, j.source||':'||j.event_id) AS event, j.freq, j.site_key, round(j.loss,2) AS loss_usd
FROM joint j JOIN weights w USING (source) WHERE j.loss>=1000 AND w.scenario IN ('present','ssp245_2050')"""

# --- grid scoring -----------------------------------------------------------------------------


def near_grid(name: str, cond: str) -> None:
    h = hav('latitude', 'longitude', 'lat', 'lon')
    CTE[name] = f"""
SELECT site_key, centroid_id, p_size FROM
(SELECT site_key, centroid_id, p_size, round({h},6) AS km, row_number() OVER (PARTITION BY site_key ORDER BY round({h},6), lat, lon) AS rn
 FROM sites, ucen WHERE {cond}) WHERE rn=1 AND km<=200"""


near_grid("near1", "true")
near_grid("near2", "centroid_id%2=0")
near_grid("near3", "centroid_id%3=0")
near_grid("near4", "centroid_id%4=0")
_wsum = " , ".join
CTE["scr"] = f"""
SELECT site_key, CASE WHEN sw<1e-6 THEN 13 ELSE sv/sw END AS v100, CASE WHEN sw<1e-6 THEN {d(3.2)} ELSE sb/sw END AS slope, coast FROM
(SELECT site_key, sum(w) AS sw, sum(w*av) AS sv, sum(w*ab) AS sb FROM
 (SELECT site_key, av, ab, exp(-power({hav('latitude', 'longitude', 'alat', 'alon')}/380,2)) AS w
  FROM sites, {values(A.WIND_ANCHORS)} a(alat, alon, av, ab)) GROUP BY 1)
JOIN (SELECT site_key, min({hav('latitude', 'longitude', 'alat', 'alon')}) AS coast FROM sites, {values(A.COAST_ANCHORS)} c(alat, alon) GROUP BY 1) USING (site_key)"""
_slr = values([(r, k, float(v)) for r, t in A.SEA_LEVEL.items() for k, v in t.items()])
CTE["site_region"] = f"SELECT site_key, {box('latitude', 'longitude', A.SEA_LEVEL_BOXES, chr(39) + 'global_mean' + chr(39))} AS region FROM sites"


def hazards_cte(scenarios: list[str]) -> dict[str, str]:
    """CTEs hz (wide hazard inputs) and pv (long intensity vectors) for the given scenarios."""
    scen = values([(s, float(A.WARMING[s])) for s in scenarios])
    wind_step, depth_step, rain_step = [0, 6, 11, 16, 22, 26], [0, .4, .8, 1.2, 1.6, 2.0], [0, 40, 80, 120, 180, 230]
    out = {"hz": f"""
SELECT k.*, sc.scenario, sc.w, n1.p_size AS z1, n2.p_size AS z2, n3.p_size AS z3, n4.p_size AS z4, r.v100, r.slope, r.coast, sl.slr,
 exp(-r.coast/40) AS near, least(r.coast,400)/400 AS cont
FROM knobs k JOIN scr r USING (site_key) JOIN site_region g USING (site_key)
CROSS JOIN {scen} sc(scenario, w)
JOIN {_slr} sl(region, scenario, slr) ON sl.region=g.region AND sl.scenario=sc.scenario
LEFT JOIN near1 n1 USING (site_key) LEFT JOIN near2 n2 USING (site_key) LEFT JOIN near3 n3 USING (site_key) LEFT JOIN near4 n4 USING (site_key)"""}
    rel = lambda x: f"CASE WHEN relief IS NULL THEN {x} WHEN {x}>0 THEN greatest({x}-relief,0) ELSE 0 END"
    cols = {"tc": [], "cflood": [], "rflood": [], "prain": []}
    for i, rp in enumerate(RPS):
        cols["tc"].append(f"CASE WHEN z1 IS NOT NULL THEN (z1*{d(.5)}+18+{wind_step[i]})*(1+{d(.02)}*w) "
                          f"ELSE greatest(v100*(1+{d(.02)}*w)-slope*{d(math.log(100))}+slope*{d(math.log(rp))},0) END AS v{rp}")
        g = f"greatest(z2/{d(10.)}-2+{d(float(depth_step[i]))},0)"
        c = (f"(CASE WHEN z2 IS NOT NULL THEN (CASE WHEN {g}>0 THEN {g}+w*{d(.1)} ELSE 0 END) "
             f"ELSE greatest({d(1.8)}*near*({d(.5)}+{d(.5)}*greatest(v100,0)/{d(74.7)})*{d(A.SURGE_SHAPE[rp])}+slr*near,0) END)")
        cols["cflood"].append(rel(c) + f" AS v{rp}")
        rv = (f"(CASE WHEN z3 IS NOT NULL THEN greatest(z3/{d(12.5)}-2+{d(float(depth_step[i]))},0)*(1+{d(.05)}*w) "
              f"ELSE {d(.8)}*({d(.3)}+{d(.7)}*cont)*{d(A.RIVER_SHAPE[rp])}*(1+{d(.05)}*w) END)")
        cols["rflood"].append(rel(rv) + f" AS v{rp}")
        cols["prain"].append(f"CASE WHEN z1 IS NOT NULL THEN z1*{d(8.)}+{rain_step[i]} ELSE 0 END AS v{rp}")
    out["pv"] = " UNION ALL ".join(f"SELECT site_key, scenario, '{p}' AS peril, {', '.join(c)} FROM hz" for p, c in cols.items())
    r = f"(100*least({d(.8)},{d(.45)}+{d(.35)}*exp(-coast/60)))"
    qa = f"({d(-6.83783e-3)}+{d(1.22874e-3)}*{r}+{d(-1.99e-6)}*{r}*{r})"
    qb = f"({d(2.04901523)}+{d(-.22475541)}*{r}+{d(8.5282e-4)}*{r}*{r})"
    qc = f"({d(-42.379)}-95+{d(10.14333127)}*{r}+{d(-5.481717e-2)}*{r}*{r})"
    root = lambda s: f"((-{qb}{s}sqrt({qb}*{qb}-4*{qa}*{qc}))/(2*{qa}))"
    tstar = f"((greatest({root('+')},{root('-')})-32)*5/9)"
    t = f"(34-{d(.35)}*(abs(latitude)-18)+6*cont+w)"
    days = lambda lim: f"floor(200/(1+exp(-({t}-{lim})/{d(1.6)}))+{d(.5)})"
    hu = lambda x: f"floor({x}+{d(.5)})"
    g32, g35, gc = hu("(z1*3+w*10)"), hu(f"(z1*{d(1.5)}+w*6)"), hu("(z1*50+1000)")
    out["heat"] = f"""
SELECT site_key, scenario, CASE WHEN z1 IS NOT NULL THEN {g32} ELSE {days('32')} END AS d32,
 CASE WHEN z1 IS NOT NULL THEN {g35} ELSE {days('35')} END AS d35,
 CASE WHEN z1 IS NOT NULL THEN {gc} ELSE {hu(f'greatest({t}-18,0)*210')} END AS cdd,
 CASE WHEN z1 IS NOT NULL THEN greatest(CASE WHEN {tstar}>=35 THEN {g35} WHEN {tstar}<=32 THEN {g32}
   ELSE {hu(f'({g35}+({g32}-{g35})*(35-{tstar})/3)')} END, {g35}) ELSE greatest({days(tstar)},{days('35')}) END AS dhum FROM hz"""
    wui = f"(CASE wui_class WHEN 'interface' THEN {d(.3)} WHEN 'intermix' THEN {d(.6)} ELSE 0 END)"
    out["fire"] = f"""
SELECT site_key, scenario, CASE WHEN z4 IS NOT NULL THEN least(greatest(z4/{d(25.)}*(1+{d(.14)}*w),0),100) ELSE {wui}*(1+{d(.14)}*w) END AS pct,
 CASE WHEN z4 IS NOT NULL AND z4%5<>0 THEN least(z4/{d(100.)},1) ELSE {d(.35)} END AS cond, {wui}>0 AS has_wui FROM hz"""
    return out


KNOBS = ["k_haz", "k_dmg", "k_exp", "k_rev", "k_reopen", "k_tc", "k_fb", "k_red", "k_fire", "k_heat"]
NEUTRAL = dict(zip(KNOBS, [1., 1., 1., 1., 1., 1., 0., 0., 1., 1.]))


def eval_cte(sets: dict[str, dict], p: str = "b") -> dict[str, str]:
    """CTEs <p>_fr (peril fraction by rp) and <p>_int (annual fraction) and <p>_tot per knob set."""
    rows = [(s, *[float(k.get(n, NEUTRAL[n])) for n in KNOBS]) for s, k in sets.items()]
    ks = f"{values(rows)} ks(ks, {', '.join(KNOBS)})"
    out = {}
    vec = ", ".join(f"CASE peril WHEN 'prain' THEN {pond(f'v{rp}*k_haz')} WHEN 'cflood' THEN greatest(v{rp}*k_haz-k_red,0) ELSE v{rp}*k_haz END AS x{rp}" for rp in RPS)
    out[f"{p}_x"] = f"SELECT ks.*, pv.site_key, pv.scenario, pv.peril, {vec} FROM pv CROSS JOIN {ks}"
    slope = f"greatest((greatest(x25,0)-greatest(x10,0))/({d(math.log(25))}-{d(math.log(10))}),0)"
    sub = lambda rp: f"greatest(greatest(x10,0)-{slope}*({d(math.log(10))}-{d(math.log(rp))}),0)"
    pts = "[" + ",".join([f"{{'rp':2,'v':{sub(2)}}}", f"{{'rp':5,'v':{sub(5)}}}"] + [f"{{'rp':{rp},'v':x{rp}}}" for rp in RPS]) + "]"
    out[f"{p}_pts"] = f"SELECT * EXCLUDE (u, x10, x25, x50, x100, x250, x500), u.rp AS rp, u.v AS v FROM (SELECT *, unnest({pts}) AS u FROM {p}_x)"
    fb = "(CASE peril WHEN 'cflood' THEN fb_coast WHEN 'rflood' THEN fb_river ELSE fb_rain END + k_fb)"
    out[f"{p}_fr"] = f"""
SELECT q.*, least(CASE peril WHEN 'tc' THEN {wind_mdd('v', 'v_half')}*wind_mult*k_tc*k_dmg
  ELSE {flood_mdd('greatest(v,0)', fb, 'flood_cap')}*k_dmg END,1) AS frac FROM {p}_pts q JOIN knobs k USING (site_key)"""
    out[f"{p}_int"] = f"""
SELECT ks, site_key, scenario, peril, sum(CASE WHEN nrp IS NULL THEN frac/rp ELSE (frac+nf)/2*(1/CAST(rp AS DOUBLE)-1/CAST(nrp AS DOUBLE)) END) AS annual
FROM (SELECT *, lead(rp) OVER o AS nrp, lead(frac) OVER o AS nf FROM {p}_fr WINDOW o AS (PARTITION BY ks, site_key, scenario, peril ORDER BY rp)) GROUP BY 1,2,3,4
UNION ALL SELECT ks, site_key, scenario, 'wfire', least(pct/100*k_haz,1)*cond*fire_vuln*k_dmg*k_fire FROM fire JOIN knobs USING (site_key) CROSS JOIN {ks}"""
    out[f"{p}_tot"] = f"""
SELECT t.ks, t.site_key, t.scenario, t.f*asset_value_usd*k_exp AS direct, t.f*gop*k_exp*k_rev*(12*k_reopen/12) AS bi,
 gop*k_exp*k_rev/365*greatest(d35-15,0)*{d(.12)}*k_heat AS heat
FROM (SELECT ks, site_key, scenario, sum(annual) AS f FROM {p}_int GROUP BY 1,2,3) t JOIN knobs USING (site_key) JOIN heat USING (site_key, scenario)
JOIN {ks} USING (ks)"""
    return out


def scored_cte() -> dict[str, str]:
    """CTEs sc (wide scored sites), lrp (long losses by return period), fin (finance per site)."""
    out = eval_cte({"base": {}})
    ead = ", ".join(f"sum(CASE WHEN peril='{p}' THEN annual END) AS f_{p}" for p in A.ACUTE)
    tot = "+".join(f"f_{p}" for p in A.ACUTE)
    out["sc"] = f"""
SELECT h.*, i.* EXCLUDE (site_key, scenario), {', '.join(f'f_{p}*asset_value_usd AS ead_{p}' for p in A.ACUTE)},
 ({tot})*asset_value_usd AS ead, ({tot})*100 AS ead_pct, {band(f'(({tot})*100)')} AS band, d32, d35, cdd, dhum, pct AS fire_pct, cond AS fire_cond, has_wui,
 z1 IS NOT NULL AS on_tc, z2 IS NOT NULL AS on_cflood, z3 IS NOT NULL AS on_rflood, z1 IS NOT NULL AS on_heat, z4 IS NOT NULL AS on_wfire, z1 IS NOT NULL AS on_prain
FROM hz h JOIN (SELECT site_key, scenario, {ead} FROM b_int GROUP BY 1,2) i USING (site_key, scenario)
JOIN heat USING (site_key, scenario) JOIN fire USING (site_key, scenario)"""
    out["lrp"] = f"""
SELECT site_key, scenario, peril, rp, frac*asset_value_usd AS loss FROM b_fr JOIN knobs USING (site_key) WHERE rp>=10
UNION ALL SELECT site_key, scenario, 'wfire', rp, CASE WHEN pct>=100/CAST(rp AS DOUBLE) THEN cond*fire_vuln*asset_value_usd ELSE 0 END
FROM fire JOIN knobs USING (site_key), {values([(r,) for r in RPS])} r(rp)"""
    out["fin"] = f"""
SELECT sc.*, ead AS direct_ead, gop*({tot}) AS bi_ead, gop/365*greatest(d35-15,0)*{d(.12)} AS heat_cost,
 ead+gop*({tot})+gop/365*greatest(d35-15,0)*{d(.12)} AS total_aal FROM sc"""
    return out


def query(main: str, extra: dict[str, str] | None = None) -> str:
    """A complete statement: the CTEs a query needs, in dependency order, and its body."""
    pool = CTE | (extra or {})
    order: list[str] = []
    open_names: set[str] = set()

    def visit(text: str) -> None:
        bare = re.sub(r"'[^']*'", "", text)
        for word in dict.fromkeys(re.findall(r"(?=(?:FROM|JOIN|,)\s*\(?\s*([A-Za-z_][A-Za-z_0-9]*)\b(?![.(]))", bare)):
            if word in pool and word not in order and word not in open_names:
                open_names.add(word)
                visit(pool[word])
                order.append(word)

    visit(main)
    if not order:
        return main
    return "WITH " + ", ".join(f"{n} AS ({pool[n]})" for n in order) + " " + main
