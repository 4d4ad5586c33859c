"""Total-cost-of-risk, claims and schedule queries."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from perilframe import assumptions as A
from perilframe.functions import profile
from perilframe.operators import claims as cl
from perilframe.operators import matching, tcor
from perilframe.plans import standin as S

from .context import S2, events, impact, insured, location_ladders, r, rounded, scored
from .q_score import X2, _gk
from .registry import register
from .sql_parts import CTE, d, query, rnd, values

DED = A.DEDUCTIBLE
_L = A.LADDER_RPS
_f = [1 / x for x in _L]
_w = [0.5 * ((_f[i - 1] if i else _f[0]) - (_f[i + 1] if i + 1 < len(_f) else _f[i])) for i in range(len(_f))]
_w[-1] += _f[-1]


def _ladsum(expr: str, fmin: float = 0.0) -> str:
    """Trapezoid over exceedance frequency written as rung weights."""
    if fmin:
        keep = [x for x in _L if 1 / x >= fmin]
        f = [1 / x for x in keep]
        w = [0.5 * ((f[i - 1] if i else f[0]) - (f[i + 1] if i + 1 < len(f) else f[i])) for i in range(len(f))]
        return f"sum(({expr})*CASE rp " + " ".join(f"WHEN {x} THEN {d(y)}" for x, y in zip(keep, w)) + " ELSE 0 END)"
    return f"sum(({expr})*CASE rp " + " ".join(f"WHEN {x} THEN {d(y)}" for x, y in zip(_L, _w)) + " END)"


_rpv = values([(x,) for x in _L])
X = {**X2,
     "ins": "SELECT *, coalesce('campus:'||lower(campus_code),'site:'||site_key) AS campus FROM knobs",
     # interim ladders: loss space extension below 1-in-10
     "il0": "SELECT site_key, scenario, peril, rp, loss FROM lrp UNION ALL SELECT site_key, scenario, 'tc_joint', rp, sum(loss) FROM lrp WHERE peril IN ('tc','cflood') GROUP BY 1,2,4",
     "il1": "SELECT site_key, scenario, peril, max(CASE WHEN rp=10 THEN loss END) AS l10, max(CASE WHEN rp=25 THEN loss END) AS l25 FROM lrp GROUP BY 1,2,3",
     "il2": f"SELECT site_key, scenario, peril, r.rp, greatest(l10-greatest((l25-l10)/(ln(CAST(25 AS DOUBLE))-ln(CAST(10 AS DOUBLE))),0)*(ln(CAST(10 AS DOUBLE))-ln(CAST(r.rp AS DOUBLE))),0) AS loss FROM il1, {values([(2,), (5,)])} r(rp)",
     "il": "SELECT * FROM il0 UNION ALL SELECT * FROM il2 UNION ALL SELECT site_key, scenario, 'tc_joint', rp, sum(loss) FROM il2 WHERE peril IN ('tc','cflood') GROUP BY 1,2,4",
     "packl": f"""SELECT c.site_key, s.scenario, p.peril, r.rp, coalesce(l.loss,0) AS loss FROM site_cell c, {values([(x,) for x in S2])} s(scenario), {values([('rflood',), ('prain',)])} p(peril), {_rpv} r(rp)
LEFT JOIN (SELECT scenario, site_key, rp, loss, 'rflood' AS peril FROM lad_river UNION ALL SELECT scenario, site_key, rp, loss, 'prain' FROM lad_rain) l
 ON l.scenario=s.scenario AND l.site_key=c.site_key AND l.rp=r.rp AND l.peril=p.peril""",
     "lad": """SELECT i.site_key, i.scenario, i.peril, i.rp, coalesce(p.loss,i.loss) AS loss, CASE WHEN p.loss IS NOT NULL THEN 'pack' ELSE 'interim' END AS basis
FROM il i LEFT JOIN packl p ON p.site_key=i.site_key AND p.scenario=i.scenario AND p.peril=i.peril AND p.rp=i.rp""",
     "loc": f"""SELECT scenario, site_key, peril, CASE WHEN peril='wfire' THEN 'general' ELSE 'flood' END AS cls, basis, {_ladsum('loss')} AS gross,
 {_ladsum("least(loss,CASE WHEN peril='wfire' THEN 50000 ELSE 100000 END)")} AS retained, {_ladsum("least(loss,CASE WHEN peril='wfire' THEN 50000 ELSE 100000 END)", .1)} AS frequent,
 coalesce(max(CASE WHEN loss>=1 THEN 1/CAST(rp AS DOUBLE) END),0) AS hit_freq, coalesce(max(CASE WHEN loss>=CASE WHEN peril='wfire' THEN 50000 ELSE 100000 END THEN 1/CAST(rp AS DOUBLE) END),0) AS full_freq
FROM lad WHERE peril IN ('rflood','prain','wfire') GROUP BY 1,2,3,4,5""",
     "ev": "SELECT e.*, i.campus FROM events_s e JOIN ins i USING (site_key)",
     "evg": "SELECT scenario, country, source, event_id, campus, any_value(weight)*any_value(freq) AS wf, sum(loss_usd) AS gross, least(sum(loss_usd),1000000) AS retained FROM ev GROUP BY 1,2,3,4,5",
     "evs": """SELECT e.scenario, e.site_key, sum(e.weight*e.freq*e.loss_usd) AS gross, sum(e.weight*e.freq*e.loss_usd/g.gross*g.retained) AS retained
FROM ev e JOIN evg g USING (scenario, country, source, event_id, campus) GROUP BY 1,2""",
     }
X["prop"] = "SELECT scenario, site_key, " + ", ".join(f"sum(CASE WHEN cls='{c}' THEN {v} ELSE 0 END) AS {v}_{c}" for c in DED for v in ("gross", "retained")) + """, sum(frequent) AS frequent FROM
(SELECT scenario, site_key, 'hurricane' AS cls, gross, retained, 0 AS frequent FROM evs UNION ALL SELECT scenario, site_key, cls, gross, retained, frequent FROM loc) GROUP BY 1,2"""

# seasonal months: cumulative weight of q months from month m, and the weight of the next one
_mon = values([(reg, m, q, float(sum(s[(m + j) % 12] for j in range(q))), float(s[(m + q) % 12])) for reg, s in A.BI_SEASON.items() for m in range(12) for q in range(14)])
_tim = values([("storm", m, w) for m, w in enumerate(A.BI_STORM_MONTHS) if w > 0] + [("flat", m, 1 / 12) for m in range(12)])


def bi_cte(name: str, src: str, cols: str) -> dict[str, str]:
    """Policy split averaged over arrival months; src has cols, site_key, loss, timing."""
    nodes = A.BI_DOWNTIME_NODES
    dn = "CASE " + " ".join(f"WHEN dmg<={d(x1)} THEN {d(y0)}+(dmg-{d(x0)})*{d((y1 - y0) / (x1 - x0))}" for (x0, y0), (x1, y1) in zip(nodes, nodes[1:])) + " ELSE 1 END*365"
    seg = lambda a: f"(({a}.cum*{d(30.44)})+({a}d-{a}q*{d(30.44)})*{a}.nxt)"
    return {
        f"{name}_a": f"""SELECT t.*, region, gop/365*(1-least(greatest(coalesce(timeshare_share,0),0),1)*{d(.65)}) AS daily, CASE WHEN bi_ee_usd>0 THEN bi_ee_usd END AS lim,
 least(greatest(loss,0)/asset_value_usd,1) AS dmg FROM ({src}) t JOIN knobs USING (site_key) JOIN site_region USING (site_key)""",
        f"{name}_b": f"SELECT *, CASE WHEN dmg<=0 THEN 0 WHEN dmg>={d(.1)} THEN greatest({dn},120) ELSE {dn} END AS dn FROM {name}_a",
        f"{name}_c": f"SELECT *, dn AS ad, floor(dn/{d(30.44)}) AS aq, least(dn,3) AS bd, floor(least(dn,3)/{d(30.44)}) AS bq, least(dn,365) AS cd, floor(least(dn,365)/{d(30.44)}) AS cq FROM {name}_b",
        f"{name}_m": f"""SELECT {cols}, t.site_key, m.w, daily, lim, dn, {seg('a')} AS sa, {seg('b')} AS sb, {seg('c')} AS scx FROM {name}_c t JOIN {_tim} m(timing, m, w) ON m.timing=t.timing
JOIN {_mon} a(region, m, q, cum, nxt) ON a.region=t.region AND a.m=m.m AND a.q=aq JOIN {_mon} b(region, m, q, cum, nxt) ON b.region=t.region AND b.m=m.m AND b.q=bq
JOIN {_mon} c(region, m, q, cum, nxt) ON c.region=t.region AND c.m=m.m AND c.q=cq""",
        name: f"""SELECT {cols.replace('t.', '')}, site_key, sum(w*daily*sa) AS gross, sum(w*daily*sb) AS waiting, sum(w*(daily*(sa-scx)+coalesce(greatest(greatest(daily*(scx-sb),0)-lim,0),0))) AS overage
FROM {name}_m GROUP BY ALL""",
    }


X |= bi_cte("bie", "SELECT scenario, country, source, event_id, weight*freq AS wf, site_key, loss_usd AS loss, 'storm' AS timing FROM events_s", "t.scenario, t.country, t.source, t.event_id, t.wf")
X |= bi_cte("bil", "SELECT scenario, peril, rp, site_key, loss, CASE WHEN peril='prain' THEN 'storm' ELSE 'flat' END AS timing FROM lad WHERE peril IN ('rflood','prain','wfire')", "t.scenario, t.peril, t.rp")
X["bis"] = f"""SELECT scenario, site_key, sum(gross) AS gross, sum(waiting) AS waiting, sum(overage) AS overage FROM
(SELECT scenario, site_key, sum(wf*gross) AS gross, sum(wf*waiting) AS waiting, sum(wf*overage) AS overage FROM bie GROUP BY 1,2
 UNION ALL SELECT scenario, site_key, {_ladsum('gross')}, {_ladsum('waiting')}, {_ladsum('overage')} FROM bil GROUP BY 1,2) GROUP BY 1,2"""
_SW = 8 * 30.44
X["shk"] = f"""SELECT e.scenario, e.country, e.source, e.event_id, g.region, any_value(e.weight*e.freq) AS wf, sum(CASE WHEN least(e.loss_usd/k.asset_value_usd,1)>={d(.1)} THEN k.asset_value_usd ELSE 0 END) AS hurt
FROM events_s e JOIN knobs k USING (site_key) JOIN site_region g USING (site_key) GROUP BY 1,2,3,4,5"""
X["shr"] = f"""SELECT s.*, least({d(.6)},{d(1.2)}*hurt/t.tiv) AS s0 FROM shk s JOIN (SELECT region, sum(asset_value_usd) AS tiv FROM knobs JOIN site_region USING (site_key) GROUP BY 1) t USING (region) WHERE hurt/t.tiv>={d(.02)}"""
X["dns"] = "SELECT scenario, country, source, event_id, site_key, dn FROM bie_b"
X["shock"] = f"""SELECT r.scenario, k.site_key, sum(r.wf*r.s0*gop/365*(1-least(greatest(coalesce(timeshare_share,0),0),1)*{d(.65)})*power(greatest({d(_SW)}-coalesce(x.dn,0),0),2)/(2*{d(_SW)})) AS shock
FROM shr r JOIN site_region g ON g.region=r.region JOIN knobs k ON k.site_key=g.site_key
LEFT JOIN dns x ON x.scenario=r.scenario AND x.country=r.country AND x.source=r.source AND x.event_id=r.event_id AND x.site_key=k.site_key GROUP BY 1,2"""
_tr = "+".join(f"greatest(gross_{c}-retained_{c},0)" for c in DED)
X["prem"] = f"""SELECT p.scenario, p.site_key, k.asset_value_usd, CASE WHEN premium_annual_usd>0 THEN premium_annual_usd END AS actual,
 {_tr}+greatest(coalesce(b.gross,0)-coalesce(b.waiting+b.overage,0),0) AS el FROM prop p JOIN knobs k USING (site_key) LEFT JOIN bis b ON b.scenario=p.scenario AND b.site_key=p.site_key"""
X["tc"] = f"""SELECT p.scenario, p.site_key, k.name, k.brand, k.site_id, k.latitude, k.longitude, k.asset_value_usd, {'+'.join(f'gross_{c}' for c in DED)} AS gross_property, {'+'.join(f'retained_{c}' for c in DED)} AS retained_property, p.frequent,
 coalesce(b.gross,0) AS bi_gross, coalesce(b.waiting+b.overage,0) AS retained_bi, coalesce(m.actual,m.el*{d(1.5)}) AS premium, coalesce(k.mitigation_annual_usd,0) AS mitigation,
 coalesce(b.gross,0)*{d(.15)}+coalesce(s.shock,0) AS indirect,
 concat_ws('; ', CASE WHEN campus_code IS NULL THEN 'campus grouping' END, CASE WHEN annual_revenue_usd IS NULL THEN 'site revenue' END, CASE WHEN bi_ee_usd IS NULL THEN 'interruption limit' END,
  CASE WHEN premium_annual_usd IS NULL THEN 'actual premium' END, 'interruption policy terms are defaults') AS missing
FROM prop p JOIN knobs k USING (site_key) LEFT JOIN bis b ON b.scenario=p.scenario AND b.site_key=p.site_key JOIN prem m ON m.scenario=p.scenario AND m.site_key=p.site_key LEFT JOIN shock s ON s.scenario=p.scenario AND s.site_key=p.site_key"""


class Model:
    """The pieces of one total-cost evaluation, built once per query."""

    def __init__(self, spark, sf):
        self.sites = insured(spark, sf)
        self.events = events(spark, sf)
        self.ladders = location_ladders(spark, sf)
        self.groups = tcor.event_retained(self.events, self.sites)
        self.storm = tcor.storm_by_site(self.events, self.groups, self.sites)
        self.location = tcor.location_retained(self.ladders)
        # one row per site and scenario each, read by premium, total and calibration
        self.prop = tcor.site_property(self.storm, self.location, self.sites).persist(StorageLevel.MEMORY_AND_DISK)

    def interruption(self):
        parts = [tcor.interruption_events(self.events, self.sites),
                 tcor.interruption_ladders(self.ladders, self.sites, ["rflood", "prain", "wfire"])]
        return tcor.site_interruption(parts).persist(StorageLevel.MEMORY_AND_DISK)

    def total(self):
        inter = self.interruption()
        prem = tcor.premium(self.prop, inter, self.sites)
        return tcor.site_tcor(self.prop, inter, prem, self.sites, tcor.demand_shock(self.events, self.sites))


@register("event_retained", query(f"""
SELECT scenario, {rnd('sum(wf*g)', 0)} AS annual_gross, {rnd('sum(wf*r)', 0)} AS annual_retained, {rnd('sum(wf)', 5)} AS occurrence_freq, {rnd('sum(wf*n)', 5)} AS full_deductible_freq FROM
(SELECT scenario, country, source, event_id, any_value(wf) AS wf, sum(gross) AS g, sum(retained) AS r, count(*) FILTER (WHERE gross>=1000000) AS n FROM evg GROUP BY 1,2,3,4) GROUP BY 1""", X))
def event_retained(spark, sf):
    df = tcor.storm_totals(tcor.event_retained(events(spark, sf), insured(spark, sf)))
    return rounded(df.select("scenario", "annual_gross", "annual_retained", "occurrence_freq", "full_deductible_freq"),
                   {"annual_gross": 0, "annual_retained": 0, "occurrence_freq": 5, "full_deductible_freq": 5})


@register("event_retained_sites", query(f"SELECT scenario, site_key, {rnd('gross', 2)} AS gross, {rnd('retained', 2)} AS retained FROM evs", X))
def event_retained_sites(spark, sf):
    ev, ins = events(spark, sf), insured(spark, sf)
    return rounded(tcor.storm_by_site(ev, tcor.event_retained(ev, ins), ins), {"gross": 2, "retained": 2})


@register("event_list_top", query(f"""
SELECT scenario, country, source, event_id, {rnd('sum(loss_usd)', 2)} AS loss_usd, count(*) AS sites FROM events_s GROUP BY 1,2,3,4
ORDER BY count(*) DESC, any_value(weight)*any_value(freq)*sum(loss_usd) DESC, 1, 2, 3, 4 LIMIT 9""", X))
def event_list_top(spark, sf):
    df = tcor.event_list(events(spark, sf), insured(spark, sf))
    return rounded(df.select("scenario", "country", "source", "event_id", "loss_usd", "sites"), {"loss_usd": 2})


@register("ladder_retained", query(f"""
SELECT scenario, site_key, peril, basis, {rnd('gross', 2)} AS gross, {rnd('retained', 2)} AS retained, {rnd('frequent', 2)} AS frequent, {rnd('hit_freq', 4)} AS hit_freq, {rnd('full_freq', 4)} AS full_deductible_freq FROM loc""", X))
def ladder_retained(spark, sf):
    df = tcor.location_retained(location_ladders(spark, sf)).drop("cls")
    return rounded(df, {"gross": 2, "retained": 2, "frequent": 2, "hit_freq": 4, "full_deductible_freq": 4})


@register("attritional", query(f"SELECT scenario, {rnd('sum(frequent)', 0)} AS frequent_retained, {rnd('sum(CASE WHEN hit_freq>=0.1 THEN hit_freq ELSE 0 END)', 4)} AS frequent_hits FROM loc GROUP BY 1", X))
def attritional(spark, sf):
    return rounded(tcor.attritional(tcor.location_retained(location_ladders(spark, sf))), {"frequent_retained": 0, "frequent_hits": 4})


_cl = {**X, "cl": f"SELECT l.scenario, i.campus, l.rp, sum(l.loss) AS loss FROM il l JOIN ins i USING (site_key) WHERE l.peril='tc_joint' GROUP BY 1,2,3"}


@register("campus_ladder", query(f"""
SELECT scenario, campus, {rnd(_ladsum('loss'), 2)} AS gross, {rnd(_ladsum('least(loss,1000000)'), 2)} AS retained FROM cl GROUP BY 1,2""", _cl))
def campus_ladder(spark, sf):
    ins = insured(spark, sf)
    df = tcor.campus_ladders(tcor.interim_ladders(scored(spark, sf)), ins).select("scenario", "campus", "gross", "retained")
    return rounded(df, {"gross": 2, "retained": 2})


@register("campus_ladder_sites", query(f"""
SELECT o.scenario, o.site_key, {rnd('o.g', 2)} AS gross, {rnd('CASE WHEN t.gross<>0 THEN t.retained*o.g/t.gross ELSE 0 END', 2)} AS retained FROM
(SELECT l.scenario, l.site_key, i.campus, {_ladsum('loss')} AS g FROM il l JOIN ins i USING (site_key) WHERE peril='tc_joint' GROUP BY 1,2,3) o
JOIN (SELECT scenario, campus, {_ladsum('loss')} AS gross, {_ladsum('least(loss,1000000)')} AS retained FROM cl GROUP BY 1,2) t ON t.scenario=o.scenario AND t.campus=o.campus""", _cl))
def campus_ladder_sites(spark, sf):
    ins, lad = insured(spark, sf), tcor.interim_ladders(scored(spark, sf))
    return rounded(tcor.campus_by_site(lad, tcor.campus_ladders(lad, ins), ins), {"gross": 2, "retained": 2})


@register("interim_ladders", query(f"SELECT scenario, site_key, peril, CAST(rp AS INTEGER) AS rp, {rnd('loss', 3)} AS loss_usd FROM il", X))
def interim_ladders(spark, sf):
    from perilframe.operators.exceedance import explode_ladder
    rows = explode_ladder(tcor.interim_ladders(scored(spark, sf)).drop("basis"), _L)
    return rows.select("scenario", "site_key", "peril", "rp", r("loss", 3).alias("loss_usd"))


@register("ladder_bands", query(f"""
SELECT scenario, peril, CAST(b AS INTEGER) AS band, count(*) AS sites, {rnd('sum(rate*loss)', 0)} AS annual FROM
(SELECT scenario, site_key, peril, row_number() OVER w-1 AS b, 1/CAST(rp AS DOUBLE)-coalesce(1/CAST(lead(rp) OVER w AS DOUBLE),0) AS rate, CASE WHEN lead(rp) OVER w IS NULL THEN loss ELSE (loss+lead(loss) OVER w)/2 END AS loss
 FROM lad WHERE peril IN ('rflood','prain','wfire') WINDOW w AS (PARTITION BY scenario, site_key, peril ORDER BY rp)) WHERE loss>0 GROUP BY 1,2,3""", X))
def ladder_bands(spark, sf):
    b = tcor.ladder_bands(location_ladders(spark, sf).where(F.col("peril").isin("rflood", "prain", "wfire")))
    return b.groupBy("scenario", "peril", "band").agg(F.count("*").alias("sites"), r(F.sum(F.col("rate") * F.col("loss")), 0).alias("annual"))


@register("class_totals", query(" UNION ALL ".join(f"SELECT scenario, '{c}' AS cls, {rnd(f'sum(gross_{c})', 0)} AS annual_gross, {rnd(f'sum(retained_{c})', 0)} AS annual_retained FROM prop GROUP BY 1" for c in DED), X))
def class_totals(spark, sf):
    return rounded(tcor.class_totals(Model(spark, sf).prop).drop("annual_transferred"), {"annual_gross": 0, "annual_retained": 0})


@register("bi_event_split", query(f"SELECT scenario, site_key, {rnd('sum(wf*gross)', 3)} AS gross, {rnd('sum(wf*waiting)', 3)} AS waiting, {rnd('sum(wf*overage)', 3)} AS overage FROM bie GROUP BY 1,2", X))
def bi_event_split(spark, sf):
    df = tcor.interruption_events(events(spark, sf), insured(spark, sf))
    return rounded(df.select("scenario", "site_key", "gross", "waiting", "overage"), {"gross": 3, "waiting": 3, "overage": 3})


@register("bi_ladders", query(f"SELECT scenario, site_key, peril, {rnd(_ladsum('gross'), 2)} AS gross, {rnd(_ladsum('waiting'), 2)} AS waiting, {rnd(_ladsum('overage'), 2)} AS overage FROM bil GROUP BY 1,2,3", X))
def bi_ladders(spark, sf):
    df = tcor.interruption_ladders(location_ladders(spark, sf), insured(spark, sf), ["rflood", "prain", "wfire"])
    return rounded(df.drop("retained"), {"gross": 2, "waiting": 2, "overage": 2})


_wide = {**X, "events_s0": X.get("events_s", "") or CTE["events_s"]}
_wide["events_s"] = """SELECT scenario, country, source, any_value(weight) AS weight, event_id%5 AS event_id, CAST(0.02 AS DOUBLE) AS freq, site_key, max(loss_usd) AS loss_usd FROM events_s0 GROUP BY scenario, country, source, event_id%5, site_key"""


@register("demand_shock", query(f"SELECT scenario, site_key, {rnd('shock', 3)} AS demand_shock FROM shock", _wide))
def demand_shock(spark, sf):
    """Event losses folded into five wide regional events per catalog, so that regions are hit as a whole."""
    ev = events(spark, sf).groupBy("scenario", "country", "source", "weight", (F.col("event_id") % 5).alias("event_id"), "site_key").agg(
        F.max("loss_usd").alias("loss_usd")).withColumn("freq", F.lit(0.02))
    return rounded(tcor.demand_shock(ev, insured(spark, sf)), {"demand_shock": 3})


@register("premium_gap", query(f"""
SELECT scenario, site_key, {rnd('el*' + d(1.5), 2)} AS technical, {rnd('coalesce(actual,el*' + d(1.5) + ')', 2)} AS allocated, {rnd('actual-el*' + d(1.5), 2)} AS gap_usd, {rnd('coalesce(actual,el*' + d(1.5) + ')/asset_value_usd*100', 5)} AS rate_per_100 FROM prem""", X))
def premium_gap(spark, sf):
    m = Model(spark, sf)
    df = tcor.premium(m.prop, m.interruption(), m.sites).select("scenario", "site_key", "technical", "allocated", "gap_usd", "rate_per_100")
    return rounded(df, {"technical": 2, "allocated": 2, "gap_usd": 2, "rate_per_100": 5})


@register("premium_position", query(f"""
SELECT scenario, {rnd('sum(el)*' + d(1.5), 0)} AS technical_total, {rnd('sum(actual)', 0)} AS actual_total, count(actual) AS on_file, {rnd('sum(actual)/sum(CASE WHEN actual IS NOT NULL THEN el END)', 6)} AS implied_load,
 {rnd('sum(greatest(coalesce(actual-el*' + d(1.5) + ',0),0))', 0)} AS over_technical FROM prem GROUP BY 1""", X))
def premium_position(spark, sf):
    m = Model(spark, sf)
    df = tcor.premium_position(tcor.premium(m.prop, m.interruption(), m.sites))
    return rounded(df.select("scenario", "technical_total", "actual_total", "on_file", "implied_load", "over_technical"), {"technical_total": 0, "actual_total": 0, "implied_load": 6, "over_technical": 0})


_t = "(retained_property+retained_bi+premium+mitigation)"


@register("tcor_site", query(f"""
SELECT scenario, site_key, {rnd(_t, 2)} AS total, {rnd('retained_property', 2)} AS retained_property, {rnd('retained_bi', 2)} AS retained_bi, {rnd('premium', 2)} AS premium, {rnd('mitigation', 2)} AS mitigation,
 {rnd('indirect', 2)} AS indirect, missing FROM tc""", X))
def tcor_site(spark, sf):
    c = ["total", "retained_property", "retained_bi", "premium", "mitigation", "indirect"]
    df = Model(spark, sf).total().select("scenario", "site_key", *c, F.array_join("missing", "; ").alias("missing"))
    return rounded(df, {x: 2 for x in c})


@register("tcor_portfolio", query(f"""
SELECT scenario, {rnd(f'sum{_t}', 0)} AS total, {rnd('sum(gross_property)', 0)} AS gross_property, {rnd('sum(retained_bi)', 0)} AS retained_bi, {rnd('sum(bi_gross)', 0)} AS bi_gross, {rnd('sum(premium)', 0)} AS premium, {rnd('sum(indirect)', 0)} AS indirect FROM tc GROUP BY 1""", X))
def tcor_portfolio(spark, sf):
    c = ["total", "gross_property", "retained_bi", "bi_gross", "premium", "indirect"]
    return rounded(tcor.portfolio_tcor(Model(spark, sf).total()).select("scenario", *c), {x: 0 for x in c})


_fr = "least(greatest(frequent,0),retained_property)"
_comp = [("prop", f"retained_property-{_fr}"), ("freq", _fr), ("bi", "retained_bi"), ("prem", "premium"), ("admin", "mitigation")]


@register("tcor_components_long", query(" UNION ALL ".join(f"SELECT scenario, 'tcor_component' AS metric, '{k}' AS component, {rnd(f'sum({e})', 0)} AS value_usd FROM tc GROUP BY 1" for k, e in _comp)
                                        + f" UNION ALL SELECT scenario, 'tcor_total', 'total', {rnd(f'sum{_t}', 0)} FROM tc GROUP BY 1", X))
def tcor_components_long(spark, sf):
    from perilframe.sources.sinks import component_breakdown
    return rounded(component_breakdown(Model(spark, sf).total()).where(F.col("metric").isin("tcor_component", "tcor_total")).drop("basis"), {"value_usd": 0})


@register("tcor_markers", query(f"""
SELECT group_key, {rnd("sum(CASE WHEN scenario='present' THEN t END)", 0)} AS present, {rnd("sum(CASE WHEN scenario='ssp245_2050' THEN t END)", 0)} AS ssp245_2050 FROM (SELECT *, {_t} AS t, {_gk} AS group_key FROM tc) GROUP BY 1""", X))
def tcor_markers(spark, sf):
    key = profile.site_group_key(F.col("site_id"), F.col("latitude"), F.col("longitude"))
    return rounded(tcor.marker_totals(Model(spark, sf).total(), key, S2), {"present": 0, "ssp245_2050": 0})


# --- claims -----------------------------------------------------------------------------------

_cn = lambda k: f"'Customer#'||lpad(CAST({k} AS VARCHAR),9,'0')"
C = {"clm": f"""
SELECT event_id, CAST(ts AS DATE) AS day, CAST(year(ts) AS INTEGER) AS year, CASE WHEN user_id%13=0 THEN 'Mystery Villas' WHEN user_id%13=1 THEN {_cn('user_id*10')}||' Annex Tower' ELSE {_cn('user_id*10')} END AS claimant,
 CASE event_type WHEN 'signup' THEN 'Named Storm - Wind' WHEN 'error' THEN 'Flood' WHEN 'click' THEN 'Business Interruption' WHEN 'view' THEN 'Fire' WHEN 'purchase' THEN 'Crime' END AS coverage,
 value*100+CASE WHEN event_id%5=0 THEN value*50 ELSE 0 END AS inc, event_id%5=0 AS open, event_id%97=0 AS zeta FROM events""",
     "clx": f"""
SELECT c.*, s.site_key, CASE WHEN user_is<>'' THEN 1 END AS dummy,
 CASE coverage WHEN 'Named Storm - Wind' THEN 'hurricane' WHEN 'Flood' THEN 'flood' WHEN 'Business Interruption' THEN 'bi' WHEN 'Fire' THEN 'general' END AS cls FROM (SELECT *, claimant AS user_is FROM clm) c
LEFT JOIN (SELECT c_custkey AS site_key, c_name FROM customer) s ON s.c_name=replace(c.claimant,' Annex Tower','')""",
     "cle": """
SELECT *, CASE WHEN zeta THEN 'storm:zeta:'||year ELSE 'ev:'||k||':'||CAST(max(CASE WHEN nw=1 THEN day END) OVER (PARTITION BY zeta, k ORDER BY day, event_id ROWS UNBOUNDED PRECEDING) AS VARCHAR) END AS event_key FROM
(SELECT *, CASE WHEN date_diff('day', lag(day) OVER (PARTITION BY zeta, k ORDER BY day, event_id), day)<=3 THEN 0 ELSE 1 END AS nw FROM (SELECT *, coalesce(cls,'unmapped') AS k FROM clx))"""}


def claim_rows(spark, sf):
    return cl.classified(S.claims(spark, sf), S.sites(spark, sf))


@register("claims_events", query(f"SELECT event_key, zeta AS named, count(*) AS claims, count(DISTINCT site_key) AS sites, {rnd('sum(inc)', 2)} AS incurred, min(year) AS year FROM cle GROUP BY 1,2", C))
def claims_events(spark, sf):
    return rounded(cl.occurrence_summary(cl.occurrences(claim_rows(spark, sf))), {"incurred": 2})


_ok = "site_key IS NOT NULL AND cls IS NOT NULL"


@register("claims_aggregates", query(f"""
SELECT cut, name, count(*) AS claims, {rnd('sum(inc)', 1)} AS incurred FROM (
 SELECT 'site' AS cut, CAST(site_key AS VARCHAR) AS name, inc FROM clx WHERE {_ok} UNION ALL SELECT 'class', cls, inc FROM clx WHERE {_ok} UNION ALL SELECT 'year', CAST(year AS VARCHAR), inc FROM clx WHERE {_ok}
 UNION ALL SELECT 'unmatched', claimant, inc FROM clx WHERE site_key IS NULL UNION ALL SELECT 'unmapped', coverage, inc FROM clx WHERE cls IS NULL
 UNION ALL SELECT 'open', 'open', inc FROM clx WHERE open UNION ALL SELECT 'matched', 'matched', inc FROM clx WHERE {_ok} UNION ALL SELECT 'total', 'total', inc FROM clx) GROUP BY 1,2""", C))
def claims_aggregates(spark, sf):
    return rounded(cl.aggregates(claim_rows(spark, sf)), {"incurred": 1})


@register("claims_calibration", query(f"""
SELECT m.cls, {rnd('m.v', 0)} AS modelled_annual, {rnd('coalesce(a.inc,0)/y', 0)} AS actual_annual, {rnd('m.v/(a.inc/y)', 4)} AS ratio,
 CASE WHEN m.v/(a.inc/y)>2 THEN 'above_actuals' WHEN m.v/(a.inc/y)<0.5 THEN 'below_actuals' END AS bias FROM
(SELECT 'hurricane' AS cls, sum(retained_hurricane) AS v FROM prop WHERE scenario='present' UNION ALL SELECT 'flood', sum(retained_flood) FROM prop WHERE scenario='present' UNION ALL SELECT 'general', sum(retained_general) FROM prop WHERE scenario='present'
 UNION ALL SELECT 'bi', sum(waiting+overage) FROM bis WHERE scenario='present') m
LEFT JOIN (SELECT cls, sum(inc) AS inc FROM clx WHERE site_key IS NOT NULL AND (cls IN ('hurricane','bi') OR NOT zeta) GROUP BY 1) a ON a.cls=m.cls, (SELECT max(year)-min(year)+1 AS y FROM clm)""", {**X, **C}))
def claims_calibration(spark, sf):
    m = Model(spark, sf)
    tot = tcor.class_totals(m.prop.where("scenario = 'present'")).select("cls", F.col("annual_retained").alias("modelled_annual"))
    inter = m.interruption().where("scenario = 'present'").agg(F.sum("bi_retained").alias("modelled_annual")).select(F.lit("bi").alias("cls"), "modelled_annual")
    rows = cl.occurrences(claim_rows(spark, sf))
    return rounded(cl.calibration(rows, tot.unionByName(inter)), {"modelled_annual": 0, "actual_annual": 0, "ratio": 4})


@register("site_match_tiers", query("""
SELECT DISTINCT claimant, site_key, CASE WHEN site_key IS NULL THEN NULL WHEN claimant LIKE '%Annex Tower' THEN 3 ELSE 2 END AS tier FROM clx""", C))
def site_match_tiers(spark, sf):
    return matching.match_names(S.claims(spark, sf), S.sites(spark, sf), "claimant")


_ead_now = "(SELECT site_key, ead FROM sc WHERE scenario='present')"
_obs = f"SELECT c_name AS observed_name, c_custkey AS site_key, (c_acctbal+1000)*20 AS observed FROM customer"


@register("backtest_pairs", query(f"SELECT o.observed_name, o.site_key, {rnd('e.ead', 2)} AS modelled, {rnd('o.observed', 2)} AS observed, {rnd('CASE WHEN e.ead>0 THEN o.observed/e.ead END', 5)} AS ratio FROM ({_obs}) o JOIN {_ead_now} e USING (site_key)", X2))
def backtest_pairs(spark, sf):
    now = scored(spark, sf).where("scenario = 'present'")
    return rounded(cl.backtest(now, S.sites(spark, sf), S.observed(spark, sf)), {"modelled": 2, "observed": 2, "ratio": 5})


@register("backtest_bias", query(f"SELECT count(*) AS rows, count(*) AS matched, {rnd('sum(e.ead)', 0)} AS modelled, {rnd('sum(o.observed)', 0)} AS observed, {rnd('sum(o.observed)/sum(e.ead)', 6)} AS bias FROM ({_obs}) o JOIN {_ead_now} e USING (site_key)", X2))
def backtest_bias(spark, sf):
    now = scored(spark, sf).where("scenario = 'present'")
    df = cl.backtest_bias(cl.backtest(now, S.sites(spark, sf), S.observed(spark, sf))).drop("consistent")
    return rounded(df, {"modelled": 0, "observed": 0, "bias": 6})


_sov = {"sv": f"""
SELECT s_suppkey AS row_no, s_suppkey*3 AS ck, CASE WHEN s_suppkey%17=0 THEN 'P'||(s_suppkey*3//8) END AS sid, (s_acctbal+1000)*12000 AS tiv, 'S'||s_nationkey AS campus, s_suppkey%4=0 AS ts,
 CASE s_suppkey%3 WHEN 0 THEN 'masonry' WHEN 1 THEN 'engineered' END AS con, CASE WHEN s_suppkey%2=0 THEN {d(50000.)} END AS prem FROM supplier""",
        "svm": "SELECT v.*, coalesce(i.site_key, c.site_key) AS site_key FROM sv v LEFT JOIN (SELECT site_id, min(site_key) AS site_key FROM sites GROUP BY 1) i ON i.site_id=v.sid LEFT JOIN (SELECT site_key FROM sites) c ON c.site_key=v.ck",
        "svf": """SELECT site_key, arg_max(tiv, row_no) AS tiv, arg_max(campus, row_no) AS campus, arg_max(prem, row_no) FILTER (WHERE prem IS NOT NULL) AS prem, max(CASE WHEN ts THEN 1 END) AS ts,
 arg_min(con, row_no) FILTER (WHERE con IS NOT NULL) AS con, count(*) AS n FROM svm WHERE site_key IS NOT NULL GROUP BY 1"""}


@register("sov_apply", query(f"""
SELECT s.site_key, {rnd('coalesce(f.tiv, s.asset_value_usd)', 2)} AS asset_value_usd, coalesce(f.campus, s.campus_code) AS campus_code, {rnd('coalesce(f.prem, s.premium_annual_usd)', 2)} AS premium_annual_usd,
 coalesce(s.timeshare_share, f.ts) AS timeshare_share, coalesce(s.construction, f.con) AS construction, coalesce(f.n,0) AS schedule_rows FROM sites s LEFT JOIN svf f USING (site_key)""".replace("coalesce(s.timeshare_share, f.ts)", "CAST(coalesce(s.timeshare_share, f.ts) AS DOUBLE)"), _sov))
def sov_apply(spark, sf):
    df = matching.apply_schedule(S.sites(spark, sf), S.sov(spark, sf))
    return df.select("site_key", r("asset_value_usd").alias("asset_value_usd"), "campus_code", r("premium_annual_usd").alias("premium_annual_usd"),
                     "timeshare_share", "construction", F.coalesce("schedule_rows", F.lit(0)).alias("schedule_rows"))


@register("enrich_fill", query("""
SELECT site_key, 'construction' AS field, 'masonry' AS value, CASE WHEN construction IS NULL THEN 'filled' ELSE 'kept' END AS action, construction IS NULL AS needs_review FROM sites
UNION ALL SELECT site_key, 'opening_protection', 'partial', CASE WHEN coalesce(opening_protection,'none')='none' THEN 'filled' ELSE 'kept' END, coalesce(opening_protection,'none')='none' FROM sites"""))
def enrich_fill(spark, sf):
    s = S.sites(spark, sf)
    found = s.select("site_key", F.lit("masonry").alias("construction"), F.lit("partial").alias("opening_protection"))
    _, prov = matching.fill_blanks(s, found, ["construction", "opening_protection"], "survey")
    return prov.drop("source")
