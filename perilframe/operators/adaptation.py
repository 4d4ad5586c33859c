"""Measures, appraisal, sensitivity and action queues on scored sites.

A measure is a row of knobs. Sites meet the six measures by exploding one constant array in the
row they already occupy, so appraisal adds no join and no shuffle before its own aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import assumptions as A
from ..functions.common import share, total
from ..functions.curves import annuity
from . import budget as budget_ops
from . import finance as fin_ops
from .scoring import NEUTRAL, annual_fractions, peril_fractions

# Measure settings at their defaults.
# key, name, target, knobs, cost as percent of value, cost per site, enabled
MEASURES = [
    ("wind", "Wind hardening (roofs & openings)", "Wind damage + its BI", {"k_tc": 0.65}, 1.0, 0.0, True),
    ("flood", "Dry floodproofing & utility elevation", "Flood damage + its BI", {"k_fb": 0.5}, 0.6, 0.0, True),
    ("buffer", "Coastal buffer (dune & mangrove)", "Coastal-flood depth", {"k_red": 0.3}, 0.4, 0.0, False),
    ("ops", "Resilient operations (backup power, rapid reopen)", "Business interruption", {"k_reopen": 0.7}, 0.0, 300000.0, True),
    ("cool", "Cooling & shading retrofit", "Heat revenue at risk", {"k_heat": 0.6}, 0.5, 0.0, False),
    ("fire", "Wildfire hardening (defensible space & Class A roof)", "Wildfire damage + its BI", {"k_fire": 0.6}, 0.6, 0.0, False),
]
# One-at-a-time sensitivity factors (low knob, high knob).
FACTORS = [
    ("haz", "Hazard intensity", {"k_haz": 0.92}, {"k_haz": 1.08}),
    ("dmg", "Damage-curve steepness", {"k_dmg": 0.70}, {"k_dmg": 1.40}),
    ("exp", "Asset values", {"k_exp": 0.85}, {"k_exp": 1.15}),
    ("rev", "Revenue basis", {"k_rev": 0.80}, {"k_rev": 1.20}),
    ("reopen", "Reopen time", {"k_reopen": 0.75}, {"k_reopen": 1.50}),
]
DEFAULT_ANNUITY = annuity(A.HORIZON_YEARS, A.DISCOUNT_RATE)


def in_scope(measure: Column) -> Column:
    """Which sites a measure can act on, and is costed on."""
    coastal = F.col("ead_cflood") > A.SCOPE_USD
    flood = (F.col("ead_cflood") + F.col("ead_rflood")) > A.SCOPE_USD
    heat = F.col("heat_ind.days_over_35") > A.HEAT_COMFORT_DAYS
    return (F.when(measure == "flood", flood).when(measure == "buffer", coastal).when(measure == "cool", heat)
            .when(measure == "fire", F.col("fire_pct") > 0.0).otherwise(True))


def knob_rows(df: DataFrame, sets: list[dict], column: str = "_m") -> DataFrame:
    """Repeat each row once per knob set; missing knobs are neutral."""
    full = [{k: v for k, v in s.items() if not k.startswith("k_")} | {k: float(s.get(k, n)) for k, n in NEUTRAL.items()}
            for s in sets]
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.explode(F.expr(A.sql_literal(full))).alias(column)).select(*rest, f"{column}.*")


def adapted(df: DataFrame) -> DataFrame:
    """Add a_direct, a_bi, a_heat and a_total under the row's knob columns."""
    knobs = {k: F.col(k) for k in NEUTRAL}
    fire = peril_fractions(knobs)["wfire"]["annual"]
    df = (df.select("*", annual_fractions(knobs).alias("_g"), fire.alias("g_wfire"))
          .select("*", *[F.col(f"_g.{p}").alias(f"g_{p}") for p in A.ACUTE if p != "wfire"]).drop("_g"))
    frac = total([F.col(f"g_{p}") for p in A.ACUTE])
    gop = F.col("revenue_usd") * F.col("k_exp") * F.col("k_rev") * F.col("gop_margin")
    excess = F.greatest(F.col("heat_ind.days_over_35") - A.HEAT_COMFORT_DAYS, F.lit(0.0))
    df = df.select(
        "*", (F.col("asset_value_usd") * F.col("k_exp") * frac).alias("a_direct"),
        (gop * (F.col("reopen_months") * F.col("k_reopen") / 12.0) * frac).alias("a_bi"),
        (gop / 365.0 * excess * F.col("heat_drop") * F.col("k_heat")).alias("a_heat"))
    return df.withColumn("a_total", F.col("a_direct") + F.col("a_bi") + F.col("a_heat"))


def measure_sets() -> list[dict]:
    return [{"ordinal": i, "measure": k, "measure_name": n, "target": t, "cost_pct": float(pct), "cost_site": float(flat),
             "enabled": on} | knobs for i, (k, n, t, knobs, pct, flat, on) in enumerate(MEASURES)]


def enabled_knobs() -> dict:
    """Knobs of all enabled measures merged; their fields are disjoint."""
    merged: dict = {}
    for *_, knobs, _, _, on in MEASURES:
        if on:
            merged |= knobs
    return merged


def measure_rows(fin: DataFrame, af: float = DEFAULT_ANNUITY) -> DataFrame:
    """One row per scenario, site and in-scope measure: averted annual cost, cost and BCR."""
    rows = knob_rows(fin, measure_sets()).where(in_scope(F.col("measure")))
    cost = F.col("asset_value_usd") * F.col("cost_pct") / 100.0 + F.col("cost_site")
    out = adapted(rows).select(
        "scenario", "site_key", "name", "ordinal", "measure", "measure_name", "target", "enabled",
        (F.col("total_aal") - F.col("a_total")).alias("averted"), cost.alias("cost"))
    return out.withColumn("bcr", F.when(F.col("cost") > 0.0, F.col("averted") * af / F.col("cost")).otherwise(0.0))


def appraisal(rows: DataFrame, af: float = DEFAULT_ANNUITY) -> DataFrame:
    """Per scenario and measure: sites in scope, averted, cost, benefit and BCR."""
    out = rows.groupBy("scenario", "measure").agg(
        F.count("*").alias("sites_in_scope"), F.sum("averted").alias("averted"), F.sum("cost").alias("cost"))
    return (out.withColumn("benefit", F.col("averted") * af)
            .withColumn("bcr", F.when(F.col("cost") > 0.0, F.col("benefit") / F.col("cost")).otherwise(0.0)))


def combined_enabled(fin: DataFrame, rows: DataFrame, af: float = DEFAULT_ANNUITY) -> DataFrame:
    """The enabled measures re-evaluated jointly; their averted losses are never summed."""
    joint = adapted(knob_rows(fin, [enabled_knobs()])).groupBy("scenario").agg(
        (F.sum("total_aal") - F.sum("a_total")).alias("averted"))
    cost = rows.where("enabled").groupBy("scenario").agg(F.sum("cost").alias("cost"))
    return (joint.join(cost, "scenario", "left")
            .withColumn("bcr", F.when(F.col("cost") > 0.0, F.col("averted") * af / F.col("cost")).otherwise(0.0)))


def best_measure(rows: DataFrame) -> DataFrame:
    """Highest BCR per site, the first measure on ties."""
    pick = F.max_by(F.struct("measure", "averted", "cost", "bcr"), F.struct("bcr", -F.col("ordinal")))
    return rows.groupBy("scenario", "site_key").agg(pick.alias("_b")).select("scenario", "site_key", "_b.*")


def top_measures(rows: DataFrame, n: int = 3) -> DataFrame:
    return fin_ops.top_per(rows, ["scenario", "site_key"], [F.col("bcr").desc(), F.col("ordinal")], n)


def tolerance_breaches(fin: DataFrame, best: DataFrame) -> DataFrame:
    """Sites over the cost tolerance and the lane each goes to."""
    bps = share(F.col("total_aal"), F.col("asset_value_usd")) * 1e4
    over = fin.withColumn("bps", bps).where(F.col("bps") > A.TOLERANCE_SITE_BPS)
    out = over.join(best, ["scenario", "site_key"], "left")
    return out.select("scenario", "site_key", "name", "total_aal", "bps",
                      F.coalesce("bcr", F.lit(0.0)).alias("best_bcr"), F.col("measure").alias("best_measure"),
                      F.when(F.col("bcr") >= 1.0, "capex").otherwise("transfer").alias("lane"))


def portfolio_breaches(tailed: DataFrame) -> DataFrame:
    pct = share(F.col("total_aal"), F.col("value")) * 100.0
    tail = share(F.col("tail100"), F.col("value")) * 100.0
    return tailed.select("scenario", pct.alias("aal_pct"), tail.alias("tail_pct"), "tail_basis",
                         (pct > A.TOLERANCE_PORTFOLIO_PCT).alias("aal_breach"),
                         (tail > A.TOLERANCE_VAR_PCT).alias("tail_breach"))


def tornado(fin: DataFrame) -> DataFrame:
    """One-at-a-time swings per factor, with the root-sum-square range repeated on each row."""
    sets = [{"factor": "central", "side": "mid"}]
    for key, _, lo, hi in FACTORS:
        sets += [{"factor": key, "side": "lo"} | lo, {"factor": key, "side": "hi"} | hi]
    sums = adapted(knob_rows(fin, sets)).groupBy("scenario", "factor", "side").agg(F.sum("a_total").alias("t"))
    # eleven rows per scenario from here on; windows, so that the sums are taken once
    here = Window.partitionBy("scenario")
    rows = sums.groupBy("scenario", "factor").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    rows = rows.withColumn("central", F.max(F.when(F.col("factor") == "central", F.col("lo"))).over(here)).where("factor <> 'central'")
    sq = lambda x: F.pow(F.greatest(x, F.lit(0.0)), F.lit(2.0))
    rows = (rows.withColumn("_dn", F.sqrt(F.sum(sq(F.col("central") - F.col("lo"))).over(here)))
            .withColumn("_up", F.sqrt(F.sum(sq(F.col("hi") - F.col("central"))).over(here))))
    return rows.select("scenario", "factor", "lo", "hi", (F.col("hi") - F.col("lo")).alias("swing"), "central",
                       F.greatest(F.col("central") - F.col("_dn"), F.lit(0.0)).alias("low"),
                       (F.col("central") + F.col("_up")).alias("high"))


def waterfall(fin: DataFrame, future: str) -> DataFrame:
    """Today, growth, climate, averted and residual; the parts sum exactly."""
    years = max(int(future.split("_")[1]) - A.REFERENCE_YEAR, 1) if "_" in future else 24
    g = (1.0 + A.GROWTH_PCT / 100.0) ** years
    both = adapted(knob_rows(fin.where(F.col("scenario").isin("present", future)), [enabled_knobs()]))
    s = both.groupBy().agg(
        F.sum(F.when(F.col("scenario") == "present", F.col("total_aal"))).alias("today"),
        F.sum(F.when(F.col("scenario") == future, F.col("total_aal"))).alias("_fut"),
        F.sum(F.when(F.col("scenario") == future, F.col("a_total"))).alias("_ada"))
    return s.select("today", (F.col("today") * (g - 1.0)).alias("growth"), ((F.col("_fut") - F.col("today")) * g).alias("climate"),
                    (F.col("_fut") * g).alias("future"), ((F.col("_fut") - F.col("_ada")) * g).alias("averted"),
                    (F.col("_ada") * g).alias("residual"))


def fund_at_breakeven(rows: DataFrame) -> DataFrame:
    """Without a budget every action at or above breakeven is funded."""
    return rows.withColumn("funded", F.col("bcr") >= 1.0)


def fund_within_budget(rows: DataFrame, budget: float, key: str = "action_id", by: list[str] | None = None, alone: int = budget_ops.ALONE) -> DataFrame:
    """Greedy funding by BCR under a budget, skipping what does not fit, as one sequential pass would.

    Each group of `by` (all rows without it) has the budget for itself. Actions below breakeven are never funded and take
    no part. Equal BCRs are ordered by `key`, a unique long. Money counts in whole cents. See budget.fill for how the
    pass is spread out.
    """
    keys = by or ["_all"]
    worth = rows.where(F.col("bcr") >= 1.0).select(*([F.lit(0).alias("_all")] if not by else by), key, "bcr", budget_ops.cents(F.col("cost")).alias("cents"))
    ranked = budget_ops.in_order(worth, keys, [F.col("bcr").desc(), F.col(key).asc()])
    lines = budget_ops.fill(ranked.withColumn("wish", F.lit(None).cast("int")), keys, [round(budget * 100)], alone)
    funded = ranked.join(lines.where("line is not null"), "seq").select(*(by or []), key, F.lit(True).alias("funded"))
    return rows.join(funded, [*(by or []), key], "left").fillna(False, ["funded"])


def queue_rollup(fin: DataFrame, queue: DataFrame, af: float = DEFAULT_ANNUITY) -> DataFrame:
    """Funded programme: each site's funded measures evaluated together, never added up.

    A site has at most six measures, so its merged knobs come from a six-way conditional maximum.
    """
    picked = queue.where("funded")
    knobs = {}
    for k, _, _, kn, _, _, _ in MEASURES:
        for name, v in kn.items():
            knobs[name] = (k, v)
    merged = picked.groupBy("scenario", "site_key").agg(
        F.sum("cost").alias("_cost"), F.count("*").alias("_n"),
        *[F.coalesce(F.max(F.when(F.col("measure") == m, F.lit(v))), F.lit(NEUTRAL[name])).alias(name)
          for name, (m, v) in knobs.items()])
    rows = fin.join(merged, ["scenario", "site_key"])
    rows = rows.select("*", *[F.lit(v).alias(k) for k, v in NEUTRAL.items() if k not in knobs])
    out = adapted(rows).groupBy("scenario").agg(
        F.sum("_n").alias("n"), F.sum("_cost").alias("cost"), (F.sum("total_aal") - F.sum("a_total")).alias("averted"))
    return out.withColumn("bcr", F.when(F.col("cost") > 0.0, F.col("averted") * af / F.col("cost")).otherwise(0.0))
