"""Accept/reject gates. Each returns findings: check, hazard or scenario, severity, value.

The artifact is scanned once into statistics per layer (at most hazards x scenarios rows); every
rule then reads those statistics.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import assumptions as A
from ..functions.common import by_shuffle, share
from .spatial import nearest

V = A.V_COLS
_INDICATOR = ["heat", "wfire"]


def coverage_pivot(grid: DataFrame) -> DataFrame:
    """Rows per scenario and hazard; absent layers read 0."""
    return grid.groupBy("scenario").pivot("hazard", A.HAZARDS).count().fillna(0)


def monotone_break(cols: list[str], tolerance: float = 0.011) -> Column:
    """True when a return-period vector decreases with rarity."""
    return reduce(lambda a, b: a | b, [F.col(y) - F.col(x) < -tolerance for x, y in zip(cols, cols[1:])])


def grid_stats(grid: DataFrame) -> DataFrame:
    """One pass: the figures every grid rule needs, per hazard and scenario."""
    nums = ["lat", "lon", *V]
    bad = reduce(lambda a, b: a | b, [F.col(c).isNull() | F.isnan(c) for c in nums])
    off = ~(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180))
    neg = reduce(lambda a, b: a | b, [F.col(c) < 0.0 for c in V])
    signal = F.when(F.col("hazard") == "heat", F.col("v25")).when(F.col("hazard") == "wfire", F.col("v10")).otherwise(F.col("v100"))
    return grid.groupBy("hazard", "scenario").agg(
        F.count("*").alias("n"), F.count_if(bad).alias("null_rows"), F.count_if(off).alias("off_map"),
        F.count_if(neg).alias("negative"), F.count_if(monotone_break(V)).alias("decreasing"),
        F.sum(signal).alias("signal_sum"), F.max(F.greatest(*V)).alias("max_v"), F.count_if(F.col("v100") > 0.0).alias("wet"),
        F.max("v10").alias("max10"), F.max("v25").alias("max25"), F.max("v50").alias("max50"),
        F.count_if(F.col("v25") > F.col("v10") + 0.11).alias("danger_over_hot"),
        F.count_if(F.greatest(*V[3:]) != 0.0).alias("tail_used"), F.count_if(F.col("v10") > 2.0).alias("over2"))


Rule = tuple[DataFrame, Column]  # a table and the finding of each of its rows, null where the rule holds


def _rule(df: DataFrame, check: str, severity: str | Column, when: Column, value: Column, hazard: Column | None = None,
          scenario: Column | None = None) -> Rule:
    sev = F.lit(severity) if isinstance(severity, str) else severity
    return df, F.when(when, F.struct(F.lit(check).alias("check"), (hazard if hazard is not None else F.lit("all")).alias("hazard"),
                                     (scenario if scenario is not None else F.lit("all")).alias("scenario"), sev.alias("severity"),
                                     value.cast("double").alias("value")))


def _found(rules: list[Rule]) -> DataFrame:
    """Findings of the rules; those on one table share one pass over it."""
    tables = {id(df): df for df, _ in rules}
    frames = [df.select(F.explode(F.array_compact(F.array(*[x for of, x in rules if of is df]))).alias("_f")).select("_f.*")
              for df in tables.values()]
    return reduce(lambda a, b: a.unionByName(b), frames)


def _finding(*rule) -> DataFrame:
    return _found([_rule(*rule)])


def grid_findings(stats: DataFrame) -> DataFrame:
    """Schema, coverage, monotonicity, climate signal and per-peril sanity rules."""
    c, hz, sc = F.col, F.col("hazard"), F.col("scenario")
    out = [_rule(stats, "null_values", "fail", c("null_rows") > 0, c("null_rows"), hz, sc),
           _rule(stats, "coordinates", "fail", c("off_map") > 0, c("off_map"), hz, sc),
           _rule(stats, "negative", "fail", c("negative") > 0, c("negative"), hz, sc),
           _rule(stats, "unknown_scenario", "fail", ~sc.isin(A.SCENARIOS), c("n"), hz, sc)]
    whole = stats.agg(F.sum("n").alias("n"), F.count_if(sc != "present").alias("future"))
    out.append(_rule(whole, "empty_grid", "fail", F.coalesce(c("n"), F.lit(0)) == 0, F.coalesce(c("n"), F.lit(0))))
    out.append(_rule(whole, "present_only", "fail", (c("n") > 0) & (c("future") == 0), c("n")))
    per = stats.groupBy("hazard").agg(
        F.count_if(sc.isin(A.SCENARIOS)).alias("have"), F.sum("n").alias("n"), F.sum("wet").alias("wet"), F.max("max_v").alias("max_v"),
        F.sum(F.when(sc == "present", c("signal_sum") / c("n"))).alias("now"),
        F.sum(F.when(sc == "ssp585_2080", c("signal_sum") / c("n"))).alias("late"),
        *[F.max(m).alias(m) for m in ("max10", "max25", "max50")], *[F.sum(m).alias(m) for m in ("danger_over_hot", "tail_used")],
        F.sum(F.when(sc == "present", c("over2"))).alias("over2"), F.sum(F.when(sc == "present", c("n"))).alias("n_now"),
        F.max(F.when(sc == "present", c("max10"))).alias("max10_now"))
    out.append(_rule(per, "missing_scenarios", "warn", c("have") < len(A.SCENARIOS), F.lit(len(A.SCENARIOS)) - c("have"), hz))
    mono = stats.where(~hz.isin(_INDICATOR)).agg(F.sum("decreasing").alias("d"), F.sum("n").alias("n"))
    pct = c("d") / c("n") * 100.0
    out.append(_rule(mono, "monotone", F.when(pct >= 1.0, "fail").otherwise("warn"), c("d") > 0, pct))
    out.append(_rule(per, "climate_signal", "warn", c("late") < c("now") * 0.98, c("late") / c("now"), hz))
    for h, cap in (("cflood", 15.0), ("rflood", 20.0)):
        w = per.where(hz == h)
        wet = c("wet") / c("n") * 100.0
        out += [_rule(w, "depth_cap", "warn", c("max_v") > cap, c("max_v"), hz), _rule(w, "no_wet_cells", "fail", c("wet") == 0, c("wet"), hz),
                _rule(w, "mostly_wet", "warn", wet > 60.0, wet, hz)]
    tc = stats.where(hz == "tc").select("scenario", c("n").alias("tc_n"))
    water = stats.where(hz.isin("cflood", "rflood")).join(F.broadcast(tc), "scenario")
    out.append(_rule(water, "dry_zeros_missing", "warn", c("n") < c("tc_n") * 0.9, c("n") / c("tc_n"), hz, sc))
    heat, fire, rain = (per.where(hz == h) for h in ("heat", "wfire", "prain"))
    out += [_rule(heat, "heat_days", "fail", F.greatest("max10", "max25") > 366.0, F.greatest("max10", "max25"), hz),
            _rule(heat, "heat_thresholds", "fail", c("danger_over_hot") > 0, c("danger_over_hot"), hz),
            _rule(heat, "heat_encoding", "warn", c("tail_used") > 0, c("tail_used"), hz),
            _rule(heat, "cooling_degree_days", "warn", c("max50") > 6500.0, c("max50"), hz),
            _rule(fire, "fire_percent", "fail", F.greatest("max10", "max25") > 100.0, F.greatest("max10", "max25"), hz),
            _rule(fire, "fire_high", "warn", F.coalesce("max10_now", "max10") > 5.0, F.coalesce("max10_now", "max10"), hz),
            _rule(fire, "fire_broad", "warn", c("over2") / c("n_now") * 100.0 > 20.0, c("over2") / c("n_now") * 100.0, hz),
            _rule(rain, "rain_high", "warn", c("max_v") > 2500.0, c("max_v"), hz),
            _rule(rain, "rain_absent", "fail", c("max_v") <= 0.0, c("max_v"), hz)]
    return _found(out)


def provenance_findings(claimed: DataFrame, actual: DataFrame) -> DataFrame:
    """Layers a sidecar claims but the artifact lacks (fail), and layers it keeps silent about (warn)."""
    k = ["hazard", "scenario"]
    a, b = actual.select(*k).distinct(), claimed.select(*k).distinct()
    one = F.lit(1)
    ghost = _finding(b.join(a, k, "left_anti"), "ghost_layer", "fail", F.lit(True), one, F.col("hazard"), F.col("scenario"))
    silent = _finding(a.join(b, k, "left_anti"), "silent_layer", "warn", F.lit(True), one, F.col("hazard"), F.col("scenario"))
    return ghost.unionByName(silent)


def track_findings(sources: DataFrame, column: str = "nb_synth_tracks") -> DataFrame:
    """Synthetic tracks below 50 under-resolve the rare tail."""
    t = sources.agg(F.max(F.coalesce(F.col(column).try_cast("int"), F.when(F.col(column).isNotNull(), 0))).alias("t"))
    return _finding(t, "track_resolution", "warn", F.col("t") < 50, F.col("t"))


def coverage_audit(sites: DataFrame, grid: DataFrame, max_km: float = A.SNAP_KM, deg: float = A.GRID_DEG) -> DataFrame:
    """Sites beyond the snap limit of each hazard, with the distance to the nearest cell."""
    cells = grid.select("hazard", "lat", "lon").distinct().withColumn("centroid_id", F.struct("lat", "lon"))
    points = sites.select("site_key", "name", "latitude", "longitude",
                          F.explode(F.expr(A.sql_literal(A.HAZARDS))).alias("hazard"))
    near = nearest(points, cells, by=("hazard",), max_km=max_km, deg=deg, distance_beyond=True)
    return near.where(~F.col("covered") & F.col("dist_km").isNotNull()).select("hazard", "site_key", "name", "dist_km")


def audit_summary(outside: DataFrame, listed: int = 15) -> DataFrame:
    """Outside count per hazard, with the first sites listed and the rest counted."""
    from .finance import top_per
    n = outside.groupBy("hazard").agg(F.count("*").alias("outside"))
    first = top_per(outside, ["hazard"], [F.col("site_key")], listed).groupBy("hazard").agg(
        F.array_sort(F.collect_list("name")).alias("listed"))  # at most `listed` names per hazard
    return n.join(first, "hazard").withColumn("more", F.greatest(F.col("outside") - listed, F.lit(0)))


def rel_close(a: Column, b: Column, tol: float = 0.015) -> Column:
    return F.abs(a - b) <= F.greatest(F.abs(a), F.abs(b), F.lit(1.0)) * tol


def ladder_break(column: str = "ladder", tolerance: float = 0.01) -> Column:
    """Malformed array ladder: wrong size, negative, not a number, or decreasing with rarity."""
    arr = F.col(column)
    bad = F.exists(arr, lambda x: x.isNull() | F.isnan(x) | (x < 0.0))
    pairs = F.zip_with(F.slice(arr, 1, F.size(arr) - 1), F.slice(arr, 2, F.size(arr) - 1), lambda a, b: a > b + tolerance)
    return bad | F.exists(pairs, lambda x: x)


def pack_findings(portfolio: DataFrame, site_sums: DataFrame, curves: DataFrame) -> DataFrame:
    """Scenario keys, exceedance curves, reconciliation, wildfire share and climate signal.

    portfolio: scenario, direct_aal and one column per peril. site_sums: scenario, site_sum.
    curves: scenario, ladder.
    """
    sc, c = F.col("scenario"), F.col
    perils = reduce(lambda a, b: a + b, [F.col(p) for p in A.ACUTE])
    p = portfolio.join(F.broadcast(site_sums), "scenario", "left")
    out = [_rule(portfolio, "unknown_scenario", "fail", ~sc.isin(A.SCENARIOS), F.lit(1), None, sc),
           _rule(portfolio.agg(F.count("*").alias("n"), F.count_if(sc.isin(A.SCENARIOS)).alias("k"), F.count_if(sc == "present").alias("now")),
                    "scenarios", F.when((c("n") == 0) | ((c("n") == 1) & (c("now") == 1)), "fail").otherwise("warn"), c("k") < len(A.SCENARIOS), c("k")),
           _rule(curves, "curve_incomplete", "fail", F.size("ladder") != len(A.RETURN_PERIODS), F.size("ladder"), None, sc),
           _rule(curves, "curve_order", "fail", ladder_break(), F.lit(1), None, sc),
           _rule(p, "site_reconciliation", "fail", ~F.coalesce(rel_close(c("direct_aal"), c("site_sum")), F.lit(False)), c("site_sum"), None, sc),
           _rule(p, "peril_reconciliation", "fail", ~rel_close(c("direct_aal"), perils), perils, None, sc),
           _rule(portfolio.where(sc == "present"), "wildfire_share", "warn", share(c("wfire"), perils) > 0.25, share(c("wfire"), perils), None, sc)]
    now = portfolio.agg(F.sum(F.when(sc == "present", c("direct_aal"))).alias("now"), F.sum(F.when(sc == "ssp585_2080", c("direct_aal"))).alias("late"))
    out.append(_rule(now, "climate_signal", "warn", c("late") < c("now") * 0.98, c("late") / c("now")))
    return _found(out)


def site_loss_findings(losses: DataFrame) -> DataFrame:
    """Per-site 1-in-100 and 1-in-250 losses must be finite, non-negative and ordered."""
    a, b = F.col("loss_rp100"), F.col("loss_rp250")
    bad = (a < 0.0) | (b < 0.0) | F.isnan(a) | F.isnan(b) | (b < a - 0.01)
    s = losses.groupBy("scenario").agg(F.count_if(bad).alias("n"))
    return _finding(s, "site_return_losses", "fail", F.col("n") > 0, F.col("n"), None, F.col("scenario"))


def adaptation_findings(rows: DataFrame) -> DataFrame:
    """Averted never negative, cost positive, BCR equal to benefit over cost."""
    c, m = F.col, F.col("measure")
    return _found([_rule(rows, "negative_averted", "fail", c("averted") < 0.0, c("averted"), m),
                   _rule(rows, "no_cost", "warn", c("cost") <= 0.0, c("cost"), m),
                   _rule(rows, "bcr", "fail", (c("cost") > 0.0) & ~rel_close(c("bcr"), c("benefit") / c("cost"), 0.02), c("bcr"), m)])


def band_findings(rows: DataFrame) -> DataFrame:
    """Uncertainty quantiles in order, the central estimate near the band."""
    c, sc = F.col, F.col("scenario")
    order = (c("p5") <= c("p50")) & (c("p50") <= c("p95"))
    near = (c("p5") * 0.99 <= c("central")) & (c("central") <= c("p95") * 1.01)
    return _found([_rule(rows, "quantile_order", "fail", ~order, c("p50"), F.col("metric"), sc),
                   _rule(rows, "central_outside", "warn", ~near, c("central"), F.col("metric"), sc)])


def calibration_findings(row: DataFrame) -> DataFrame:
    c = F.col
    return _found([_rule(row, "v_half_bounds", "fail", ~c("fitted_v_half").between(A.V_HALF_LO, A.V_HALF_HI), c("fitted_v_half")),
                   _rule(row, "clipped", "warn", c("clipped"), c("fitted_v_half")),
                   _rule(row, "bias", "warn", ~c("bias").between(0.5, 2.0), c("bias"))])


def plan_findings(plan: DataFrame, budget: float | None = None, by: str = "portfolio") -> DataFrame:
    """Capital plans: BCRs present, funded rows ordered, deferred rows last, yearly spend in budget, each portfolio by itself.

    plan: portfolio, position (1, 2, ... in it), bcr, cost, averted, annuity_years, year (null = deferred), synergy. A row is
    compared with the one at the position before by a join, so that no task holds a portfolio. The portfolio of a
    finding stands in its scenario column.
    """
    c = F.col
    before = plan.select(by, (c("position") + 1).alias("position"), c("bcr").alias("_prev"), c("year").alias("_prev_year"), F.lit(True).alias("_has"))
    rows = plan.join(before, [by, "position"], "left").withColumn("_first", c("_has").isNull())
    factor = (F.lit(1.0) - F.pow(F.lit(1.0 + A.DISCOUNT_RATE), -c("annuity_years"))) / A.DISCOUNT_RATE
    want = c("averted") * factor / c("cost")
    close = F.when(c("synergy"), rel_close(c("bcr"), want, 0.25)).otherwise(rel_close(c("bcr"), want, 0.02))
    out = [_rule(plan, "plan_bcr", "fail", c("bcr").isNull() | (c("bcr") < 0.0), c("position"), None, c(by)),
           _rule(rows, "plan_order", "fail", c("year").isNotNull() & (c("bcr") > c("_prev")) & c("_prev_year").isNotNull(), c("position"), None, c(by)),
           _rule(rows, "deferred_last", "fail", c("year").isNotNull() & c("_prev_year").isNull() & ~c("_first"), c("position"), None, c(by)),
           _rule(plan, "plan_bcr_value", "fail", (c("cost") > 0.0) & ~close, c("position"), None, c(by))]
    if budget:
        year = plan.where(c("year").isNotNull()).groupBy(by, "year").agg(F.sum("cost").alias("s"))
        out.append(_rule(year, "plan_budget", "fail", c("s") > budget * 1.001, c("s"), None, c(by)))
    return _found(out)


def event_findings(events: DataFrame, parts: DataFrame, sites: DataFrame, joint_aal: DataFrame, floor: float = A.EVENT_FLOOR_USD) -> DataFrame:
    """Event sets: positive frequency, known sites, floor, unique pairs, weights and reconciliation.

    parts: scenario, country, source, weight, aal_usd, kept_aal_usd. joint_aal: scenario, joint.
    """
    c, sc = F.col, F.col("scenario")
    known = sites.select("site_key").distinct().withColumn("_known", F.lit(True))
    pair = (events.join(by_shuffle(known), "site_key", "left").groupBy("scenario", "country", "source", "event_id", "site_key")
            .agg(F.count("*").alias("n"), F.count_if(~(c("freq") > 0.0)).alias("f"), F.count_if(c("_known").isNull()).alias("lost"),
                 F.count_if((c("loss_usd") < floor - 0.01) | F.isnan("loss_usd")).alias("l")))
    rows = pair.groupBy("scenario").agg(*[F.sum(x).alias(x) for x in ("f", "l", "lost")], F.count_if(c("n") > 1).alias("dup"))
    names = (events.select("scenario", "source", "event", "event_id").distinct().groupBy("scenario", "source", "event")
             .agg(F.count("*").alias("n")).where(c("n") > 1).groupBy("scenario").agg(F.count("*").alias("n")))
    w = parts.groupBy("scenario", "country").agg(F.sum("weight").alias("w"))
    t = parts.groupBy("scenario").agg(F.sum(c("weight") * c("aal_usd")).alias("a"), F.sum(c("weight") * c("kept_aal_usd")).alias("k"))
    t = t.join(F.broadcast(joint_aal), "scenario")
    dropped = (c("a") - c("k")) / c("a")
    return _found([
        _rule(rows, "event_frequency", "fail", c("f") > 0, c("f"), None, sc), _rule(rows, "event_floor", "fail", c("l") > 0, c("l"), None, sc),
        _rule(rows, "event_site", "fail", c("lost") > 0, c("lost"), None, sc), _rule(rows, "event_duplicate", "fail", c("dup") > 0, c("dup"), None, sc),
        _rule(names, "event_name", "fail", c("n") > 0, c("n"), None, sc),
        _rule(w, "event_weights", "fail", F.abs(c("w") - 1.0) > 0.01, c("w"), c("country"), sc),
        _rule(t, "event_aal", "fail", (c("a") > 0.0) & ~rel_close(c("a"), c("joint"), 0.02), c("a"), None, sc),
        _rule(t, "floor_dropped", F.when(dropped > 0.10, "fail").otherwise("warn"), (c("a") > 0.0) & (dropped > 0.02), dropped, None, sc)])


def ladder_findings(ladders: DataFrame, n_sites: DataFrame | None = None) -> DataFrame:
    """Ladders per scenario and peril: malformed rows, and rows missing against the portfolio size."""
    c, sc = F.col, F.col("scenario")
    wrong = (F.size("ladder") != len(A.LADDER_RPS)) | ladder_break()
    s = ladders.groupBy("scenario", "peril").agg(F.count("*").alias("n"), F.count_if(wrong).alias("bad"))
    out = [_rule(s, "ladder_shape", "fail", c("bad") > 0, c("bad"), c("peril"), sc)]
    if n_sites is not None:
        k = s.withColumn("_k", F.lit(1)).join(F.broadcast(n_sites.withColumn("_k", F.lit(1))), "_k")
        out.append(_rule(k, "ladder_rows", "fail", c("n") != c("sites"), c("n"), c("peril"), sc))
    return _found(out)


def registry_findings(table: DataFrame) -> DataFrame:
    """Every registry value equals (central + margin) * factor at its own precision."""
    c = F.col
    want = F.when(c("kind") == "sea_level", F.round((c("central") + c("margin")) * c("factor"), 2)).otherwise(c("central") + c("margin"))
    return _finding(table, "registry_value", "fail", F.abs(want - c("value")) > 0.0051, c("value"), c("region"), c("scenario"))


def verdict(findings: DataFrame) -> DataFrame:
    """One row: failures, warnings and whether the artifact ships."""
    return findings.agg(F.count_if(F.col("severity") == "fail").alias("failures"), F.count_if(F.col("severity") == "warn").alias("warnings"),
                        (F.count_if(F.col("severity") == "fail") == 0).alias("shippable"))
