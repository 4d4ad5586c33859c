"""Operators against hand-worked cases and brute force on small fixtures."""

import math
import random

import pytest
from pyspark.sql import functions as F

from perilframe import assumptions as A
from perilframe.operators import adaptation, budget, exceedance, gates, grid, keyed, losses, matching, planning, scoring, spatial, tcor
from perilframe.operators import claims as cl


def km(a, b, c, d):
    x = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(min(x, 1)))


def test_nearest_matches_brute_force(spark):
    rng = random.Random(3)
    cen = [(i, rng.uniform(-70, 70), rng.uniform(-180, 180)) for i in range(400)] + [(1000 + i, 25 + i * 0.01, 179.9) for i in range(30)]
    pts = [(i, rng.uniform(-70, 70), rng.uniform(-180, 180)) for i in range(60)] + [(900, 25.05, -179.95), (901, 25.05, -179.95)]
    out = spatial.nearest(spark.createDataFrame(pts, "site_key long, latitude double, longitude double"),
                          spark.createDataFrame(cen, "centroid_id long, lat double, lon double"), deg=0.5, max_km=800.0, distance_beyond=True).collect()
    assert len(out) == len(pts)
    for r in out:
        best = min((round(km(r.latitude, r.longitude, la, lo), 6), i) for i, la, lo in cen)
        assert r.dist_km == pytest.approx(best[0], abs=1e-5)
        assert r.centroid_id == (best[1] if best[0] <= 800 else None)


def ep(spark, rows, fn, rps):
    df = spark.createDataFrame([("a", i, float(l), f) for i, (l, f) in enumerate(rows)], "k string, event_id long, loss double, freq double")
    return fn(exceedance.loss_points(df, ["k"]), ["k"], rps=rps).first().ladder


def test_exceedance_conventions(spark):
    rows = [(100, .001), (50, .009), (10, .09)]
    lad = ep(spark, rows, exceedance.interpolated_ladder, [10, 100, 250, 500])
    assert lad[0] == pytest.approx(10) and lad[1] == pytest.approx(50) and 50 < lad[2] < lad[3] < 100
    assert ep(spark, [(10, .01), (5, .01)], exceedance.interpolated_ladder, [10, 25, 500]) == [0.0, 0.0, 10.0]
    assert ep(spark, [(10, .02), (4, .05)], exceedance.step_ladder, [100]) == [10.0]


def test_hot_key_with_ties_matches_plain_sort(spark):
    rng = random.Random(5)
    rows = [(float(rng.choice([1, 2, 2, 3, 1000])) * rng.choice([1, 1.0000001]), 0.0001 * (1 + i % 3)) for i in range(3000)]
    got = ep(spark, rows, exceedance.step_ladder, [2, 5, 10, 50])
    ordered = sorted(rows, key=lambda r: -r[0])
    for rp, g in zip([2, 5, 10, 50], got):
        cum, want = 0.0, 0.0
        for loss, f in ordered:
            cum += f
            if cum >= 1 / rp - 1e-12:
                want = loss
                break
        assert g == want


def test_value_at_rank(spark):
    df = spark.createDataFrame([(float(x),) for x in [5, -3, 0, 8, 8, -3.5]], "v double")
    for p in (0.0, 0.34, 0.5, 0.99):
        v = sorted([5, -3, 0, 8, 8, -3.5])
        assert exceedance.value_at_rank(df, [], "v", exceedance.floor_rank(p)).first().v == v[min(len(v) - 1, int(p * len(v)))]


def test_keep_and_blend(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "k string, v double")
    b = spark.createDataFrame([("y", 9.0)], "k string, v double")
    assert {r.k: r.v for r in keyed.last_wins([a, b], ["k"]).collect()} == {"x": 1.0, "y": 9.0}
    parts = spark.createDataFrame([(1, .5, 10.0), (1, .5, 30.0), (2, .5, 10.0)], "c int, weight double, v10 double")
    assert {r.c: r.v10 for r in grid.blend(parts, ["c"], values=["v10"]).collect()} == {1: 20.0, 2: 10.0}


def test_shared_deductible_worked_example(spark):
    sites = spark.createDataFrame([(i, "campus:a") for i in range(6)], "site_key long, campus string")
    ev = spark.createDataFrame([("present", "USA", "s", 1.0, 1, 1.0, i, 400000.0) for i in range(6)],
                               "scenario string, country string, source string, weight double, event_id long, freq double, site_key long, loss_usd double")
    g = tcor.event_retained(ev, sites)
    t = tcor.storm_totals(g).first()
    assert (t.annual_retained, t.annual_transferred) == (1e6, 1.4e6)
    assert sum(r.retained for r in tcor.storm_by_site(ev, g, sites).collect()) == pytest.approx(1e6)


def plain_fill(rows, budgets):
    """rows (seq, cents, wish), settled one by one."""
    left, out = dict(enumerate(budgets, 1)), {}
    for seq, cost, wish in sorted(rows):
        out[seq] = next((y for y in ([wish] if wish else []) + list(left) if cost <= left[y]), None)
        if out[seq]:
            left[out[seq]] -= cost
    return out


@pytest.mark.parametrize("alone", [0, 4096])
def test_budget_queue_equals_sequential_pass(spark, alone):
    rng = random.Random(11)
    rows = [(g, i, rng.choice([0.5, 1.5, 1.5, 2.0, rng.uniform(1, 9)]), float(rng.choice([0, 3, 50, rng.randint(1, 400)]))) for g in "ab" for i in range(150)]
    df = spark.createDataFrame(rows, "g string, action_id long, bcr double, cost double")
    got = {(r.g, r.action_id) for r in adaptation.fund_within_budget(df, 1500.0, by=["g"], alone=alone).where("funded").collect()}
    want = set()
    for g in "ab":
        left = 1500.0
        for _, i, b, c in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1])):
            if b >= 1 and c <= left:
                want.add((g, i))
                left -= c
    assert got == want
    assert adaptation.fund_within_budget(df.where("g = 'a'").drop("g"), 1500.0, alone=alone).where("funded").count() == len([w for w in want if w[0] == "a"])
    assert adaptation.fund_within_budget(df.limit(0), 1500.0, by=["g"], alone=alone).count() == 0


def test_alternating_costs_take_few_rounds(spark, monkeypatch):
    """Six costs, each larger than what is left after the one before, and six thousand rows of one group."""
    rounds = []
    monkeypatch.setattr(budget, "written", lambda df, f=budget.written: rounds.append(1) or f(df))
    money, rows, left = 1 << 6, [], 1 << 6
    for k in range(6):
        rows += [(2 * k, left, None), (2 * k + 1, left // 2 + 1, None)]
        left //= 2
    df = spark.createDataFrame([("g", *r) for r in rows], "g string, seq long, cents long, wish int")
    assert {r.seq: r.line for r in budget.fill(df, ["g"], [money], 0).collect()} == plain_fill(rows, [money])
    rng, rounds[:] = random.Random(5), []
    many = [(i, rng.choice([1, 40, rng.randint(1, 10**6)]), rng.choice([None, None, 1, 2, 3])) for i in range(6_000)]
    df = spark.createDataFrame([("g", *r) for r in many], "g string, seq long, cents long, wish int")
    budgets = [3_000_000, 10_000_000, 10_000_000]
    got = {r.seq: r.line for r in budget.fill(df, ["g"], budgets).collect()}
    assert got == plain_fill(many, budgets) and len(rounds) <= 2 * 3 * 24


@pytest.mark.parametrize("alone", [0, 4096])
def test_phases_of_three_years(spark, alone):
    rng = random.Random(3)
    rows = [(g, i, rng.choice([0, 500, 700, 999, 1000, 1001, rng.randint(1, 1200)]), rng.choice([None, None, 1, 2, 3])) for g in range(3) for i in range(60)]
    df = spark.createDataFrame([(g, 1000 * g + i, c, w) for g, i, c, w in rows], "g long, seq long, cents long, wish int")
    budgets = [2500, 1800, 0]
    got = {r.seq: r.line for r in budget.fill(df, ["g"], budgets, alone).collect()}
    assert got == {s: y for g in range(3) for s, y in plain_fill([(1000 * h + i, c, w) for h, i, c, w in rows if h == g], budgets).items()}


def test_phasing(spark):
    cols = "portfolio string, site_key long, name string, measure string, averted double, cost double, bcr double, reno_year int"
    rows = [("p", 1, "B", "m", 1.0, 800.0, 5.0, 2), ("p", 2, "A", "m", 1.0, 700.0, 4.0, None), ("p", 3, "C", "m", 1.0, 900.0, 3.0, None),
            ("p", 4, "D", "m", 1.0, 5000.0, 9.0, None), ("q", 5, "E", "m", 1.0, 900.0, 3.0, 2), ("q", 5, "E", "n", 1.0, 900.0, 2.0, 2)]
    df = spark.createDataFrame(rows, cols)
    out = {(r.name, r.measure): r for r in planning.phase(df, 1000.0).collect()}
    assert out["B", "m"].year == 2 and out["B", "m"].cost == 680.0 and out["A", "m"].year == 1 and out["C", "m"].year == 3
    assert out["D", "m"].deferred and out["D", "m"].position == 4 and out["B", "m"].position == 1 and len(out) == 6
    assert (out["E", "m"].year, out["E", "n"].year, out["E", "n"].cost, out["E", "n"].position) == (2, 1, 765.0, 2)
    free = {(r.name, r.measure): r.year for r in planning.phase(df).collect()}
    assert free["D", "m"] == 1 and free["E", "n"] == 2
    long = spark.range(100).selectExpr("'p' AS portfolio", "id AS site_key", "CAST(id AS STRING) AS name", "'m' AS measure", "1.0D AS averted", "10.0D AS cost", "5.0D AS bcr", "CAST(NULL AS INT) AS reno_year")
    assert planning.phase(long, 300.0).groupBy("year").count().orderBy("year").collect() == [(None, 10), (1, 30), (2, 30), (3, 30)]


def test_name_tiers(spark):
    sites = spark.createDataFrame([(1, "Palm Resort", None), (2, "Ocean Inn", "S2"), (3, "Grand Harbor", None)], "site_key long, name string, site_id string")
    q = spark.createDataFrame([("s2",), ("The Palm",), ("Grand Harbor East Tower",), ("Mystery",)], "claimant string")
    got = {r.claimant: (r.site_key, r.tier) for r in matching.match_names(q, sites, "claimant").collect()}
    assert got == {"s2": (2, 1), "The Palm": (1, 2), "Grand Harbor East Tower": (3, 3), "Mystery": (None, None)}


def test_containment_equals_plain_search(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 6)))
    inner = sorted({" ".join(word() for _ in range(rng.randint(1, 2))) for _ in range(150)})
    outer = sorted({" ".join(word() for _ in range(rng.randint(1, 4))) for _ in range(150)} | set(inner[:40]))
    x, y = spark.createDataFrame([(t,) for t in inner], "x string"), spark.createDataFrame([(t,) for t in outer], "y string")
    got = [(r.x, r.y) for r in matching.contained_in(x, y, "x", "y").collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in inner for b in outer if a in b}


def test_names_that_share_words_are_looked_up_by_rarer_pieces(spark):
    """Three thousand names with two words in common: few candidates for each name, and few share one piece."""
    inner = spark.range(3000).select(F.concat(F.lit("ocean palm "), F.lpad(F.hex(F.col("id") * 7919), 7, "q")).alias("x"))
    outer = inner.select(F.concat(F.col("x"), F.lit(" east tower")).alias("y"))
    probes = matching.gram_probes(inner, outer, "x", "y")
    load = probes.groupBy("_gram").agg(F.sum("_df").alias("pairs"))
    total = probes.agg(F.sum("_df")).first()[0]
    assert probes.count() == 3000 and total < 3000 * 40 and load.agg(F.max("pairs")).first()[0] < 0.05 * total
    assert matching.contained_in(inner, outer, "x", "y").count() == 3000


def test_event_set_weights_come_from_the_catalog(spark):
    joint = spark.createDataFrame([("a", "X", 0.1, 5000.0), ("b", "X", 0.1, 500.0), ("a", "Y", 0.2, 2000.0)], "source string, country string, freq double, loss double")
    weights = spark.createDataFrame([("present", "a", 0.5), ("present", "b", 0.5)], "scenario string, source string, weight double")
    places = spark.createDataFrame([("X",), ("Y",), ("Z",), ("X",)], "country string")
    got = {(r.country, r.source): (r.weight, r.aal_usd, r.kept_aal_usd) for r in losses.event_set_parts(joint, weights, places).collect()}
    assert got == {("X", "a"): (0.5, 500.0, 500.0), ("X", "b"): (0.5, 50.0, 0.0), ("Y", "a"): (0.5, 400.0, 400.0), ("Y", "b"): (0.5, 0.0, 0.0),
                   ("Z", "a"): (0.5, 0.0, 0.0), ("Z", "b"): (0.5, 0.0, 0.0)}


def plain_nearest(lat, lon, cen):
    def km(a, b, c, d):
        h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return round(2 * 6371.0 * math.asin(math.sqrt(min(h, 1.0))), 6)
    return min((km(lat, lon, a, b), i) for i, a, b in cen)


def test_nearest_at_any_distance(spark):
    """Far sites, poles, the date line, a dense cluster and a cell with a third of all sites."""
    rng = random.Random(6)
    cen = [(i, rng.uniform(-60, 60), rng.uniform(-180, 180)) for i in range(60)] + [(100 + i, 25 + rng.random() / 50, -80 + rng.random() / 50) for i in range(200)]
    cen += [(900, 89.9, 10.0), (901, -10.0, 179.99), (902, -10.0, -179.98), (903, 25.01, -79.99), (904, 0.0, 180.0)]
    points = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(150)] + [(1000 + i, 25.6 + rng.random() / 100, -80.4 + rng.random() / 100) for i in range(80)]
    points += [(2000, 90.0, 0.0), (2001, -90.0, 77.0), (2002, -10.0, 180.0), (2003, -10.0, -180.0), (2004, 0.0, 0.0), (2005, 45.0, 179.9)]
    p = spark.createDataFrame(points, "site_key long, latitude double, longitude double")
    c = spark.createDataFrame(cen, "centroid_id long, lat double, lon double")
    for deg in (0.25, 0.5):
        got = {r.site_key: r for r in spatial.nearest(p, c, deg=deg, distance_beyond=True).collect()}
        for i, lat, lon in points:
            km, at = plain_nearest(lat, lon, cen)
            assert got[i].dist_km == pytest.approx(km, abs=2e-6) and got[i].covered == (km <= 200.0), (i, deg)
            assert got[i].centroid_id == (at if km <= 200.0 else None) or abs(km - 200) < 1e-3, (i, deg)
    assert [s for s in spatial._pyramid(0.25)][0] == 360.0 and all(abs(a / b - round(a / b)) < 1e-9 for a, b in zip(spatial._pyramid(0.25), spatial._pyramid(0.25)[1:]))


def test_layers_of_the_same_cells_are_looked_up_once(spark):
    v = dict(zip(A.V_COLS, [1.0] * 6))
    rows = [{"lat": 25.0 + i, "lon": -80.0, "hazard": h, "scenario": s, **v} for i in range(4) for h in ("tc", "heat", "cflood") for s in ("present", "ssp245_2050") if h != "cflood" or i < 2]
    grid_rows = spark.createDataFrame(rows)
    sets = scoring.cell_sets(grid_rows.withColumnRenamed("scenario", "grid_scenario"))
    assert len(sets) == 6 and len(set(sets.values())) == 2 and sets["tc", "present"] == sets["heat", "ssp245_2050"] != sets["cflood", "present"]
    sites = spark.createDataFrame([(1, 28.1, -80.0), (2, 25.2, -80.1)], "site_key long, latitude double, longitude double")
    got = {(r.site_key, r.scenario): r for r in scoring.grid_lookup(sites, grid_rows, ["present", "ssp245_2050", "ssp585_2080"]).collect()}
    assert len(got) == 6 and got[1, "present"].tc.covered and got[1, "present"].cflood.covered is False if got[1, "present"].cflood else True
    assert got[2, "ssp585_2080"].cflood.covered and got[2, "present"].heat.dist_km == got[2, "ssp245_2050"].tc.dist_km


def test_claim_clusters(spark):
    rows = [("2020-01-01", "Flood", None), ("2020-01-04", "Flood", None), ("2020-01-08", "Flood", None), ("2020-01-02", "Fire", "Hurricane Zeta")]
    df = spark.createDataFrame(rows, "d string, coverage string, description string").select(
        F.col("d").cast("date").alias("date_of_loss"), F.year(F.col("d").cast("date")).alias("year"), F.lit("Palm").alias("claimant"), "coverage", "description", F.lit(1.0).alias("net_incurred"))
    sites = spark.createDataFrame([(1, "Palm", None)], "site_key long, name string, site_id string")
    got = cl.occurrence_summary(cl.occurrences(cl.classified(df, sites))).collect()
    assert sorted(r.claims for r in got) == [1, 1, 2]


def test_grid_gate_accepts_and_rejects(spark):
    row = lambda **k: {"lat": 25.0, "lon": -80.0, "hazard": "tc", "scenario": "present", **dict(zip(A.V_COLS, [10., 20., 30., 40., 50., 60.])), **k}
    good = spark.createDataFrame([row(scenario=s) for s in A.SCENARIOS])
    assert gates.verdict(gates.grid_findings(gates.grid_stats(good))).first().shippable
    bad = spark.createDataFrame([row(), row(v10=-1.0, scenario="other"), row(v500=1.0)])
    f = {r.check for r in gates.grid_findings(gates.grid_stats(bad)).where("severity = 'fail'").collect()}
    assert {"negative", "unknown_scenario", "monotone"} <= f


def test_weights_renormalise(spark):
    cat = spark.createDataFrame([("present",)], "source string")
    got = {(r.scenario, r.source): r.weight for r in losses.present_weights(A.recipe_table(spark), cat).collect()}
    assert got[("ssp126_2030", "present")] == 1.0 and ("ssp126_2080", "rcp26_2080") not in got


def test_all_known_layers(spark):
    from perilframe import assumptions as A
    from perilframe.operators.scoring import grid_layers, unknown_layers
    rows = [(h, s) for h in [*A.HAZARDS, "odd"] for s in [*A.SCENARIOS, *(f"x{i}" for i in range(100))]]
    grid = spark.createDataFrame(rows, "hazard string, scenario string")
    got = grid_layers(grid)
    assert {h: set(v) for h, v in got.items()} == {h: set(A.SCENARIOS) for h in A.HAZARDS}
    assert unknown_layers(grid).count() == len(rows) - len(A.HAZARDS) * len(A.SCENARIOS)


def test_plan_gate_reads_each_portfolio_by_itself(spark):
    cols = "portfolio string, position long, bcr double, cost double, averted double, annuity_years int, year int, synergy boolean"
    row = lambda p, k, bcr, year: (p, k, bcr, 100.0, bcr * 100.0 / ((1 - 1.03 ** -25) / 0.03), 25, year, False)
    good = [row("a", 1, 3.0, 1), row("a", 2, 2.0, 1), row("a", 3, 9.0, None), row("b", 1, 8.0, 2), row("b", 2, 1.0, 1)]
    assert gates.plan_findings(spark.createDataFrame(good, cols), 250.0).count() == 0
    bad = [row("a", 1, 3.0, 1), row("a", 2, 4.0, 1), row("b", 1, 3.0, None), row("b", 2, 2.0, 1), row("c", 1, -1.0, 1), (*row("c", 2, -2.0, 1)[:4], 500.0, 25, 1, False)]
    got = {(r.check, r.scenario, r.value) for r in gates.plan_findings(spark.createDataFrame(bad, cols), 150.0).collect()}
    assert got == {("plan_order", "a", 2.0), ("plan_budget", "a", 200.0), ("deferred_last", "b", 2.0), ("plan_bcr", "c", 1.0), ("plan_bcr", "c", 2.0),
                   ("plan_bcr_value", "c", 2.0), ("plan_budget", "c", 200.0)}
