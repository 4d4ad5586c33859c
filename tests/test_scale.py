"""Joins of growing tables go by shuffle, however small their files look; hot locations are not repeated."""

import contextlib
import io

from pyspark.sql import functions as F

from perilframe import assumptions as A
from perilframe.functions import curves
from perilframe.functions import interruption as bi
from perilframe.functions.common import may_match
from perilframe.operators import adaptation, exceedance, gates, grid, losses, matching, payoff, scoring, tcor
from perilframe.plans import impact, standin


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_name_matching_broadcasts_nothing(spark):
    sites = spark.createDataFrame([(1, "Palm Court", "P1"), (2, "Ocean Tower", None)], "site_key long, name string, site_id string")
    claims = spark.createDataFrame([("Ocean Tower Annex",), ("palm court",), (None,)], "claimant string")
    found = matching.match_names(claims, sites, "claimant")
    rows = matching.attach_match(claims, found, ["claimant"])
    assert "Broadcast" not in plan_of(rows)
    assert {(r.claimant, r.site_key, r.tier) for r in rows.collect()} == {("Ocean Tower Annex", 2, 3), ("palm court", 1, 2), (None, None, None)}


def test_grid_lookup_repeats_nothing_for_sites_of_one_place(spark):
    sites = spark.createDataFrame([(k, 27.0, -82.0) for k in range(500)], "site_key long, latitude double, longitude double")
    cells = spark.createDataFrame([(27.0, -82.1, "present", "tc", 1.0, 2.0, 3.0, 4.0, 5.0, 6.0)],
                                  "lat double, lon double, scenario string, hazard string, " + ", ".join(f"{v} double" for v in A.V_COLS))
    found = scoring.location_lookup(sites, cells, ["present"])
    assert found.count() == 1
    rows = scoring.grid_lookup(sites, cells, ["present"])
    assert "Broadcast" not in plan_of(rows)
    assert rows.select("site_key").distinct().count() == rows.count() == 500
    assert {tuple(r.v) for r in rows.select("tc.v").collect()} == {(1.0, 2.0, 3.0, 4.0, 5.0, 6.0)}


def test_intensity_vectors_and_event_hits_broadcast_nothing(spark):
    inten = spark.createDataFrame([("present", 1, 7, 30.0), ("present", 2, 7, 50.0)], "source string, event_id long, centroid_id long, intensity double")
    cat = spark.createDataFrame([("present", 1, 0.1), ("present", 2, 0.05)], "source string, event_id long, freq double")
    points = exceedance.loss_points(inten.join(cat.hint("merge"), ["source", "event_id"]), ["source", "centroid_id"], "intensity")
    lad = exceedance.dense_ladder(spark.createDataFrame([("present", 7), ("present", 8)], "source string, centroid_id long"),
                                  exceedance.step_ladder(points, ["source", "centroid_id"], "intensity"), ["source", "centroid_id"])
    assert "Broadcast" not in plan_of(lad.where(F.exists("ladder", lambda x: x > 0.0)))
    assert {r.centroid_id: max(r.ladder) for r in lad.collect()} == {7: 50.0, 8: 0.0}
    place = spark.createDataFrame([(7, 1), (7, 2)], "centroid_id long, site_key long")
    hits = losses.site_intensity(inten, place)
    assert "Broadcast" not in plan_of(hits) and hits.count() == 4
    base = spark.createDataFrame([("present", 0, 0), ("present", 0, 1)], "scenario string, ix long, iy long")
    wet = base.limit(1).select("*", *[F.lit(2.0).alias(v) for v in A.V_COLS])
    out = grid.align_to_cells(wet, base, ["scenario", "ix", "iy"])
    assert "Broadcast" not in plan_of(out.where("v10 >= 0")) and sorted(r.v10 for r in out.collect()) == [0.0, 2.0]


def test_interruption_split_runs_in_batches_and_equals_its_months(spark):
    rows = [(float(loss), 1e6, daily, 300.0, limit, region) for loss in (0, 5e3, 9e4, 2e5, 8e5, 2e6) for daily in (1000.0, None)
            for limit in (None, 20000.0) for region in ("gulf", "nowhere", None)]
    df = spark.createDataFrame(rows, "loss double, bi_value double, bi_daily double, bi_anchor_days double, bi_limit double, bi_region string")
    split = bi.split_expected(F.col("loss"), bi.econ_of(), A.BI_STORM_MONTHS)
    assert "ArrowEvalPython" in plan_of(df.select(split))
    key, parts = ["loss", "bi_daily", "bi_limit", "bi_region"], ["gross", "waiting", "retained"]
    weight = F.get(F.array(*[F.lit(float(w)) for w in A.BI_STORM_MONTHS]), F.col("m"))
    month = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("m"))
    month = month.select(*key, weight.alias("w"), bi.split_at_month(F.col("loss"), bi.econ_of(), F.col("m")).alias("s"))
    want = {tuple(r[k] for k in key): r for r in month.groupBy(*key).agg(*[F.sum(F.col("w") * F.col(f"s.{c}")).alias(c) for c in parts]).collect()}
    for got in df.select(*key, split.alias("s")).select(*key, "s.*").collect():
        for c in parts:
            w = want[tuple(got[k] for k in key)][c]
            if got.bi_daily is not None:
                assert abs(got[c] - w) <= 1e-6 * max(1.0, abs(w)), (c, got, w)
            elif got.loss > 0:
                assert got[c] is None and w is None


def test_hazard_rows_of_one_place_are_dealt_out_before_scoring(spark):
    sites = spark.createDataFrame([(k, 27.0, -82.0) for k in range(50)], "site_key long, latitude double, longitude double")
    sites = sites.select("*", F.lit(None).cast("double").alias("ground_elev_m"), F.lit(None).cast("double").alias("cell_ground_elev_m"), F.lit("interface").alias("wui_class"))
    cells = spark.createDataFrame([(27.0, -82.1, "present", "tc", 1.0, 2.0, 3.0, 4.0, 5.0, 6.0)],
                                  "lat double, lon double, scenario string, hazard string, " + ", ".join(f"{v} double" for v in A.V_COLS))
    rows = scoring.site_hazards(sites, cells, ["present"], layers={"tc": ["present"]})
    assert "hashpartitioning(site_key" in plan_of(rows).split("SortMergeJoin")[0]
    assert rows.count() == 50


def test_annual_fractions_run_in_batches_and_equal_their_formulas(spark):
    vec = [[30.0, 40.0, 55.0, 70.0, 80.0, 95.0], [0.1, 0.0, 0.6, 1.2, 1.8, 2.5], [0.4, 0.9, 1.1, 1.5, 2.0, 2.2], [60.0, 150.0, 300.0, 800.0, 1500.0, 3000.0]]
    rows = [(vec[0], vec[1], vec[2], vec[3], 1.1, 74.7, 0.5, 0.3, -0.1, 0.9), ([None] * 6, vec[1], None, [None] * 6, None, None, None, 0.3, None, None)]
    df = spark.createDataFrame(rows, "i_tc array<double>, i_cflood array<double>, i_rflood array<double>, i_mm array<double>, wind_mult double, v_half double,"
                               " fb_coast double, fb_river double, fb_rain double, flood_cap double")
    knobs = {"k_haz": F.lit(1.08), "k_dmg": F.lit(0.7), "k_fb": F.lit(0.5), "k_red": F.lit(0.3), "k_tc": F.lit(0.65)}
    out = df.select("*", scoring.annual_fractions(knobs).alias("_f"))
    assert "ArrowEvalPython" in plan_of(out)
    at = lambda c: {rp: F.get(F.col(c), F.lit(i)) * 1.08 for i, rp in enumerate(A.RETURN_PERIODS)}
    wind = lambda x: F.least(curves.wind_damage(x, F.col("v_half")) * F.col("wind_mult") * 0.65 * 0.7, F.lit(1.0))
    flood = lambda fb: lambda x: F.least(curves.flood_damage(F.greatest(x, F.lit(0.0)), F.col(fb) + 0.5, F.col("flood_cap")) * 0.7, F.lit(1.0))
    plan = {"tc": (at("i_tc"), wind), "cflood": ({rp: F.greatest(x - 0.3, F.lit(0.0)) for rp, x in at("i_cflood").items()}, flood("fb_coast")),
            "rflood": (at("i_rflood"), flood("fb_river")), "prain": ({rp: curves.ponding_depth(x) for rp, x in at("i_mm").items()}, flood("fb_rain"))}
    want = [curves.trapezoid({rp: f(x) for rp, x in (curves.sub_ten(v[10], v[25]) | v).items()}).alias(p) for p, (v, f) in plan.items()]
    for got, told in zip(out.select("_f.*").collect(), df.select(*want).collect(), strict=True):
        assert all(abs(got[p] - told[p]) <= 1e-12 for p in plan), (got, told)
    assert out.select("_f.tc").first()[0] > 0.005


def test_tornado_sums_the_sites_once(spark):
    n = len(A.RETURN_PERIODS)
    row = {"scenario": "present", "i_tc": [40.0] * n, "i_cflood": [1.0] * n, "i_rflood": [1.0] * n, "i_mm": [300.0] * n, "wind_mult": 1.0, "v_half": 74.7, "fb_coast": 0.1,
           "fb_river": 0.1, "fb_rain": 0.1, "flood_cap": 0.6, "fire_cond": 0.3, "fire_vuln": 1.0, "fire_pct": 0.5, "asset_value_usd": 1e6, "revenue_usd": 3e5, "gop_margin": 0.3,
           "reopen_months": 12.0, "heat_drop": 0.1}
    fin = spark.createDataFrame([row, row]).withColumn("heat_ind", F.struct(F.lit(30.0).alias("days_over_35")))
    out = adaptation.tornado(fin)
    assert plan_of(out).count("ArrowEvalPython") == 1
    got = {r.factor: r for r in out.collect()}
    assert set(got) == {k for k, *_ in adaptation.FACTORS}
    up = sum((r.hi - r.central) ** 2 for r in got.values()) ** 0.5
    assert all(abs(r.high - r.central - up) < 1e-6 and r.lo < r.central < r.hi for r in got.values())


def test_ladders_are_split_without_a_row_for_each_rung(spark):
    econ = [(1, 1e6, 1000.0, 300.0, 5e4, "hawaii"), (2, 2e6, None, 365.0, None, "nowhere"), (3, None, 500.0, 300.0, None, "global_mean"), (4, 0.0, 500.0, 300.0, 1.0, "global_mean"),
            (5, 1e6, 800.0, None, None, None), (6, 1e6, 900.0, 400.0, None, None)]
    sites = spark.createDataFrame(econ, "site_key long, bi_value double, bi_daily double, bi_anchor_days double, bi_limit double, bi_region string")
    ladder = [-5.0, 0.0, 1e4, None, 9e4, 2e5, 8e5, 3e6]
    rows = [("present", k, p, x) for k, *_ in econ for p in ("rflood", "prain") for x in (ladder, ladder[:5])]
    ladders = spark.createDataFrame([*rows, ("present", 6, "wfire", None), ("present", 6, "tc", ladder)], "scenario string, site_key long, peril string, ladder array<double>")
    got = tcor.interruption_ladders(ladders, sites, ["rflood", "prain", "wfire"])
    assert "Generate" not in plan_of(got)
    f = [1 / rp for rp in A.LADDER_RPS] + [1 / A.LADDER_RPS[-1]]
    w = [0.5 * (f[max(i - 1, 0)] - f[i + 1]) for i in range(len(A.LADDER_RPS))]
    w[-1] += f[-1]
    rungs = ladders.where("peril in ('rflood', 'prain')").join(sites, "site_key").select("*", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.get("ladder", i))).alias("i", "loss"))
    by_time = {p: bi.split_expected(F.col("loss"), bi.econ_of(), m) for p, m in (("prain", A.BI_STORM_MONTHS), ("rflood", A.BI_FLAT_MONTHS))}
    want = {}
    for p, s in by_time.items():
        for r in rungs.where(F.col("peril") == p).select("site_key", "i", s.alias("s")).collect():
            at = want.setdefault((r.site_key, p), [None] * 4)
            for c, x in enumerate((r.s.gross, r.s.waiting, r.s.overage, r.s.retained)):
                at[c] = at[c] if x is None else (at[c] or 0.0) + x * w[r.i]
    found = {(r.site_key, r.peril): [r.gross, r.waiting, r.overage, r.retained] for r in got.collect()}
    assert found.keys() == want.keys()
    for k, row in want.items():
        assert [x is None for x in found[k]] == [x is None for x in row], (k, found[k], row)
        assert all(x is None or abs(x - y) <= 1e-9 * max(1.0, abs(y)) for x, y in zip(found[k], row)), (k, found[k], row)
    assert found[1, "prain"][0] > 0.0 and found[1, "prain"][0] != found[1, "rflood"][0]


def test_catalogs_that_no_asked_scenario_blends_are_left_out_early(spark):
    double = lambda names: ", ".join(f"{n} double" for n in names)
    site = [(k, "USA", 27.0, -82.0, 1e6, 1.0, 60.0, 0.1, 0.1, 0.1, 0.6, 0.5) for k in (1, 2, 2)]
    sites = spark.createDataFrame(site, "site_key long, country string, latitude double, longitude double, " + double(losses.SITE_KNOBS))
    cen = spark.createDataFrame([(7, 27.0, -82.1)], "centroid_id long, lat double, lon double")
    cat = spark.createDataFrame([(s, e, 0.01 * e, None) for s in ("present", "rcp26_2060", "rcp85_2060") for e in (1, 2)], "source string, event_id long, freq double, event_name string")
    wind = cat.select("source", "event_id", F.lit(7).cast("long").alias("centroid_id"), (F.col("event_id") * 20.0 + 30.0).alias("intensity"))
    deep = wind.select("source", "event_id", "centroid_id", F.lit(1.0).alias("depth"))
    im = impact.Impact(sites=sites, centroids=cen, catalog=cat, wind=wind, surge=deep, rain=deep, river=deep, raster=deep, recipe=A.recipe_table(spark))
    cols = ["source", "event_id", "site_key", "wind_loss", "surge_loss", "freq"]
    want = im.joint.where("source = 'present'").select(cols).collect()
    assert len(want) == 6 and sorted(want) == sorted(im.joint_of(["present"]).select(cols).collect())
    assert im.storm_curve(scenarios=["present"]).collect() == im.storm_curve().where("scenario = 'present'").collect() != []


def test_unchanged_ladders_save_nothing_and_repeated_rows_are_summed(spark):
    split = "struct<gross: double, retained: double>"
    cols = [f"_{x}_{p}" for x in "ln" for p in payoff._PERILS]
    rows = [("present", k, "wind", 1.0, *[(5.0, 2.0)] * 4, *[(4.0, 1.5)] * 3, None) for k in (1, 1, 2)]
    df = spark.createDataFrame(rows, "scenario string, site_key long, measure string, d_gross double, " + ", ".join(f"{c} {split}" for c in cols))
    out = payoff._interruption_change(df)
    assert out.columns == ["scenario", "site_key", "measure", "d_gross", "bi_gross", "bi_kept"]
    assert sorted((r.site_key, r.bi_gross, r.bi_kept) for r in out.collect()) == [(1, 16.0, 7.0), (1, 16.0, 7.0), (2, 8.0, 3.5)]


def star_tables(spark, path):
    """A few sites, centroids and storms; each event hits each centroid twice, and some rows have no quantity."""
    write = lambda rows, cols, name: spark.createDataFrame(rows, cols).write.parquet(f"{path}/{name}.parquet")
    write([(k, f"Customer#{k:09d}", k, 100.0 * k, "BUILDING") for k in (1, 2, 3, 4, 4)], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string", "customer")
    write([(k, 10 * k) for k in (1, 2, 3)], "p_partkey long, p_size int", "part")
    write([(k,) for k in range(20)], "o_orderkey long", "orders")
    write([(e, c, q) for e in range(20) for c in (1, 2, 3) for q in (30.0 + e + c, 12.0, None)], "l_orderkey long, l_partkey long, l_quantity double", "lineitem")
    return str(path)


def test_pack_gate_reads_all_scenarios_and_perils(spark, tmp_path, monkeypatch):
    from checks import q_more
    seen = {}
    events, ladders = gates.event_findings, gates.ladder_findings
    monkeypatch.setattr(gates, "event_findings", lambda ev, *a: seen.update(ev=ev) or events(ev, *a))
    monkeypatch.setattr(gates, "ladder_findings", lambda lad, *a: seen.update(lad=lad) or ladders(lad, *a))
    q_more.gate_pack_findings(spark, star_tables(spark, tmp_path))
    assert {r.scenario for r in seen["ev"].select("scenario").distinct().collect()} == set(A.SCENARIOS)
    assert {r.peril for r in seen["lad"].select("peril").distinct().collect()} == {"tc", "cflood", "tc_joint", "rflood", "prain", "wfire"}


def test_event_rules_of_one_table_share_a_pass_and_find_the_same(spark):
    ev = spark.createDataFrame([("present", "USA", "present", "a", 1, 0.1, 1, 5e4), ("present", "USA", "present", "a", 1, 0.1, 1, 5e4), ("present", "USA", "present", "b", 2, 0.0, 9, 5.0),
                                ("present", "USA", "present", "b", 3, 0.1, None, 5e4)], "scenario string, country string, source string, event string, event_id long, freq double, site_key long, loss_usd double")
    parts = spark.createDataFrame([("present", "USA", "present", 1.0, 100.0, 50.0)], "scenario string, country string, source string, weight double, aal_usd double, kept_aal_usd double")
    sites = spark.createDataFrame([(1,), (1,), (2,)], "site_key long")
    out = gates.event_findings(ev, parts, sites, spark.createDataFrame([("present", 100.0)], "scenario string, joint double"))
    assert {(r["check"], r.value) for r in out.collect()} == {("event_frequency", 1.0), ("event_floor", 1.0), ("event_site", 2.0), ("event_duplicate", 1.0), ("event_name", 1.0), ("floor_dropped", 0.5)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("_known") < 12


def test_events_out_of_reach_of_sites_are_left_out_before_the_first_shuffle(spark, tmp_path):
    sf = star_tables(spark, tmp_path)
    near = spark.createDataFrame([(2,), (None,)], "centroid_id long")
    for rows in (standin.wind(spark, sf), standin.surge(spark, sf), standin.rain(spark, sf), standin.river(spark, sf)):
        few = may_match(rows, "centroid_id", near)
        plan = few._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Aggregate [") < plan.index("Join LeftSemi")  # the join is below
        assert sorted(few.where("centroid_id = 2").collect()) == sorted(rows.where("centroid_id = 2").collect()) != []
        assert few.where("centroid_id <> 2").count() == 0
    assert {r.intensity for r in standin.wind(spark, sf).where("event_id = 4 and centroid_id = 1").collect()} == {35.0 * 1.5 + 20.0}


def test_joint_losses_shuffle_no_rows_per_event_and_site(spark, tmp_path):
    from checks import context
    im = context.impact(spark, star_tables(spark, tmp_path))
    rows = im.joint.collect()
    by_site = im._joint_by_site(im.wind, im.surge, im._map(), im._map()).select(im.joint.columns)
    key = lambda r: (r.source, r.event_id, r.site_key, r.country or "")
    got, want = sorted(rows, key=key), sorted(by_site.collect(), key=key)
    assert len(got) == len(want) > 0
    for x, y in zip(got, want):
        assert key(x) == key(y) and (x.freq, x.event_name) == (y.freq, y.event_name)
        assert all(abs(x[c] - y[c]) <= 1e-9 * abs(y[c]) for c in ("wind_loss", "surge_loss", "loss"))
    once = plan_of(im.joint).split("Union")[1]
    assert "hashpartitioning(source" not in once.split("SortMergeJoin [centroid_id")[0]


def test_curves_of_one_centroid_take_one_shuffle_and_equal_those_in_buckets(spark):
    rows = [(k, float((e * 37 + k) % 23) * 1.5, 0.01 + e % 5 * 0.003, e) for k in (1, 2, 3) for e in range(60)] + [(4, None, 0.1, 1), (5, 3.0, 0.0, 1), (None, 2.0, 0.2, 1)]
    df = spark.createDataFrame(rows, "k long, loss double, freq double, event_id long")
    one, many = exceedance.loss_points(df, ["k"], bounded=True), exceedance.loss_points(df, ["k"])
    assert plan_of(one).count("Exchange hashpartitioning") == 1 < plan_of(many).count("Exchange hashpartitioning")
    found = {(r.k, r.loss): r for r in one.collect()}
    want = many.collect()
    assert len(found) == len(want) == 22 * 3
    for r in want:
        x = found[r.k, r.loss]
        assert x.above == r.above and all(abs(x[c] - r[c]) < 1e-12 for c in ("cum_before", "cum_first", "cum_last"))
