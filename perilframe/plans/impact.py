"""Event-based results: from intensities at centroids to losses, curves, ladders and appraisals."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import assumptions as A
from ..functions.common import by_shuffle, clamp, may_match
from ..functions.curves import annuity
from ..functions.profile import clean_text, profile_wind_multiplier
from ..operators import exceedance, losses, sensitivity
from ..operators.lineage import written
from ..operators.spatial import nearest, water_snap

N_LADDER, N_RPS = len(A.LADDER_RPS), len(A.RETURN_PERIODS)


@dataclass
class Impact:
    """One impact evaluation. Every property is a lazy DataFrame; nothing runs until it is used.

    sites carry the vulnerability knobs. wind, surge, rain and river are event intensities at
    centroids, one row per key and centroid; river rows carry scenario and member. raster has bp and cfl per centroid.
    members: scenario and member of river rows, read from river where it isn't given. keep: event losses
    and damage per site are written as tables of the shared folder, for queries that read them many times:
    kept in memory, the plan of each stays part of every plan that reads it, and planning takes minutes.
    """

    sites: DataFrame
    centroids: DataFrame
    catalog: DataFrame
    wind: DataFrame
    surge: DataFrame
    rain: DataFrame
    river: DataFrame
    raster: DataFrame
    recipe: DataFrame
    deg: float = A.GRID_DEG
    surge_centroids: DataFrame | None = None
    members: DataFrame | None = None
    keep: bool = False

    @cached_property
    def site_map(self) -> DataFrame:
        """site_key to wind centroid; one row per site, a table of the shared folder because every peril reads it, several times."""
        near = nearest(self.sites.select("site_key", "latitude", "longitude"), self.centroids, deg=self.deg)
        return written(near)

    def _map(self) -> DataFrame:
        return self.site_map.where("covered").select("site_key", "centroid_id")

    @cached_property
    def surge_map(self) -> DataFrame:
        """Surge snap: only within cell scale of the site's wind centroid."""
        if self.surge_centroids is None:
            return self._map()
        pts = self.site_map.select("site_key", "latitude", "longitude", F.col("dist_km").alias("wind_dist_km"))
        return water_snap(pts, self.surge_centroids, deg=self.deg).where("covered").select("site_key", "centroid_id")

    def _knobs(self) -> DataFrame:
        return self.sites.select("site_key", "country", *losses.SITE_KNOBS)

    def _kept(self, df: DataFrame) -> DataFrame:
        return written(df) if self.keep else df

    @cached_property
    def _catalog(self) -> DataFrame:
        return self.catalog.where(F.col("freq") > 0.0)

    def _reaching(self, intensity: DataFrame, site_map: DataFrame) -> DataFrame:
        """Intensities at centroids that may be some site's; rows of others are left out before any shuffle."""
        return may_match(intensity, "centroid_id", site_map.select("centroid_id"))

    def _with_freq(self, intensity: DataFrame, keys: list[str], *more: str) -> DataFrame:
        """Intensities with their events' frequency, joined before events meet sites: there are more rows afterwards."""
        cat = may_match(self._catalog.select(*keys, "freq", *more), "event_id", intensity.select("event_id"))
        return intensity.join(by_shuffle(cat), keys)

    def _at_sites(self, intensity: DataFrame, site_map: DataFrame) -> DataFrame:
        return losses.site_intensity(intensity, site_map.join(by_shuffle(self._knobs()), "site_key"))

    @cached_property
    def weights(self) -> DataFrame:
        return losses.present_weights(self.recipe, self.catalog)

    @cached_property
    def joint(self) -> DataFrame:
        """source, event_id, site_key, wind_loss, surge_loss, loss, freq, event_name, country."""
        return self._kept(self._joint(self.wind, self.surge))

    def joint_of(self, scenarios: list[str] | None) -> DataFrame:
        """joint, of the catalogs that some of the scenarios blend; the others add nothing to them."""
        if not scenarios:
            return self.joint
        used = self.weights.where(F.col("scenario").isin(scenarios)).select("source").distinct()
        keep = lambda df: df.join(F.broadcast(used), "source", "left_semi")
        return self._joint(keep(self.wind), keep(self.surge))

    def _joint(self, wind: DataFrame, surge: DataFrame) -> DataFrame:
        """Wind and surge meet at the centroid, with the event's frequency, and sites come last: rows per event and site are
        neither shuffled nor summed. Sites that share a key, and a surge map of its own, need the sum."""
        if self.surge_centroids is not None:
            return self._joint_by_site(wind, surge, self._map(), self.surge_map)
        keys, m = ["source", "event_id", "centroid_id"], self._map()
        wind, surge = self._reaching(wind, m), self._reaching(surge, m)
        none = F.lit(None).cast("double")
        both = (wind.select(*keys, "intensity", none.alias("depth"), F.lit(1).alias("_w"), F.lit(0).alias("_s"))
                .unionByName(surge.select(*keys, none.alias("intensity"), "depth", F.lit(0).alias("_w"), F.lit(1).alias("_s"))))
        hits = both.groupBy(*keys).agg(*[F.max(c).alias(c) for c in ("intensity", "depth", "_w", "_s")])
        hits = self._with_freq(hits, ["source", "event_id"], "event_name")
        n = self.sites.groupBy("site_key").agg(F.count("*").alias("_n"), F.first(F.struct("country", *losses.SITE_KNOBS)).alias("_k"))
        rows = losses.site_intensity(hits, m.join(by_shuffle(n.where("_n = 1").select("site_key", "_k.*")), "site_key"))
        # a sum over a missing side is zero, over an unknown loss alone unknown
        other = lambda loss, own, side: F.coalesce(loss, F.when((F.col(own) == 0) | (F.col(side) == 1), 0.0))
        rows = rows.select("source", "event_id", "site_key", other(losses.wind_loss(rows), "_w", "_s").alias("wind_loss"),
                           other(F.when(F.col("_s") == 1, losses.surge_loss(rows)), "_s", "_w").alias("surge_loss"), "freq", "event_name", "country")
        once = rows.select("source", "event_id", "site_key", "wind_loss", "surge_loss", (F.col("wind_loss") + F.col("surge_loss")).alias("loss"), "freq", "event_name", "country")
        again = m.join(by_shuffle(n.where("_n > 1").select("site_key")), "site_key", "left_semi")
        return once.unionByName(self._joint_by_site(wind, surge, again, again))

    def _joint_by_site(self, wind: DataFrame, surge: DataFrame, wind_map: DataFrame, surge_map: DataFrame) -> DataFrame:
        w = self._at_sites(self._reaching(wind, wind_map), wind_map)
        s = self._at_sites(self._reaching(surge, surge_map), surge_map)
        keys = ["source", "event_id", "site_key"]
        both = losses.joint_event_losses(w.select(*keys, losses.wind_loss(w).alias("wind_loss")),
                                         s.select(*keys, losses.surge_loss(s).alias("surge_loss")), keys)
        return (both.join(by_shuffle(self._catalog.select("source", "event_id", "freq", "event_name")), ["source", "event_id"])
                .join(by_shuffle(self.sites.select("site_key", "country")), "site_key"))

    @cached_property
    def source_ead(self) -> DataFrame:
        """Per catalog and site: wind, surge and joint expected annual damage."""
        f = F.col("freq")
        return self.joint.groupBy("source", "site_key").agg(
            F.sum(f * F.col("wind_loss")).alias("tc"), F.sum(f * F.col("surge_loss")).alias("cflood"),
            F.sum(f * F.col("loss")).alias("joint"))

    @cached_property
    def storm_ead(self) -> DataFrame:
        """scenario, site_key, tc, cflood, joint."""
        return losses.blend_values(self.source_ead, self.weights, ["site_key"], ["tc", "cflood", "joint"])

    @cached_property
    def river_members(self) -> DataFrame:
        """Members per scenario that carry any event; a handful per scenario."""
        members = self.river if self.members is None else self.members
        return members.select("scenario", "member").distinct().groupBy("scenario").agg(F.count("*").alias("_members"))

    @cached_property
    def river_losses(self) -> DataFrame:
        r = self._at_sites(self._with_freq(self._reaching(self.river, self._map()), ["event_id"]), self._map())
        return self._kept(r.select("event_id", "scenario", "member", "site_key", "country", losses.river_loss(r).alias("loss"), "freq"))

    @cached_property
    def rain_hits(self) -> DataFrame:
        """Present-day rainfall per event and site, with frequency."""
        return self._kept(self._at_sites(self._with_freq(self._reaching(self.rain, self._map()), ["source", "event_id"]), self._map()))

    @cached_property
    def rain_losses(self) -> DataFrame:
        """scenario, event_id, site_key, freq, loss: the field scales with warming before drainage."""
        r = A.each_scenario(self.rain_hits)
        return r.select("scenario", "event_id", "site_key", "country", "freq", losses.rain_loss(r, F.col("scenario")).alias("loss"))

    @cached_property
    def fire_losses(self) -> DataFrame:
        """scenario, site_key, p, loss, ead; each covered site is its own arrival process."""
        pts = self._map().join(by_shuffle(self.raster), "centroid_id").join(by_shuffle(self._knobs()), "site_key")
        from ..operators.grid import flame_damage
        known = F.coalesce(F.col("cfl") >= 0.0, F.lit(False))
        pts = pts.where(F.col("bp").isNotNull()).select(
            "site_key", "country", *losses.SITE_KNOBS, clamp(F.col("bp"), 0.0, 1.0).alias("bp"),
            F.when(known, flame_damage(F.col("cfl"))).otherwise(A.FIRE_COND_INTERIM).alias("cond"))
        rows = A.each_scenario(pts)
        p, loss = losses.fire_terms(rows, F.col("scenario"))
        return self._kept(rows.select("scenario", "site_key", "country", p.alias("p"), loss.alias("loss")).withColumn("ead", F.col("p") * F.col("loss")))

    @cached_property
    def site_ead(self) -> DataFrame:
        """scenario, site_key, tc, cflood, rflood, prain, wfire, acute; sparse over sites without loss."""
        zero = F.lit(0.0)
        perils = ["tc", "cflood", "rflood", "prain", "wfire"]
        row = lambda **v: [v.get(p, zero).alias(p) for p in perils]
        storm = self.storm_ead.select("scenario", "site_key", *row(tc=F.col("tc"), cflood=F.col("cflood")))
        river = (losses.expected_annual(self.river_losses, ["scenario", "site_key"])
                 .join(F.broadcast(self.river_members), "scenario")
                 .select("scenario", "site_key", *row(rflood=F.col("ead") / F.col("_members"))))
        rain = losses.expected_annual(self.rain_losses, ["scenario", "site_key"]).select(
            "scenario", "site_key", *row(prain=F.col("ead")))
        fire = self.fire_losses.select("scenario", "site_key", *row(wfire=F.col("ead")))
        live = F.broadcast(self.weights.select("scenario").distinct())
        out = storm.unionByName(river).unionByName(rain).unionByName(fire).join(live, "scenario", "left_semi")
        out = out.groupBy("scenario", "site_key").agg(*[F.sum(p).alias(p) for p in perils])
        return self._kept(out.withColumn("acute", sum((F.col(p) for p in perils), F.lit(0.0))))

    def portfolio_aal(self) -> DataFrame:
        """Long rows scenario, peril, aal."""
        perils = ["tc", "cflood", "rflood", "prain", "wfire", "acute"]
        s = self.site_ead.groupBy("scenario").agg(*[F.sum(p).alias(p) for p in perils])
        cells = F.array(*[F.struct(F.lit(p).alias("peril"), F.col(p).alias("aal")) for p in perils])
        return s.select("scenario", F.explode(cells).alias("_c")).select("scenario", "_c.*")

    # --- curves --------------------------------------------------------------------------------

    # Catalogs of different countries are independent: each has its own curve, and curves add at equal return period.

    def storm_curve(self, loss: str = "loss", scenarios: list[str] | None = None) -> DataFrame:
        per_source = losses.portfolio_curve(self.joint_of(scenarios), ["source", "country"], loss)
        weights = self.weights.where(F.col("scenario").isin(scenarios)) if scenarios else self.weights
        return losses.blend_ladders(per_source, weights, [], N_RPS)

    def river_curve(self) -> DataFrame:
        per_member = losses.portfolio_curve(self.river_losses, ["scenario", "member", "country"])
        parts = per_member.join(F.broadcast(self.river_members), "scenario")
        rungs = [F.sum(F.get("ladder", F.lit(i)) / F.col("_members")) for i in range(N_RPS)]
        return parts.groupBy("scenario").agg(F.array(*rungs).alias("ladder"))

    def rain_curve(self) -> DataFrame:
        return losses.add_ladders(losses.portfolio_curve(self.rain_losses, ["scenario", "country"]), ["scenario"], N_RPS)

    def fire_curve(self) -> DataFrame:
        """Sites are the events: exceedance over independent site arrivals."""
        keys = ["scenario", "country"]
        points = exceedance.loss_points(self.fire_losses.select(*keys, "loss", F.col("p").alias("freq"), "site_key"), keys, order="site_key")
        return losses.add_ladders(exceedance.interpolated_ladder(points, keys), ["scenario"], N_RPS)

    def curves(self) -> DataFrame:
        """scenario, peril, ladder at the six return periods; acute adds the four catalogs comonotonically."""
        tag = lambda df, p: df.select("scenario", F.lit(p).alias("peril"), "ladder")
        live = F.broadcast(self.weights.select("scenario").distinct())
        joint = tag(self.storm_curve(), "joint")
        rest = tag(self.river_curve(), "rflood").unionByName(tag(self.rain_curve(), "prain")).unionByName(
            tag(self.fire_curve(), "wfire"))
        parts = joint.unionByName(rest).join(live, "scenario", "left_semi")
        cells = F.array(F.struct(F.col("peril").alias("p")), F.struct(F.lit("acute").alias("p")))
        return losses.add_ladders(parts.select("scenario", "ladder", F.explode(cells).alias("_p")).select(
            "scenario", F.col("_p.p").alias("peril"), "ladder"), ["scenario", "peril"], N_RPS)

    # --- per-site ladders and event sets -------------------------------------------------------

    def _storm_ladder(self, loss: str, rps: list[int]) -> DataFrame:
        keys = ["source", "site_key"]
        per_source = exceedance.step_ladder(exceedance.loss_points(self.joint, keys, loss, bounded=True), keys, loss, rps)
        return losses.blend_ladders(per_source, self.weights, ["site_key"], len(rps))

    def ladders(self, perils: tuple[str, ...] = ("tc", "cflood", "tc_joint", "rflood", "prain", "wfire"),
                rps: list[int] = A.LADDER_RPS) -> DataFrame:
        """Per-site loss ladders: scenario, site_key, peril, ladder (step convention)."""
        n = len(rps)
        out = []
        for p, col in (("tc", "wind_loss"), ("cflood", "surge_loss"), ("tc_joint", "loss")):
            if p in perils:
                out.append(self._storm_ladder(col, rps).withColumn("peril", F.lit(p)))
        if "rflood" in perils:
            keys = ["scenario", "member", "site_key"]
            one = exceedance.step_ladder(exceedance.loss_points(self.river_losses, keys, bounded=True), keys, "loss", rps)
            one = one.join(F.broadcast(self.river_members), "scenario")
            rungs = [F.sum(F.get("ladder", F.lit(i)) / F.col("_members")) for i in range(n)]
            out.append(one.groupBy("scenario", "site_key").agg(F.array(*rungs).alias("ladder")).withColumn("peril", F.lit("rflood")))
        if "prain" in perils:
            keys = ["scenario", "site_key"]
            one = exceedance.step_ladder(exceedance.loss_points(self.rain_losses, keys, bounded=True), keys, "loss", rps)
            out.append(one.withColumn("peril", F.lit("prain")))
        if "wfire" in perils:
            rung = [F.when(F.col("p") >= 1.0 / rp, F.col("loss")).otherwise(0.0) for rp in rps]
            out.append(self.fire_losses.select("scenario", "site_key", F.array(*rung).alias("ladder"), F.lit("wfire").alias("peril")))
        df = out[0].select("scenario", "site_key", "peril", "ladder")
        for o in out[1:]:
            df = df.unionByName(o.select("scenario", "site_key", "peril", "ladder"))
        return df

    def site_return_losses(self, ladders: DataFrame | None = None) -> DataFrame:
        """Per-site acute loss at 1-in-100 and 1-in-250, catalogs added at equal return period. ladders: as ladders() gives them."""
        if ladders is None:
            parts = self.ladders(("tc_joint", "rflood", "prain", "wfire"), A.SITE_RPS)
        else:
            rungs = F.array(*[F.get("ladder", F.lit(A.LADDER_RPS.index(rp))) for rp in A.SITE_RPS])
            parts = ladders.where(F.col("peril").isin("tc_joint", "rflood", "prain", "wfire")).withColumn("ladder", rungs)
        both = losses.add_ladders(parts, ["scenario", "site_key"], len(A.SITE_RPS))
        return both.select("scenario", "site_key", *[F.get("ladder", F.lit(i)).alias(f"loss_rp{rp}") for i, rp in enumerate(A.SITE_RPS)])

    def event_site_loss(self, floor_usd: float = A.EVENT_FLOOR_USD, scenarios: list[str] | None = None) -> DataFrame:
        """scenario, country, source, weight, event_id, event, freq, site_key, loss_usd."""
        kept = losses.sparse_events(self.joint_of(scenarios), floor_usd)
        weights = self.weights.select("scenario", "source", F.bround("weight", 6).alias("weight"))
        if scenarios:
            weights = weights.where(F.col("scenario").isin(scenarios))
        return (kept.join(F.broadcast(weights), "source")
                .select("scenario", "country", "source", "weight", "event_id", "event", "freq", "site_key", "loss_usd"))

    # --- adaptation ----------------------------------------------------------------------------

    def compact(self, scenario: str) -> DataFrame:
        """(peril, site_key, x, freq): events of equal intensity at a site collapse into one row.

        Expected damage of any knob setting is a sum over these rows, so appraisals repeat them
        instead of the events. Frequencies already carry catalog weights.
        """
        w = self.weights.where(F.col("scenario") == scenario).select("source", "weight")
        freq = F.sum(F.col("freq") * F.col("weight")).alias("freq")

        def squeeze(intensity: DataFrame, site_map: DataFrame, col: str, peril: str) -> DataFrame:
            live = self._reaching(intensity.join(F.broadcast(w.select("source")), "source", "left_semi"), site_map)
            hit = losses.site_intensity(self._with_freq(live, ["source", "event_id"]), site_map).join(F.broadcast(w), "source")
            return hit.groupBy("site_key", F.col(col).alias("x")).agg(freq).withColumn("peril", F.lit(peril))

        m = self._map()
        out = squeeze(self.wind, m, "intensity", "tc").unionByName(squeeze(self.surge, self.surge_map, "depth", "cflood"))
        river = self._with_freq(self._reaching(self.river.where(F.col("scenario") == scenario), m), ["event_id"])
        river = losses.site_intensity(river, m).join(F.broadcast(self.river_members), "scenario")
        river = river.groupBy("site_key", F.col("depth").alias("x")).agg(F.sum(F.col("freq") / F.col("_members")).alias("freq")).withColumn("peril", F.lit("rflood"))
        rain = self.rain_hits.groupBy("site_key", F.col("mm").alias("x")).agg(F.sum("freq").alias("freq")).withColumn("peril", F.lit("prain"))
        fire = self.fire_losses.where(F.col("scenario") == scenario).join(self._knobs().select("site_key", "fire_vuln", "asset_value_usd"), "site_key")
        given = F.col("loss") / F.col("asset_value_usd") / F.col("fire_vuln")
        fire = fire.where(F.col("asset_value_usd") > 0.0).select("site_key", given.alias("x"), F.col("p").alias("freq"), F.lit("wfire").alias("peril"))
        return out.unionByName(river).unionByName(rain).unionByName(fire)

    def knob_ead(self, rows: DataFrame, scenario: str) -> Column:
        """Annual damage of a compact row that carries site knobs and knob columns."""
        r = rows.withColumn("scenario", F.lit(scenario))
        frac = F.least(F.col("x") * F.col("fire_vuln") * losses._knob(r, "fire_mult", 1.0) * losses._knob(r, "dmg_scale", 1.0), F.lit(1.0))
        arrivals = F.least(F.col("freq") * losses._knob(r, "haz_mult", 1.0), F.lit(1.0))  # a stronger hazard reaches a site more often
        return (
            F.when(F.col("peril") == "tc", F.col("freq") * losses.wind_loss(r, "x"))
            .when(F.col("peril") == "cflood", F.col("freq") * losses.surge_loss(r, "x"))
            .when(F.col("peril") == "rflood", F.col("freq") * losses.river_loss(r, "x"))
            .when(F.col("peril") == "prain", F.col("freq") * losses.rain_loss(r, F.lit(scenario), "x"))
            .otherwise(arrivals * frac * F.col("asset_value_usd") * losses._knob(r, "exp_mult", 1.0)))

    def _factor_totals(self, repeat, by: list[str], scenarios: list[str]) -> DataFrame:
        out = None
        for sc in scenarios:
            rows = repeat(self.compact(sc).join(self._knobs(), "site_key"))
            one = rows.groupBy(*by).agg(F.sum(self.knob_ead(rows, sc)).alias("total")).select(F.lit(sc).alias("scenario"), *by, "total")
            out = one if out is None else out.unionByName(one)
        return out

    def sampled_aal(self, scenarios: list[str], n: int = A.MC_SAMPLES) -> DataFrame:
        """scenario, sample, total: annual acute damage of the portfolio under each of n joint draws."""
        return self._factor_totals(lambda rows: sensitivity.sampled(rows, n), ["sample"], scenarios)

    def driver_swings(self, scenarios: list[str]) -> DataFrame:
        """scenario, factor, swing of annual acute damage between a factor's ends."""
        return sensitivity.swings(self._factor_totals(sensitivity.one_at_a_time, ["factor", "side"], scenarios))

    def base_by_site(self, scenario: str) -> DataFrame:
        rows = self.compact(scenario).join(self._knobs(), "site_key")
        e = rows.select("site_key", "peril", self.knob_ead(rows, scenario).alias("e"))
        return e.groupBy("site_key").agg(
            *[F.sum(F.when(F.col("peril") == p, F.col("e")).otherwise(0.0)).alias(f"ead_{p}") for p in A.ACUTE],
            F.sum("e").alias("ead"))

    def measure_averted(self, pairs: DataFrame, scenario: str) -> DataFrame:
        """Averted annual damage per (measure, site) for in-scope pairs that carry knob columns.

        `flood_cap_max`, when present, lowers the site's own flood cap.
        """
        knobs = [c for c in ("wind_dmg_mult", "fb_bonus", "cf_depth_red", "fire_mult", "flood_cap_max") if c in pairs.columns]
        rows = (self.compact(scenario).join(self._knobs(), "site_key")
                .join(pairs.select("site_key", "measure", *knobs), "site_key"))
        if "flood_cap_max" in knobs:
            rows = rows.withColumn("flood_cap", F.least("flood_cap", "flood_cap_max"))
        e = rows.select("measure", "site_key", self.knob_ead(rows, scenario).alias("e"))
        after = e.groupBy("measure", "site_key").agg(F.sum("e").alias("_after"))
        base = self.base_by_site(scenario)
        keep = [c for c in pairs.columns if c not in ("site_key", "measure")]
        out = pairs.join(base.select("site_key", "ead"), "site_key", "left").join(after, ["measure", "site_key"], "left")
        averted = F.greatest(F.coalesce("ead", F.lit(0.0)) - F.coalesce("_after", F.lit(0.0)), F.lit(0.0))
        return out.select("measure", "site_key", *keep, averted.alias("averted"))


# Event-based measures and the retrofit catalog.
EVENT_MEASURES = [
    {"measure": "wind", "scope": "all", "wind_dmg_mult": 0.65, "fb_bonus": 0.0, "cf_depth_red": 0.0, "cost_pct": 1.0},
    {"measure": "flood", "scope": "flood", "wind_dmg_mult": 1.0, "fb_bonus": 0.5, "cf_depth_red": 0.0, "cost_pct": 0.6},
    {"measure": "buffer", "scope": "coastal", "wind_dmg_mult": 1.0, "fb_bonus": 0.0, "cf_depth_red": 0.3, "cost_pct": 0.4},
]
# key, name, peril, modelled, lifespan, USD per key, percent of value
CATALOG = [
    ("reroof", "Re-roof to rated metal system", "wind", True, 40, 9000.0, 2.0),
    ("openings", "Impact-rated openings (windows & doors)", "wind", True, 30, 6500.0, 1.2),
    ("tiedown", "Roof-to-wall connection retrofit", "wind", True, 50, 2500.0, 0.5),
    ("floodproof", "Dry floodproofing (barriers & sealing)", "flood", True, 25, 1800.0, 0.6),
    ("utility", "Critical systems elevation", "flood", True, 30, 1200.0, 0.35),
    ("elevate", "First-floor elevation (low-rise only)", "flood", True, 50, 25000.0, 6.0),
    ("buffer", "Coastal buffer (dune & mangrove)", "cflood", True, 20, 1500.0, 0.4),
    ("defensible", "Defensible space (wildfire)", "wildfire", True, 10, 400.0, 0.1),
    ("roof_class_a", "Class A roof assembly (wildfire)", "wildfire", True, 40, 3000.0, 0.8),
    ("backup_power", "Backup power (full-site generation)", "continuity", False, 20, 2200.0, 0.5),
]


def event_measure_pairs(sites: DataFrame, base: DataFrame) -> DataFrame:
    """In-scope (measure, site) pairs of the event-based appraisal, with cost."""
    df = sites.select("site_key", "asset_value_usd").join(base.select("site_key", "ead_cflood", "ead_rflood"), "site_key", "left").fillna(0.0)
    df = df.select("*", F.explode(F.expr(A.sql_literal(EVENT_MEASURES))).alias("_m")).select("*", "_m.*")
    keep = (F.when(F.col("scope") == "flood", F.col("ead_cflood") + F.col("ead_rflood") > A.SCOPE_USD)
            .when(F.col("scope") == "coastal", F.col("ead_cflood") > A.SCOPE_USD).otherwise(True))
    return df.where(keep).select("site_key", "measure", "wind_dmg_mult", "fb_bonus", "cf_depth_red",
                                 (F.col("asset_value_usd") * F.col("cost_pct") / 100.0).alias("cost"))


def adaptation_summary(averted: DataFrame) -> DataFrame:
    """Per measure: averted, sites, cost, benefit and BCR (null when nothing is spent)."""
    an = annuity(A.HORIZON_YEARS, A.DISCOUNT_RATE)
    s = averted.groupBy("measure").agg(F.sum("averted").alias("averted"), F.count("*").alias("sites_in_scope"), F.sum("cost").alias("cost"))
    return s.withColumn("benefit", F.col("averted") * an).withColumn("bcr", F.when(F.col("cost") > 0.0, F.col("benefit") / F.col("cost")))


def catalog_pairs(sites: DataFrame, base: DataFrame) -> DataFrame:
    """Every (site, measure) of the retrofit catalog: applies, reason, knobs and cost.

    Out-of-scope pairs keep neutral knobs and cost nothing; each carries the reason in words.
    """
    df = sites.join(base.select("site_key", "ead_cflood", "ead_rflood"), "site_key", "left").fillna(0.0, ["ead_cflood", "ead_rflood"])
    now = profile_wind_multiplier()
    metal = profile_wind_multiplier(roof_type=F.lit("metal"), roof_year=F.lit(float(A.REFERENCE_YEAR)))
    impact = profile_wind_multiplier(opening_protection=F.lit("impact"))
    df = df.select("*", now.alias("_now"), metal.alias("_metal"), impact.alias("_impact"))
    rows = [{"measure": k, "measure_name": n, "peril": p, "modelled": m, "life": life, "per_key": pk, "pct": pct}
            for k, n, p, m, life, pk, pct in CATALOG]
    df = df.select("*", F.explode(F.expr(A.sql_literal(rows))).alias("_m")).select("*", "_m.*")
    flood = F.col("ead_cflood") + F.col("ead_rflood") > A.SCOPE_USD
    no_flood = "flood_below_scope"
    no_roof = F.col("roof_type").isNull() & F.col("roof_year").isNull()
    built = F.coalesce("year_built", F.lit(0.0))
    wui = F.coalesce(F.col("wui_class").isin("interface", "intermix"), F.lit(False))
    is_ = lambda k: F.col("measure") == k
    text_or = lambda cond, reason: F.when(cond, reason)
    reason = (
        F.when(is_("reroof"), F.when(no_roof, "roof_unknown")
               .when(F.col("_metal") >= F.col("_now") - 1e-9, "roof_good"))
        .when(is_("openings"), F.when(F.col("opening_protection").isNull(), "openings_unknown")
              .when(F.col("opening_protection") == "impact", "openings_good"))
        .when(is_("tiedown"), text_or(~(F.coalesce(F.col("construction").isin("frame", "masonry"), F.lit(False)) & (built < 2002)),
                                      "frame_not_eligible"))
        .when(is_("floodproof"), text_or(~flood, no_flood))
        .when(is_("utility"), F.when(F.col("equipment_elevated"), "equipment_raised").when(~flood, no_flood))
        .when(is_("elevate"), F.when(F.col("stories").isNull(), "stories_unknown")
              .when(F.col("stories") > 2, "too_tall").when(~flood, no_flood))
        .when(is_("buffer"), text_or(F.col("ead_cflood") <= A.SCOPE_USD, "surge_below_scope"))
        .when(is_("defensible"), text_or(~(wui & (F.coalesce("defensible_space_m", F.lit(0.0)) < 30.0)),
                                         "outside_wui_or_clear"))
        .when(is_("roof_class_a"), text_or(~(wui & ~F.col("roof_class_a")),
                                           "outside_wui_or_class_a"))
        .otherwise(text_or(~F.coalesce(clean_text(F.col("backup_power")).isin("none", "no", "false", "0", "partial"), F.lit(True)),
                           "power_backed_up")))
    df = df.withColumn("reason", reason).withColumn("applies", F.col("reason").isNull())
    wind = (F.when(is_("reroof"), F.col("_metal") / F.col("_now")).when(is_("openings"), F.col("_impact") / F.col("_now"))
            .when(is_("tiedown"), 0.85).otherwise(1.0))
    cost = F.when(F.col("keys") > 0.0, F.col("keys") * F.col("per_key")).otherwise(F.col("asset_value_usd") * F.col("pct") / 100.0)
    on = F.col("applies")
    return df.select(
        "site_key", "name", "measure", "measure_name", "peril", "modelled", "life", "applies", "reason",
        F.when(on, wind).otherwise(1.0).alias("wind_dmg_mult"),
        F.when(on & is_("floodproof"), 0.5).when(on & is_("elevate"), 1.5).otherwise(0.0).alias("fb_bonus"),
        F.when(on & is_("buffer"), 0.3).otherwise(0.0).alias("cf_depth_red"),
        F.when(on & is_("defensible"), A.FIRE_DEFENSIBLE).when(on & is_("roof_class_a"), A.FIRE_ROOF_A).otherwise(1.0).alias("fire_mult"),
        F.when(on & is_("utility"), A.FLOOD_CAP_ELEVATED).alias("flood_cap_max"),
        F.when(on, cost).otherwise(0.0).alias("cost"))


def catalog_projects(averted: DataFrame) -> DataFrame:
    """Fundable projects: in scope, costed and with a benefit; life capped at the horizon."""
    factors = {int(y): annuity(y, A.DISCOUNT_RATE) for y in sorted({min(c[4], A.HORIZON_YEARS) for c in CATALOG})}
    years = F.least("life", F.lit(A.HORIZON_YEARS))
    av, cost = F.bround("averted", 2), F.bround("cost", 2)
    df = averted.where(F.col("modelled") & (F.col("cost") > 0.0) & (F.col("averted") > 0.0))
    return df.select("site_key", "name", "measure", "measure_name", "peril", av.alias("averted"), cost.alias("cost"),
                     years.alias("annuity_years"),
                     F.bround(F.col("averted") * A.lookup(years, factors, 0.0) / F.col("cost"), 3).alias("bcr"))


def plan_order() -> list[Column]:
    return [F.col("bcr").desc(), F.col("name"), F.col("measure")]


def capital_plan(projects: DataFrame, n: int = A.PLAN_TOP) -> DataFrame:
    """Top projects by BCR, then site, then measure."""
    return projects.where(F.col("cost") > 0.0).orderBy(*plan_order()).limit(n)
