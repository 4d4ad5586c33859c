"""Hazard-grid queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from perilframe import assumptions as A
from perilframe.functions import geo
from perilframe.operators import gates, grid, keyed, scoring
from perilframe.operators.lineage import written
from perilframe.operators.spatial import near_any_site
from perilframe.plans import standin as S

from .context import DEG, r, rounded
from .registry import register
from .sql_parts import CTE, box, curve, d, query, rnd, values

V = A.V_COLS
CELL = 1.0  # degrees; the stand-in centroids are too sparse for quarter-degree cells
PV = ", ".join(V)
_cat_pivot = ", ".join(f"coalesce(max(CASE WHEN rp={rp} THEN loss END),0) AS v{rp}" for rp in A.RETURN_PERIODS)
_x = {
    "rpi": curve("(SELECT w.source, w.centroid_id, w.event_id, w.intensity, c.freq FROM wind w JOIN cat c USING (source, event_id))",
                 "source, centroid_id", loss="intensity"),
    "rpd": curve("(SELECT w.source, w.centroid_id, w.event_id, w.depth, c.freq FROM surge w JOIN cat c USING (source, event_id))",
                 "source, centroid_id", loss="depth"),
    "srcs": "SELECT DISTINCT source FROM cat",
    "cpi": f"""SELECT s.source, c.centroid_id, c.lat, c.lon, {_cat_pivot} FROM cen c CROSS JOIN srcs s LEFT JOIN rpi ON rpi.source=s.source AND rpi.centroid_id=c.centroid_id
GROUP BY 1,2,3,4""",
    "cpd": f"""SELECT s.source, c.centroid_id, c.lat, c.lon, {_cat_pivot} FROM cen c CROSS JOIN srcs s LEFT JOIN rpd ON rpd.source=s.source AND rpd.centroid_id=c.centroid_id
GROUP BY 1,2,3,4""",
    "thin": "SELECT source, CAST(round_even(lat,0) AS BIGINT) AS iy, CAST(round_even(lon,0) AS BIGINT) AS ix, " + ", ".join(f"avg({v}) AS {v}" for v in V) + " FROM cpi GROUP BY 1,2,3",
    "wet": "SELECT source, CAST(round_even(lat,0) AS BIGINT) AS iy, CAST(round_even(lon,0) AS BIGINT) AS ix, " + ", ".join(f"avg({v}) AS {v}" for v in V)
           + f" FROM cpd WHERE greatest({PV})>1e-6 GROUP BY 1,2,3",
    "blend": "SELECT w.scenario, iy, ix, " + ", ".join(f"sum({v}*w.weight)/sum(w.weight) AS {v}" for v in V) + " FROM thin JOIN recipe w USING (source) GROUP BY 1,2,3",
    "blendw": "SELECT w.scenario, iy, ix, " + ", ".join(f"sum({v}*w.weight)/sum(w.weight) AS {v}" for v in V) + " FROM wet JOIN recipe w USING (source) GROUP BY 1,2,3",
    "aligned": "SELECT b.scenario, b.iy, b.ix, " + ", ".join(f"coalesce(g.{v},0) AS {v}" for v in V)
               + " FROM blend b LEFT JOIN blendw g ON g.scenario=b.scenario AND g.iy=b.iy AND g.ix=b.ix",
}
RV = ", ".join(f"{rnd(v, 6)} AS {v}" for v in V)


def source_vectors(spark, sf, depth=False):
    inten = S.surge(spark, sf).withColumnRenamed("depth", "intensity") if depth else S.wind(spark, sf)
    return grid.centroid_intensity(inten, S.catalog(spark, sf), S.centroids(spark, sf))


def wind_grid(spark, sf):
    return grid.thin_to_grid(source_vectors(spark, sf), ["source"], CELL)


def water_grid(spark, sf):
    return grid.thin_to_grid(source_vectors(spark, sf, True), ["source"], CELL, wet_only=True)


def v6(df):
    return rounded(df, {v: 6 for v in V})


@register("centroid_rp_intensity", query(f"SELECT source, centroid_id, {RV} FROM cpi", _x))
def centroid_rp_intensity(spark, sf):
    return v6(source_vectors(spark, sf).drop("lat", "lon"))


@register("thin_grid", query(f"SELECT source, iy, ix, {RV} FROM thin", _x))
def thin_grid(spark, sf):
    return v6(wind_grid(spark, sf))


@register("thin_grid_wet", query(f"SELECT source, iy, ix, {RV} FROM wet", _x))
def thin_grid_wet(spark, sf):
    return v6(water_grid(spark, sf))


@register("recipe_blend", query(f"SELECT scenario, iy, ix, {RV} FROM blend", _x))
def recipe_blend(spark, sf):
    return v6(grid.blend_scenarios(wind_grid(spark, sf), A.recipe_table(spark)))


def aligned(spark, sf):
    rec = A.recipe_table(spark)
    base = grid.blend_scenarios(wind_grid(spark, sf), rec)
    water = grid.blend_scenarios(water_grid(spark, sf), rec)
    return grid.align_to_cells(water, base, ["scenario", *grid.CELL])


@register("align_cells", query(f"SELECT scenario, iy, ix, {RV} FROM aligned", _x))
def align_cells(spark, sf):
    return v6(aligned(spark, sf))


@register("river_ensemble_grid", query(f"""
SELECT scenario, iy, ix, {', '.join(f'{rnd(f"avg({v})", 6)} AS {v}' for v in V)} FROM
(SELECT scenario, member, CAST(round_even(lat,0) AS BIGINT) AS iy, CAST(round_even(lon,0) AS BIGINT) AS ix, {', '.join(f'avg({v}) AS {v}' for v in V)} FROM
 (SELECT scenario, member, centroid_id, {_cat_pivot} FROM ({curve("(SELECT r.scenario, r.member, r.centroid_id, r.event_id, r.depth, c.freq FROM river r JOIN cat c USING (event_id))", "scenario, member, centroid_id", loss="depth")}) GROUP BY 1,2,3)
 JOIN cen USING (centroid_id) WHERE greatest({PV})>1e-6 GROUP BY 1,2,3,4) GROUP BY 1,2,3"""))
def river_ensemble_grid(spark, sf):
    from perilframe.operators import exceedance
    rows = (S.river(spark, sf).join(S.catalog(spark, sf).select("event_id", "freq"), "event_id").withColumnRenamed("depth", "loss"))
    k = ["scenario", "member", "centroid_id"]
    lad = exceedance.interpolated_ladder(exceedance.loss_points(rows, k), k)
    pts = lad.join(S.centroids(spark, sf), "centroid_id").select(*k, "lat", "lon", *[F.get("ladder", F.lit(i)).alias(c) for i, c in enumerate(V)])
    members = grid.thin_to_grid(pts, ["scenario", "member"], CELL, wet_only=True)
    return v6(grid.ensemble_mean(members, ["scenario", *grid.CELL]))


def two_files(spark, sf):
    """Wind grid twice: a first file with every cell, a second that replaces every other source."""
    a = written(wind_grid(spark, sf))  # both files are read from one grid
    return a, a.where(F.col("source").isin("present", "rcp26_2040")).select("source", "ix", "iy", *[(F.col(c) + 1.0).alias(c) for c in V])


@register("merge_last_wins", query(f"""
SELECT source, iy, ix, {', '.join(f"{rnd(f'{v}+CASE WHEN source IN (' + chr(39) + 'present' + chr(39) + ',' + chr(39) + 'rcp26_2040' + chr(39) + ') THEN 1 ELSE 0 END', 6)} AS {v}" for v in V)} FROM thin""", _x))
def merge_last_wins(spark, sf):
    return v6(keyed.last_wins(list(two_files(spark, sf)), ["source", "ix", "iy"]).select("source", "iy", "ix", *V))


_heat = {"daily": """
SELECT user_id AS cell, event_id%3 AS year, CAST(ts AS DATE) AS date, max(value/20+20) AS tmax FROM events GROUP BY 1,2,3""",
         "deltas": f"SELECT * FROM {values([(k, float(v)) for k, v in A.HEAT_DELTA.items()])} t(scenario, dt)"}


@register("heat_indicators", query(f"""
SELECT cell, scenario, {rnd('sum(CASE WHEN tmax>32-dt THEN 1 ELSE 0 END)/count(DISTINCT year)', 6)} AS days32,
 {rnd('sum(CASE WHEN tmax>35-dt THEN 1 ELSE 0 END)/count(DISTINCT year)', 6)} AS days35,
 {rnd('sum(greatest(tmax-4-(18-dt),0))/count(DISTINCT year)', 4)} AS cdd FROM daily CROSS JOIN deltas GROUP BY 1,2""", _heat))
def heat_indicators(spark, sf):
    return rounded(grid.heat_indicators(S.daily_temp(spark, sf)), {"days32": 6, "days35": 6, "cdd": 4})


_fire = {"det": f"""
SELECT event_id, ((event_id*29)%1300+2400)/{d(100.)} AS latitude, ((event_id*31)%2600-10000)/{d(100.)} AS longitude, CAST(ts AS DATE) AS acq_date,
 CASE WHEN event_id%2=0 THEN 'MODIS' ELSE 'VIIRS' END AS instrument,
 CASE WHEN event_id%2=0 THEN CAST(event_id%101 AS VARCHAR) ELSE ['l','n','h'][event_id%3+1] END AS confidence FROM events""",
         "kept": """SELECT * FROM det WHERE NOT (instrument='MODIS' AND try_cast(confidence AS DOUBLE)<50) AND NOT (instrument='VIIRS' AND confidence='l')""",
         }


def near_sql(km: float) -> str:
    return f"""SELECT * FROM kept k WHERE EXISTS (SELECT 1 FROM sites s WHERE abs(k.latitude-s.latitude)<={d(km / 111.0)}
 AND abs(k.longitude-s.longitude)<={d(km)}/(111*greatest(cos(radians(s.latitude)),{d(0.1)})))"""


_fire["near"] = near_sql(75.0)


@register("fire_context", query("""
SELECT 'historical_fire_context' AS kind, CAST(round_even(latitude/0.25,0) AS BIGINT) AS iy, CAST(round_even(longitude/0.25,0) AS BIGINT) AS ix,
 count(*) AS detections, CAST(min(year(acq_date)) AS BIGINT) AS first_year, CAST(max(year(acq_date)) AS BIGINT) AS last_year FROM near GROUP BY 1,2,3
""".replace("0.25", d(0.25)), _fire))
def fire_context(spark, sf):
    return grid.fire_context(S.detections(spark, sf), S.sites(spark, sf))


@register("fire_near_sites", query("SELECT event_id AS detection_id FROM near", {**_fire, "near": near_sql(5.0)}))
def fire_near_sites(spark, sf):
    rows = grid.confident(S.detections(spark, sf))
    return near_any_site(rows, S.sites(spark, sf), 5.0).select("detection_id")


_ras = f"""
SELECT k.site_key, r.bp IS NOT NULL AS fire_covered, coalesce(least(greatest(r.bp,0),1),0) AS bp,
 CASE WHEN cfl IS NULL THEN {d(.35)} WHEN cfl<=2 THEN {d(.02)} WHEN cfl<=4 THEN {d(.1)} WHEN cfl<=8 THEN {d(.3)} WHEN cfl<=12 THEN {d(.55)} ELSE {d(.8)} END AS cond,
 cfl IS NULL AS cond_interim FROM sites k JOIN site_cell m USING (site_key) JOIN raster r USING (centroid_id)"""


def fire_points(spark, sf):
    from .context import impact
    return grid.fire_at_points(impact(spark, sf).site_map.where("covered"), S.raster(spark, sf))


@register("raster_at_sites", query(f"SELECT site_key, fire_covered, {rnd('bp', 6)} AS bp, cond, cond_interim FROM rast", {"rast": _ras}))
def raster_at_sites(spark, sf):
    return fire_points(spark, sf).select("site_key", "fire_covered", r("bp", 6).alias("bp"), "cond", "cond_interim")


@register("wildfire_grid", query(f"""
SELECT round_even(latitude,4) AS lat, round_even(longitude,4) AS lon, sc.scenario, 'wfire' AS hazard,
 {rnd('least(bp*fire_k,1)*100', 4)} AS v10, {rnd('cond*100', 1)} AS v25
FROM (SELECT r.*, latitude, longitude FROM rast r JOIN sites USING (site_key) QUALIFY row_number() OVER (PARTITION BY latitude, longitude ORDER BY site_key)=1), scen sc""", {"rast": _ras}))
def wildfire_grid(spark, sf):
    pts = fire_points(spark, sf)
    return grid.fire_rows(pts).select("lat", "lon", "scenario", "hazard", r("v10", 4).alias("v10"), r("v25", 1).alias("v25"))


@register("rain_grid", query(f"""
SELECT iy, ix, scenario, {', '.join(f'round_even({v}*rain_k, 1) AS {v}' for v in V)} FROM
(SELECT CAST(round_even(lat,0) AS BIGINT) AS iy, CAST(round_even(lon,0) AS BIGINT) AS ix, {', '.join(f'avg({v}) AS {v}' for v in V)} FROM
 (SELECT c.centroid_id, any_value(c.lat) AS lat, any_value(c.lon) AS lon, {_cat_pivot} FROM cen c LEFT JOIN ({curve("(SELECT r.centroid_id, r.event_id, r.mm, c.freq FROM rain r JOIN cat c USING (event_id))", "centroid_id", loss="mm")}) x ON x.centroid_id=c.centroid_id
  WHERE c.lat BETWEEN 23 AND 38 AND c.lon BETWEEN -101 AND -73.5 GROUP BY 1) GROUP BY 1,2), scen"""))
def rain_grid(spark, sf):
    cen = S.centroids(spark, sf).where(geo.domain_covers(A.RAIN_DOMAINS[0], F.col("lat"), F.col("lon")))
    cat = S.catalog(spark, sf).where(F.col("source") == "present")
    vec = grid.centroid_intensity(S.rain(spark, sf).withColumnRenamed("mm", "intensity"), cat, cen)
    present = grid.cell_centre(grid.thin_to_grid(vec, ["source"], CELL), CELL)
    out = grid.rain_rows(present)
    return out.select(F.col("lat").cast("long").alias("iy"), F.col("lon").cast("long").alias("ix"), "scenario", *[r(v, 1).alias(v) for v in V])


@register("site_regions", query(f"""
SELECT site_key, {box('latitude', 'longitude', A.PORTFOLIO_BOXES, 'NULL')} AS region, r.region AS sea_level_region
FROM sites JOIN site_region r USING (site_key)"""))
def site_regions(spark, sf):
    lat, lon = F.col("latitude"), F.col("longitude")
    return S.sites(spark, sf).select("site_key", geo.region_of(lat, lon).alias("region"), geo.sea_level_region(lat, lon).alias("sea_level_region"))


@register("slr_by_region", query(f"""
SELECT r.region, s.scenario, count(*) AS sites, {rnd('max(s.slr)', 2)} AS slr_m FROM site_region r JOIN
{values([(a, k, float(v)) for a, t in A.SEA_LEVEL.items() for k, v in t.items()])} s(region, scenario, slr) ON s.region=r.region GROUP BY 1,2"""))
def slr_by_region(spark, sf):
    rows = A.each_scenario(S.sites(spark, sf).select(geo.sea_level_region(F.col("latitude"), F.col("longitude")).alias("region")))
    return rows.groupBy("region", "scenario").agg(F.count("*").alias("sites"),
                                                  r(F.max(A.sea_level_of(F.col("scenario"), F.col("region"))), 2).alias("slr_m"))


@register("rain_domains_used", query("SELECT 'conus' AS domain, count(*) AS sites FROM sites WHERE latitude BETWEEN 23 AND 38 AND longitude BETWEEN -101 AND -73.5 HAVING count(*)>0 "
                                     "UNION ALL SELECT 'hawaii', count(*) FROM sites WHERE latitude BETWEEN 17.5 AND 23.5 AND longitude BETWEEN -161.5 AND -153.5 HAVING count(*)>0"))
def rain_domains_used(spark, sf):
    lat, lon = F.col("latitude"), F.col("longitude")
    hits = F.array_compact(F.array(*[F.when(geo.domain_covers(x, lat, lon), x[0]) for x in A.RAIN_DOMAINS]))
    return S.sites(spark, sf).select(F.explode(hits).alias("domain")).groupBy("domain").agg(F.count("*").alias("sites"))


@register("coverage_pivot", query("""
SELECT scenario, """ + ", ".join(f"CAST(sum(CASE WHEN hazard='{h}' THEN n ELSE 0 END) AS BIGINT) AS {h}" for h in A.HAZARDS) + f""" FROM
(SELECT sc.scenario, h.hazard, count(*) AS n FROM ucen, scen sc, {values([(h,) for h in A.HAZARDS])} h(hazard)
 WHERE hazard='tc' OR hazard='heat' OR (hazard='cflood' AND centroid_id%2=0) OR (hazard='rflood' AND centroid_id%3=0) OR (hazard='wfire' AND centroid_id%4=0)
  OR (hazard='prain' AND sc.scenario='present') GROUP BY 1,2) GROUP BY 1"""))
def coverage_pivot(spark, sf):
    return gates.coverage_pivot(S.hazard_grid(spark, sf))


_west, _north, _dx, _dy = S.DEM_FRAME
_at = lambda lat, lon: f"CAST(floor(({d(_north)}-{lat}-{d(0.0)})/{d(_dy)}) AS BIGINT) AS iy, CAST(floor(({lon}-{d(_west)})/{d(_dx)}) AS BIGINT) AS ix"
_dem = {"dem0": f"SELECT iy, ix, max(v) AS v FROM (SELECT {_at('lat', 'lon')}, CASE WHEN centroid_id%13=0 THEN {d(S.DEM_NODATA)} ELSE p_size/{d(2.0)}-4 END AS v FROM cen) GROUP BY 1,2",
        "dem": f"SELECT * FROM dem0 WHERE v<>{d(S.DEM_NODATA)}",
        "sgnd": f"SELECT s.site_key, s.hy, s.hx, round_even(e.v,1) AS ground FROM (SELECT site_key, {_at('latitude', 'longitude')}, CAST(round_even(latitude/{d(DEG)},0) AS BIGINT) AS hy, CAST(round_even(longitude/{d(DEG)},0) AS BIGINT) AS hx FROM sites) s LEFT JOIN dem e USING (iy, ix)",
        "spots": f"SELECT hy, hx, {_at(f'(hy*{d(DEG)}+(j-{d(2.0)})/{d(5.0)}*{d(DEG)})', f'(hx*{d(DEG)}+(i-{d(2.0)})/{d(5.0)}*{d(DEG)})')} FROM (SELECT DISTINCT hy, hx FROM sgnd), range(5) a(j), range(5) b(i)",
        "cgnd": "SELECT hy, hx, round_even(avg(v) FILTER (WHERE v>=0),1) AS cell FROM spots LEFT JOIN dem USING (iy, ix) GROUP BY 1,2"}


@register("raster_ground", query(f"""
SELECT site_key, ground AS ground_elev_m, cell AS cell_ground_elev_m, {rnd('CASE WHEN ground IS NOT NULL AND cell IS NOT NULL THEN least(greatest(ground-cell,-10),10) END', 1)} AS relief_m FROM sgnd JOIN cgnd USING (hy, hx)""", _dem))
def raster_ground(spark, sf):
    """Ground at each site and over its hazard cell from an elevation raster, and the relief between them."""
    df = grid.ground_from_raster(S.sites(spark, sf), S.dem(spark, sf), S.DEM_FRAME, DEG, S.DEM_NODATA)
    return df.withColumn("relief_m", r(geo.relief(F.col("ground_elev_m"), F.col("cell_ground_elev_m"), A.RELIEF_CLAMP_M), 1))


@register("sites_outside_regions", query(f"SELECT site_key, name, latitude, longitude FROM sites WHERE ({box('latitude', 'longitude', A.PORTFOLIO_BOXES, 'NULL')}) IS NULL"))
def sites_outside_regions(spark, sf):
    return scoring.sites_outside_regions(S.sites(spark, sf))
