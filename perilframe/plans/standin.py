"""The driver's star-schema tables read as domain tables.

Each function is a projection or small aggregation of whole tables: customers stand for sites,
parts for centroids and grid cells, orders for the event catalog, lineitems for event
intensities, events for daily temperatures, claims and fire detections, suppliers for a broker
schedule. Formulas use integer remainders and single double operations only, so that the same
derivation can be written in SQL and agree exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import assumptions as A
from ..functions import geo, profile
from ..operators.keyed import keep_one

NO_SURGE_SOURCE = "rcp26_2060"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(key: Column, modulus: int, values: list) -> Column:
    out = F
    for i, v in enumerate(values):
        if v is not None:
            out = out.when(key % modulus == i, F.lit(v))
    return out.otherwise(F.lit(None))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    value = (F.col("c_acctbal") + 1000.0) * 3333.3391
    far = k % 50 == 49
    when = lambda cond, x: F.when(cond, x)
    return c.select(
        k.alias("site_key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("brand"),
        _pick(F.col("c_nationkey"), 3, ["USA", "PRI", "VIR"]).alias("country"),
        F.when(far, 19.64).otherwise(((k * 37) % 1300 + 2400) / F.lit(100.0)).alias("latitude"),
        F.when(far, -155.99).otherwise(((k * 53) % 2600 - 10000) / F.lit(100.0)).alias("longitude"),
        value.alias("asset_value_usd"),
        when(k % 6 == 0, value * 0.4).alias("annual_revenue_usd"),
        _pick(k, 4, ["frame", "masonry", "engineered", None]).alias("construction"),
        ((k * 7) % 65 + 1960).cast("double").alias("year_built"),
        (k % 5 == 0).alias("defended"),
        _pick(k, 6, ["shingle", "metal", "tile", "membrane", None, None]).alias("roof_type"),
        when(k % 6 < 4, ((k * 3) % 35 + 1990).cast("double")).alias("roof_year"),
        _pick(k, 4, ["impact", "partial", "none", None]).alias("opening_protection"),
        when(k % 9 == 0, (k % 5).cast("double")).alias("first_floor_elev_m"),
        (k % 11 == 0).alias("equipment_elevated"),
        _pick(k, 10, [*A.ARCHETYPES, None, "unlisted_form"]).alias("archetype"),
        when(k % 4 == 1, (k % 30) / F.lit(10.0)).alias("ground_elev_m"),
        when(k % 4 == 1, (k % 20) / F.lit(10.0)).alias("cell_ground_elev_m"),
        (k % 9 + 1).cast("double").alias("stories"), (k % 300 + 50).cast("double").alias("keys"),
        when(k % 7 != 0, F.concat(F.lit("C"), F.floor(k / 6).cast("string"))).alias("campus_code"),
        F.lit(None).cast("string").alias("campus_name"),
        _pick(k, 3, ["HOA", "Operating company", None]).alias("named_insured"),
        when(k % 8 < 2, F.concat(F.lit("P"), F.floor(k / 8).cast("string"))).alias("site_id"),
        when(k % 8 < 2, F.concat(F.lit("Place "), F.floor(k / 8).cast("string"))).alias("site_name"),
        when(k % 4 == 0, value * 0.004).alias("premium_annual_usd"),
        when(k % 5 == 0, value * 0.05).alias("bi_ee_usd"),
        when(k % 9 == 1, F.lit(5000.0)).alias("mitigation_annual_usd"),
        when(k % 10 == 4, F.lit(1.0)).alias("timeshare_share"),
        _pick(k, 8, ["interface", "intermix"]).alias("wui_class"),
        when(k % 8 < 2, (k % 60).cast("double")).alias("defensible_space_m"),
        (k % 7 == 3).alias("roof_class_a"),
        when(k % 13 == 0, (k % 5 + A.REFERENCE_YEAR).cast("double")).alias("renovation_year"),
        _pick(k, 5, ["full", "partial"]).alias("backup_power"))


def site_knobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites with their vulnerability knobs and the finance settings."""
    s = sites(spark, sf_dir)
    revenue = F.when(F.col("annual_revenue_usd") > 0.0, F.col("annual_revenue_usd")).otherwise(
        F.col("asset_value_usd") * A.REVENUE_RATIO)
    return s.select("*", *[c.alias(n) for n, c in profile.knob_columns().items()],
                    revenue.alias("revenue_usd"), F.lit(A.GOP_MARGIN).alias("gop_margin"),
                    F.lit(A.REOPEN_MONTHS).alias("reopen_months"), F.lit(A.HEAT_DROP).alias("heat_drop"))


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("centroid_id"), (((k * 61) % 1300 + 2400) / F.lit(100.0)).alias("lat"),
        (((k * 17) % 2600 - 10000) / F.lit(100.0)).alias("lon"), "p_size")


def source_of(event: Column) -> Column:
    return F.get(F.expr(A.sql_literal(A.SOURCES)), (event % 10).cast("int"))


def scenario_of(event: Column) -> Column:
    return F.get(F.expr(A.sql_literal(A.SCENARIOS)), (event % 10).cast("int"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("event_id"), source_of(k).alias("source"), (F.lit(1.0) / (k % 95 + 5)).alias("freq"),
        F.when(k % 3 == 0, F.concat(F.lit("EV"), k.cast("string"))).alias("event_name"))


def _pairs(spark: SparkSession, sf_dir: str, value: Column, name: str, extra: dict[str, Column], wet: bool = False) -> DataFrame:
    """value, which grows with l_quantity, of the largest quantity per event and centroid; wet: where it is above zero.

    Dry rows go before the largest is taken, so that a semi join on a key can be planned below it.
    """
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("event_id"), F.col("l_partkey").alias("centroid_id"), "l_quantity")
    most = (li.where(value > 0.0) if wet else li).groupBy("event_id", "centroid_id").agg(F.max("l_quantity").alias("l_quantity"))
    return most.select(*[c.alias(n) for n, c in extra.items()], "event_id", "centroid_id", value.alias(name))


def wind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, event_id, centroid_id, intensity (m/s)."""
    return _pairs(spark, sf_dir, F.col("l_quantity") * 1.5 + 20.0, "intensity",
                  {"source": source_of(F.col("event_id"))})


def surge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, event_id, centroid_id, depth (m); one source has no surge at all."""
    df = _pairs(spark, sf_dir, F.greatest(F.col("l_quantity") / 10.0 - 1.0, F.lit(0.0)), "depth",
                {"source": source_of(F.col("event_id"))}, wet=True)
    return df.where(F.col("source") != NO_SURGE_SOURCE)


def rain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Present-day rainfall events: source, event_id, centroid_id, mm."""
    df = _pairs(spark, sf_dir, F.col("l_quantity") * 24.3271, "mm", {"source": source_of(F.col("event_id"))})
    return df.where(F.col("source") == "present")


def river(spark: SparkSession, sf_dir: str) -> DataFrame:
    """River-flood ensemble: scenario, member, event_id, centroid_id, depth."""
    return _pairs(spark, sf_dir, F.greatest(F.col("l_quantity") / 8.0 - 2.5, F.lit(0.0)), "depth",
                  {"scenario": scenario_of(F.col("event_id")), "member": member_of(F.col("event_id"))}, wet=True)


def river_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scenario and member of each row that counts for river(), without the largest of each event and centroid."""
    k = F.col("l_orderkey")
    wet = table(spark, sf_dir, "lineitem").where(F.col("l_quantity") / 8.0 - 2.5 > 0.0)
    return wet.select(scenario_of(k).alias("scenario"), member_of(k).alias("member"))


def member_of(event: Column) -> Column:
    return F.concat(F.lit("m"), (F.floor(event / 10) % 2).cast("string"))


DEM_FRAME = (-100.0, 37.0, 0.25, 0.25)  # west, north, cell width and height
DEM_NODATA = -9999.0


def dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground elevation raster: iy from the north, ix from the west, value in metres with sea floor and cells without data."""
    west, north, dx, dy = DEM_FRAME
    c = centroids(spark, sf_dir)
    value = F.when(F.col("centroid_id") % 13 == 0, DEM_NODATA).otherwise(F.col("p_size") / F.lit(2.0) - 4.0)
    return c.groupBy(geo.raster_index(F.lit(north) - F.col("lat"), 0.0, dy).alias("iy"), geo.raster_index(F.col("lon"), west, dx).alias("ix")).agg(F.max(value).alias("value"))


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("centroid_id"), F.when(k % 11 != 0, F.col("p_size") / 7000.0).alias("bp"),
        F.when(k % 5 != 0, F.col("p_size") / 4.0).alias("cfl"))


# Fixed values of the stand-in hazard grid: additions per return period.
GRID_WIND_STEP = [0.0, 6.0, 11.0, 16.0, 22.0, 26.0]
GRID_DEPTH_STEP = [0.0, 0.4, 0.8, 1.2, 1.6, 2.0]
GRID_RAIN_STEP = [0.0, 40.0, 80.0, 120.0, 180.0, 230.0]


def grid_layers(scenarios: list[str] | None = None) -> dict[str, list[str]]:
    """The stand-in grid's sidecar: scenarios per hazard."""
    keys = scenarios or A.SCENARIOS
    return {h: (["present"] if h == "prain" else list(keys)) for h in A.HAZARDS}


def hazard_grid(spark: SparkSession, sf_dir: str, scenarios: list[str] | None = None) -> DataFrame:
    """lat, lon, scenario, hazard, v10..v500. Rain has the present scenario only."""
    cells = keep_one(centroids(spark, sf_dir), ["lat", "lon"], "centroid_id")
    cells = cells.withColumn("size", F.col("p_size").cast("double"))
    rows = A.each_scenario(cells, scenarios or A.SCENARIOS)
    rows = rows.withColumn("hazard", F.explode(F.expr(A.sql_literal(A.HAZARDS))))
    h, k, size = F.col("hazard"), F.col("centroid_id"), F.col("size")
    has = ((h == "tc") | ((h == "cflood") & (k % 2 == 0)) | ((h == "rflood") & (k % 3 == 0)) | (h == "heat")
           | ((h == "wfire") & (k % 4 == 0)) | ((h == "prain") & (F.col("scenario") == "present")))
    rows = rows.where(has).withColumn("w", A.warming_of(F.col("scenario")))
    w = F.col("w")
    cols = []
    for i, name in enumerate(A.V_COLS):
        wet = F.greatest(size / 10.0 - 2.0 + GRID_DEPTH_STEP[i], F.lit(0.0))
        river = F.greatest(size / 12.5 - 2.0 + GRID_DEPTH_STEP[i], F.lit(0.0))
        heat = [size * 3.0 + w * 10.0, size * 1.5 + w * 6.0, size * 50.0 + 1000.0] + [F.lit(0.0)] * 3
        fire = [size / 25.0 * (w * 0.14 + 1.0),
                F.when(F.col("p_size") % 5 == 0, 0.0).otherwise(size)] + [F.lit(0.0)] * 4
        cols.append(F.when(h == "tc", (size * 0.5 + 18.0 + GRID_WIND_STEP[i]) * (w * 0.02 + 1.0))
                    .when(h == "cflood", F.when(wet > 0.0, wet + w * 0.1).otherwise(0.0))
                    .when(h == "rflood", river * (w * 0.05 + 1.0))
                    .when(h == "heat", heat[i]).when(h == "wfire", fire[i])
                    .otherwise(size * 8.0 + GRID_RAIN_STEP[i]).alias(name))
    return rows.select("lat", "lon", "scenario", "hazard", *cols)


def daily_temp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, year, date, tmax, tmean."""
    e = table(spark, sf_dir, "events")
    day = e.groupBy(F.col("user_id").alias("cell"), (F.col("event_id") % 3).alias("year"),
                    F.col("ts").cast("date").alias("date")).agg(F.max(F.col("value") / 20.0 + 20.0).alias("tmax"))
    return day.withColumn("tmean", F.col("tmax") - 4.0)


def _customer_name(key: Column) -> Column:
    return F.concat(F.lit("Customer#"), F.lpad(key.cast("string"), 9, "0"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    u, k = F.col("user_id"), F.col("event_id")
    name = (F.when(u % 13 == 0, "Mystery Villas")
            .when(u % 13 == 1, F.concat(_customer_name(u * 10), F.lit(" Annex Tower")))
            .otherwise(_customer_name(u * 10)))
    cover = {"signup": "Named Storm - Wind", "error": "Flood", "click": "Business Interruption",
             "view": "Fire", "purchase": "Crime"}
    paid = F.col("value") * 100.0
    return e.select(
        k.cast("string").alias("claim_no"), F.col("ts").cast("date").alias("date_of_loss"),
        F.year(F.col("ts").cast("date")).alias("year"),
        name.alias("claimant"), A.lookup(F.col("event_type"), cover).alias("coverage"),
        paid.alias("net_paid"), F.when(k % 5 == 0, paid * 0.5).otherwise(0.0).alias("net_outstanding"),
        F.lit(0.0).alias("recovery"),
        (paid + F.when(k % 5 == 0, paid * 0.5).otherwise(0.0)).alias("net_incurred"),
        (k % 5 == 0).alias("open"),
        F.when(k % 97 == 0, "Hurricane Zeta").alias("description"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    letter = F.get(F.array(F.lit("l"), F.lit("n"), F.lit("h")), (k % 3).cast("int"))
    return table(spark, sf_dir, "events").select(
        k.alias("detection_id"), (((k * 29) % 1300 + 2400) / F.lit(100.0)).alias("latitude"),
        (((k * 31) % 2600 - 10000) / F.lit(100.0)).alias("longitude"), F.col("ts").cast("date").alias("acq_date"),
        F.when(k % 2 == 0, "MODIS").otherwise("VIIRS").alias("instrument"),
        F.when(k % 2 == 0, (k % 101).cast("string")).otherwise(letter).alias("confidence"))


def sov(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("row_no"), F.concat(F.lit("The "), _customer_name(k * 3), F.lit(" Resort")).alias("name"),
        F.when(k % 17 == 0, F.concat(F.lit("P"), F.floor(k * 3 / 8).cast("string"))).alias("site_id"),
        ((F.col("s_acctbal") + 1000.0) * 12000.0).alias("tiv"),
        F.concat(F.lit("S"), F.col("s_nationkey").cast("string")).alias("campus_code"),
        F.when(k % 4 == 0, "Timeshare resort").otherwise("Hotel").alias("occupancy"),
        F.when(k % 3 == 0, "Joisted Masonry").when(k % 3 == 1, "Fire Resistive").alias("construction_text"),
        F.when(k % 2 == 0, F.lit(50000.0)).alias("premium"))


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed annual losses, a row for each customer."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("row_no"), F.col("c_name").alias("name"),
                    ((F.col("c_acctbal") + 1000.0) * 20.0).alias("observed_annual_loss_usd"))
