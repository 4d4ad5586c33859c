"""Scenario, vulnerability and programme constants, plus the small tables built from them.

Every table here has a size fixed by this module (tens of rows), so joining one
with a broadcast hint is bounded whatever the size of the portfolio.
"""

from __future__ import annotations

from decimal import ROUND_HALF_EVEN, Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Scenario keys, return periods, warming and sea-level centrals.
# ---------------------------------------------------------------------------
PATHWAYS = ["ssp126", "ssp245", "ssp585"]
HORIZONS = [2030, 2050, 2080]
SCENARIOS = ["present"] + [f"{p}_{h}" for h in HORIZONS for p in PATHWAYS]
RETURN_PERIODS = [10, 25, 50, 100, 250, 500]
LADDER_RPS = [2, 5, 10, 25, 50, 100, 250, 500]
SITE_RPS = [100, 250]
V_COLS = [f"v{rp}" for rp in RETURN_PERIODS]
ACUTE = ["tc", "cflood", "rflood", "prain", "wfire"]
HAZARDS = ["tc", "cflood", "rflood", "heat", "wfire", "prain"]

WARMING_CENTRAL = {
    ("ssp126", 2030): 0.6, ("ssp126", 2050): 0.9, ("ssp126", 2080): 0.9,
    ("ssp245", 2030): 0.7, ("ssp245", 2050): 1.1, ("ssp245", 2080): 1.8,
    ("ssp585", 2030): 0.8, ("ssp585", 2050): 1.5, ("ssp585", 2080): 3.5,
}
SEA_LEVEL_CENTRAL = {
    ("ssp126", 2030): 0.09, ("ssp126", 2050): 0.19, ("ssp126", 2080): 0.31,
    ("ssp245", 2030): 0.09, ("ssp245", 2050): 0.20, ("ssp245", 2080): 0.37,
    ("ssp585", 2030): 0.10, ("ssp585", 2050): 0.23, ("ssp585", 2080): 0.48,
}
SEA_LEVEL_FACTOR = {
    "gulf": 1.35, "florida_atlantic": 1.15, "caribbean": 1.05,
    "hawaii": 1.00, "global_mean": 1.00,
}
# (name, lat_min, lat_max, lon_min, lon_max); the first matching box wins.
SEA_LEVEL_BOXES = [
    ("gulf", 24.0, 31.5, -100.5, -82.0),
    ("florida_atlantic", 24.0, 37.5, -82.0, -74.0),
    ("hawaii", 18.0, 23.0, -161.0, -154.0),
    ("caribbean", 17.0, 19.5, -68.0, -64.0),
]
PORTFOLIO_BOXES = [
    ("conus_se_gulf", 24.0, 37.5, -100.5, -74.0),
    ("southwest", 32.0, 38.0, -120.0, -110.0),
    ("hawaii", 18.0, 23.0, -161.0, -154.0),
    ("caribbean", 17.0, 19.5, -68.0, -64.0),
]
# (key, country, basin, lon_min, lat_min, lon_max, lat_max)
RAIN_DOMAINS = [
    ("conus", "USA", "NA", -100.5, 23.5, -74.0, 37.5),
    ("hawaii", "USA", "EP", -161.0, 18.0, -154.0, 23.0),
    ("pri", "PRI", "NA", -67.5, 17.7, -65.1, 18.7),
    ("vir", "VIR", "NA", -65.2, 17.6, -64.5, 18.5),
]
RAIN_DOMAIN_MARGIN_DEG = 0.5
MARGIN_FRACTION = 0.15
CONCENTRATION_OF = {"ssp126": "rcp26", "ssp245": "rcp45", "ssp585": "rcp85"}

# ---------------------------------------------------------------------------
# Hazard-to-damage curves.
# ---------------------------------------------------------------------------
V_THRESH, V_HALF = 25.7, 74.7
FREEBOARD_COAST, FREEBOARD_RIVER = 1.1, 0.6
FLOOD_CAP, FLOOD_CAP_ELEVATED = 0.75, 0.5
FIRST_FLOOR_MAX_M, RELIEF_CLAMP_M = 3.0, 10.0
CONSTRUCTION_FACTOR = {"frame": 1.3, "masonry": 1.0, "engineered": 0.75}
ROOF_TYPE_FACTOR = {"shingle": 1.1, "metal": 0.85, "tile": 0.95, "membrane": 0.95}
ROOF_AGE_FACTOR = [(10, 0.9), (20, 1.0)]
ROOF_AGE_OLD = 1.2
OPENING_FACTOR = {"impact": 0.85, "partial": 0.95, "none": 1.05}
REFERENCE_YEAR = 2026
FIRE_ROOF_A, FIRE_DEFENSIBLE, FIRE_DEFENSIBLE_MIN_M = 0.6, 0.7, 30.0
FIRE_UPLIFT_PER_C, FIRE_COND_INTERIM = 0.14, 0.35
FIRE_WUI_PERCENT = {"interface": 0.3, "intermix": 0.6}
FLAME_BANDS_FT = [2.0, 4.0, 8.0, 12.0]
FLAME_RATIOS = [0.02, 0.10, 0.30, 0.55, 0.80]
RAIN_PER_C, RAIN_DRAIN_MM, RAIN_POND, RAIN_FREEBOARD = 0.07, 75.0, 0.55, 0.15
HEAT_LAND_AMPLIFICATION = 1.25
HEAT_HOT_C, HEAT_DANGER_C, COOLING_BASE_C = 32.0, 35.0, 18.0
WIND_UPLIFT_PER_C = 0.02
# archetype -> (half-damage multiplier, freeboard added m, flood cap or None)
ARCHETYPES = {
    "lowrise_timber": (1.0, 0.0, None),
    "lowrise_masonry": (1.08, 0.0, None),
    "midrise_concrete": (1.18, 0.0, None),
    "tower_concrete": (1.30, 0.0, 0.5),
    "beachfront_lowrise": (0.95, -0.3, None),
    "setback_elevated": (1.0, 0.5, None),
    "mep_basement": (1.0, -0.2, 0.9),
    "mep_elevated_plant": (1.0, 0.0, 0.5),
}
SNAP_KM, WATER_SLACK_KM = 200.0, 10.0
SCOPE_USD = 100.0
EVENT_FLOOR_USD = 1000.0
GRID_DEG = 0.25
WET_EPS = 1e-6
FIRE_BUFFER_KM, FIRE_MIN_CONFIDENCE = 75.0, 50
RIVER_PREFERENCE = {
    "present": ["historical", "hist", "None"],
    "ssp126": ["rcp26"],
    "ssp245": ["rcp45", "rcp60"],
    "ssp585": ["rcp85"],
}
RIVER_TARGET_YEAR = {"present": 2000, "2030": 2030, "2050": 2050, "2080": 2080}
RIVER_MAX_MODELS = 4

# ---------------------------------------------------------------------------
# Interim screening models.
# ---------------------------------------------------------------------------
# (lat, lon, 1-in-100 wind m/s, log-return-period slope)
WIND_ANCHORS = [
    (25.8, -80.2, 62.0, 7.5), (24.5, -81.8, 64.0, 7.7), (26.1, -80.1, 61.0, 7.5),
    (30.0, -90.1, 58.0, 7.2), (29.3, -94.8, 56.0, 7.0), (27.0, -82.6, 60.0, 7.4),
    (18.4, -66.1, 62.0, 7.6), (18.3, -64.9, 62.0, 7.6),
    (32.8, -79.9, 52.0, 6.9), (33.7, -78.9, 50.0, 6.8), (35.2, -75.5, 54.0, 7.0),
    (34.2, -77.9, 51.0, 6.8), (30.3, -81.4, 48.0, 6.7),
    (36.8, -76.0, 44.0, 6.4), (40.7, -74.0, 40.0, 6.0), (41.7, -70.3, 42.0, 6.2),
    (21.3, -157.8, 42.0, 5.8), (19.7, -155.1, 46.0, 6.1), (22.1, -159.4, 44.0, 6.0),
    (28.5, -81.4, 41.0, 6.0), (29.4, -98.5, 30.0, 5.2), (30.3, -97.7, 27.0, 5.0),
    (33.7, -84.4, 26.0, 4.8), (39.7, -105.0, 12.0, 3.2),
    (33.8, -116.5, 15.0, 3.6), (36.2, -115.1, 14.0, 3.4), (34.0, -118.2, 14.0, 3.4),
    (37.8, -122.4, 13.0, 3.3),
]
WIND_ANCHOR_SCALE_KM = 380.0
WIND_FALLBACK = (13.0, 3.2)
COAST_ANCHORS = [
    (29.3, -94.8), (29.0, -90.1), (27.8, -82.7), (25.8, -80.1), (29.9, -81.3),
    (32.8, -79.9), (33.7, -78.9), (36.8, -76.0), (18.4, -66.1), (18.3, -64.9),
    (18.0, -63.1), (21.3, -157.9), (19.7, -156.0), (22.1, -159.3), (33.7, -118.2),
    (37.8, -122.5), (32.7, -117.2),
]
SURGE_SHAPE = {10: 0.35, 25: 0.55, 50: 0.78, 100: 1.0, 250: 1.25, 500: 1.45}
RIVER_SHAPE = {10: 0.30, 25: 0.55, 50: 0.80, 100: 1.0, 250: 1.30, 500: 1.55}

# ---------------------------------------------------------------------------
# Finance, insurance programme, appraisal and interruption.
# ---------------------------------------------------------------------------
REVENUE_RATIO, GOP_MARGIN, REOPEN_MONTHS = 0.35, 0.30, 12.0
HEAT_DROP, LOSS_CORRELATION, HEAT_COMFORT_DAYS = 0.12, 0.30, 15.0
TOLERANCE_SITE_BPS, TOLERANCE_PORTFOLIO_PCT, TOLERANCE_VAR_PCT = 75.0, 1.0, 10.0
DISCOUNT_RATE, HORIZON_YEARS = 0.03, 25
GROWTH_PCT, LAYER_ATTACH_RP, LAYER_EXHAUST_RP, PREMIUM_LOAD = 2.0, 25, 250, 1.5
DEDUCTIBLE = {"hurricane": 1_000_000.0, "flood": 100_000.0, "general": 50_000.0}
PERIL_CLASS = {"tc": "hurricane", "cflood": "hurricane", "rflood": "flood",
               "prain": "flood", "wfire": "general"}
CLASS_PERILS = {"flood": ["rflood", "prain"], "general": ["wfire"]}
BI_WAITING_DAYS, BI_INDEMNITY_DAYS = 3.0, 365.0
REBOOK_SHARE, FREQUENT_MIN_FREQ = 0.15, 0.1
SIM_YEARS, SIM_SEED = 1000, 20260709
CREDIT_REALIZATION = 0.5
BI_MONTH_DAYS, BI_MAX_MONTHS = 30.44, 601
BI_STORM_MONTHS = [0.00, 0.00, 0.00, 0.00, 0.00, 0.04, 0.05, 0.30, 0.42, 0.16, 0.03, 0.00]
BI_FLAT_MONTHS = [1.0 / 12.0] * 12
BI_SEASON = {
    "gulf": [1.15, 1.30, 1.35, 1.15, 1.00, 0.95, 1.00, 0.80, 0.60, 0.75, 0.90, 1.05],
    "florida_atlantic": [1.25, 1.45, 1.50, 1.20, 0.90, 0.85, 0.90, 0.70, 0.50, 0.65, 0.85, 1.25],
    "caribbean": [1.40, 1.55, 1.55, 1.25, 0.85, 0.70, 0.85, 0.70, 0.55, 0.60, 0.85, 1.15],
    "hawaii": [1.10, 1.05, 1.00, 0.95, 0.90, 1.10, 1.20, 1.15, 0.80, 0.80, 0.90, 1.05],
    "global_mean": [1.00] * 12,
}
BI_DOWNTIME_NODES = [(0.0, 0.0), (0.02, 0.03), (0.10, 0.09), (0.40, 0.75), (1.0, 1.0)]
BI_IMPEDING_DAYS, BI_IMPEDING_DAMAGE = 120.0, 0.10
BI_TIMESHARE_CONTINUING = 0.65
SHOCK_CAP, SHOCK_GAIN, SHOCK_MONTHS, SHOCK_MIN = 0.6, 1.2, 8.0, 0.02
STORM_TIMED = ["tc_joint", "prain"]
V_HALF_LO, V_HALF_HI = 40.0, 150.0
MC_SAMPLES, MC_SEED = 300, 42
# factor -> (low, high)
MC_FACTORS = {"haz": (0.92, 1.08), "dmg": (0.70, 1.40), "exp": (0.85, 1.15)}
UNCERTAINTY_SCENARIOS = ["present", "ssp245_2050", "ssp585_2080"]
PLAN_YEARS, RENOVATION_SYNERGY = 3, 0.85
PLAN_TOP, PLAN_TOP_PHASED = 20, 40
PLAN_SCENARIOS = ["ssp245_2050", "present"]
YEARS_MODELLED = [2026, 2030, 2050, 2080]


def half_even(x: float, places: int) -> float:
    """Decimal half-even rounding of a registry constant."""
    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-places), ROUND_HALF_EVEN))


def _margin(central: float, horizon: int, places: int) -> float:
    return 0.0 if horizon == 2030 else round(MARGIN_FRACTION * central, places)


WARMING = {"present": 0.0} | {
    f"{p}_{h}": round(c + _margin(c, h, 1), 6) for (p, h), c in WARMING_CENTRAL.items()}
SEA_LEVEL = {
    region: {"present": 0.0} | {
        f"{p}_{h}": round((c + _margin(c, h, 2)) * factor, 2)
        for (p, h), c in SEA_LEVEL_CENTRAL.items()}
    for region, factor in SEA_LEVEL_FACTOR.items()}
HEAT_DELTA = {k: round(w * HEAT_LAND_AMPLIFICATION, 3) for k, w in WARMING.items()}


def recipe_rows() -> list[tuple[str, str, float]]:
    """(scenario, source, weight): each horizon blends the catalogs that bracket it."""
    rows = [("present", "present", 1.0)]
    for ssp, rcp in CONCENTRATION_OF.items():
        rows += [(f"{ssp}_2030", "present", 0.5), (f"{ssp}_2030", f"{rcp}_2040", 0.5),
                 (f"{ssp}_2050", f"{rcp}_2040", 0.5), (f"{ssp}_2050", f"{rcp}_2060", 0.5),
                 (f"{ssp}_2080", f"{rcp}_2080", 1.0)]
    return rows


SOURCES = list(dict.fromkeys(source for _, source, _ in recipe_rows()))


def recipe_table(spark: SparkSession) -> DataFrame:
    """Scenario recipe (19 rows)."""
    return spark.createDataFrame(recipe_rows(), "scenario string, source string, weight double")


def unique_sources(spark: SparkSession) -> DataFrame:
    """Every catalog that any scenario reads, once."""
    return recipe_table(spark).select("source").distinct()


def assumption_table(spark: SparkSession) -> DataFrame:
    """Long registry of warming and sea-level entries: value = (central + margin) * factor."""
    rows = []
    for (p, h), c in WARMING_CENTRAL.items():
        rows.append(("warming", "global", f"{p}_{h}", c, _margin(c, h, 1), 1.0, WARMING[f"{p}_{h}"],
                     "degC above 1995-2014"))
    for region, factor in SEA_LEVEL_FACTOR.items():
        for (p, h), c in SEA_LEVEL_CENTRAL.items():
            rows.append(("sea_level", region, f"{p}_{h}", c, _margin(c, h, 2), factor,
                         SEA_LEVEL[region][f"{p}_{h}"], "m above 1995-2014"))
    return spark.createDataFrame(
        rows, "kind string, region string, scenario string, central double, margin double, "
              "factor double, value double, units string")


def sql_literal(v) -> str:
    """A Python constant as a SQL literal; lists become arrays, tuples of pairs become structs."""
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float):
        return f"{v!r}D"
    if isinstance(v, (list, tuple)):
        return "array(" + ", ".join(sql_literal(x) for x in v) + ")"
    if isinstance(v, dict):
        return "named_struct(" + ", ".join(f"'{k}', {sql_literal(x)}" for k, x in v.items()) + ")"
    return "'" + str(v).replace("'", "''") + "'"


def constant_map(table: dict) -> Column:
    """A small fixed dictionary as one constant map; Spark folds it when it plans the query."""
    return F.expr("map(" + ", ".join(f"{sql_literal(k)}, {sql_literal(v)}" for k, v in table.items()) + ")")


def lookup(key: Column, table: dict, default=None) -> Column:
    """Small fixed dictionary read by a key column."""
    found = F.try_element_at(constant_map(table), key)
    return F.coalesce(found, default if isinstance(default, Column) else F.lit(default))


def warming_of(scenario: Column) -> Column:
    return lookup(scenario, WARMING, 0.0)


def sea_level_of(scenario: Column, region: Column) -> Column:
    """Sea-level rise; an unknown region reads the global mean, an unknown scenario is 0."""
    flat = {f"{r}|{k}": v for r, t in SEA_LEVEL.items() for k, v in t.items()}
    return lookup(F.concat_ws("|", region, scenario), flat, lookup(scenario, SEA_LEVEL["global_mean"], 0.0))


def each_scenario(df: DataFrame, scenarios: list[str] | None = None) -> DataFrame:
    """One row per scenario (at most ten), generated in the task without a join."""
    keys = SCENARIOS if scenarios is None else scenarios
    return df.select("*", F.explode(F.expr(sql_literal(list(keys)))).alias("scenario"))
