"""Column specs, header aliases and header-only routing of third-party files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Header aliases of claims reports and broker schedules.
CLAIM_ALIASES = {
    "claim_no": ["claim number", "claim no", "claim #", "claim", "claimnumber"],
    "date_of_loss": ["date of loss", "loss date", "dol", "date"],
    "claimant": ["claimant name", "claimant", "insured location", "location name", "site"],
    "coverage": ["coverage major", "coverage", "coverage line", "line", "peril"],
    "status": ["status", "claim status"],
    "carrier": ["tpa/carrier", "carrier", "tpa"],
    "net_paid": ["net paid", "paid", "net paid amount"],
    "net_outstanding": ["net outstanding", "outstanding", "reserves", "net outstanding amount"],
    "recovery": ["recovery received", "recovery", "recoveries"],
    "net_incurred": ["net incurred", "incurred", "net incurred amount", "total incurred"],
    "area": ["area of impact", "area", "impact area"],
    "description": ["event description", "description", "loss description", "cause"],
}
SCHEDULE_ALIASES = {
    "site_id": ["site id", "location id", "loc id", "location number", "location no", "loc #", "location #", "site #", "site no", "bldg id", "location code"],
    "name": ["location name", "property name", "site name", "insured location", "location description", "property", "location"],
    "named_insured": ["named insured", "insured", "insured name", "entity"],
    "campus_code": ["campus code", "campus id", "campus #", "campus no"],
    "campus_name": ["campus name", "campus"],
    "owned_or_leased": ["owned/leased", "owned or leased", "tenure", "ownership", "own/lease", "owned leased"],
    "latitude": ["latitude", "lat"],
    "longitude": ["longitude", "lon", "lng", "long"],
    "tiv": ["total insured value", "tiv", "total tiv", "total values", "total value", "total insured values"],
    "building": ["building value", "building", "real property", "building limit", "building values"],
    "contents": ["contents", "contents value", "personal property", "bpp", "content value"],
    "bi_ee": ["bi/ee", "bi & ee", "bi and ee", "bi ee", "business interruption", "business income", "bi value", "time element", "bi/ee value", "bi & ee value"],
    "premium": ["annual premium", "premium", "allocated premium", "premium allocation", "total premium", "property premium"],
    "occupancy": ["occupancy", "occupancy type", "use", "property type", "occupancy description"],
    "year_built": ["year built", "yr built", "year of construction", "construction year"],
    "construction_text": ["construction", "construction type", "construction class", "iso construction"],
}
SITE_TEXT = ["construction", "roof_type", "opening_protection", "fema_zone", "backup_power", "wui_class", "archetype", "named_insured",
             "site_id", "site_name", "campus_code", "campus_name", "owned_or_leased", "brand"]
SITE_NUMBERS = ["annual_revenue_usd", "year_built", "roof_year", "first_floor_elev_m", "stories", "keys", "buildings", "renovation_year",
                "defensible_space_m", "ground_elev_m", "cell_ground_elev_m", "bi_ee_usd", "premium_annual_usd", "mitigation_annual_usd", "timeshare_share"]
SITE_FLAGS = ["defended", "equipment_elevated", "roof_class_a"]
SITE_REQUIRED = ["name", "latitude", "longitude", "asset_value_usd"]


def lower_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower() for c in df.columns])


def header_map(columns: list[str], aliases: dict[str, list[str]]) -> dict[str, str]:
    """Canonical name -> first alias present in the (lower-cased, trimmed) headers."""
    have = {c.strip().lower() for c in columns}
    found = {k: next((a for a in names if a in have), None) for k, names in aliases.items()}
    return {k: v for k, v in found.items() if v}


def rename_by_alias(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Canonical columns found under any alias; everything else is dropped."""
    low = lower_headers(df)
    return low.select(*[F.col(f"`{a}`").alias(k) for k, a in header_map(low.columns, aliases).items()])


def enforce_schema(df: DataFrame, spec: dict[str, str]) -> DataFrame:
    """Cast known columns and add the missing ones as null; extra columns stay."""
    have = set(df.columns)
    cols = [F.col(c).try_cast(t).alias(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in spec.items()]
    return df.select(*cols, *[c for c in df.columns if c not in spec])


def require(df: DataFrame, columns: list[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def classify_columns(columns: list[str]) -> str:
    """Dataset kind from headers only: sites, hazard_grid, claims, schedule, observed or unknown."""
    head = {c.strip().lower() for c in columns}
    line = ",".join(head)
    if "claim" in line and ("incurred" in line or "coverage" in line):
        return "claims"
    if "asset_value_usd" in head:
        return "sites"
    if {"lat", "lon", "scenario"} <= head:
        return "hazard_grid"
    if {"name", "observed_annual_loss_usd"} <= head:
        return "observed"
    found = header_map(list(head), SCHEDULE_ALIASES)
    marks = [k for k in ("tiv", "building", "campus_code", "campus_name", "named_insured", "premium", "bi_ee", "owned_or_leased") if k in found]
    return "schedule" if "tiv" in found or len(marks) >= 2 else "unknown"
