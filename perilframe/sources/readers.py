"""Scans. Readers return lazy DataFrames; validation splits rows instead of dropping them silently."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import assumptions as A
from .. import schemas as S
from ..functions import text
from ..functions.common import blank_to_null, finite_or_null
from ..functions.profile import truthy
from ..operators.keyed import keep_one, last_wins


def read_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Headered CSV, every column as text; no inference pass over the data."""
    return spark.read.option("header", True).option("escape", '"').csv(path)


def _optional(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select("*", *[F.lit(None).cast("string").alias(c) for c in names if c not in df.columns])


def load_sites(df: DataFrame) -> DataFrame:
    """Site table with the pipeline's rules: required columns, country default, lenient flags."""
    df = S.lower_headers(df)
    S.require(df, S.SITE_REQUIRED)
    df = _optional(df, ["country", *S.SITE_TEXT, *S.SITE_NUMBERS, *S.SITE_FLAGS])
    num = lambda c: finite_or_null(F.col(c).try_cast("double")).alias(c)
    return df.select("name", F.upper(F.coalesce("country", F.lit("USA"))).alias("country"),
                     *[num(c) for c in ("latitude", "longitude", "asset_value_usd")], *S.SITE_TEXT,
                     *[num(c) for c in S.SITE_NUMBERS], *[truthy(F.col(c)).alias(c) for c in S.SITE_FLAGS])


def _in_vocabulary(c: str, words) -> Column:
    t = F.lower(F.trim(F.col(c)))
    return F.when(t.isin(*words), t)


def intake_sites(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Validating intake: (sites, rejected rows with a reason). Optional values outside their
    vocabulary or range become null."""
    df = S.lower_headers(df)
    S.require(df, S.SITE_REQUIRED)
    df = _optional(df, ["country", *S.SITE_TEXT, *S.SITE_NUMBERS, *S.SITE_FLAGS])
    n = lambda c: text.number_of(F.col(c))
    df = df.withColumn("_lat", n("latitude")).withColumn("_lon", n("longitude")).withColumn("_val", n("asset_value_usd"))
    reason = (F.when(F.col("_lat").isNull() | ~F.col("_lat").between(-90, 90), "latitude")
              .when(F.col("_lon").isNull() | ~F.col("_lon").between(-180, 180), "longitude")
              .when(F.col("_val").isNull() | (F.col("_val") < 0.0), "asset value"))
    df = df.withColumn("reason", reason)
    between = lambda c, lo, hi: F.when((n(c) > lo) & (n(c) < hi), n(c))
    floor0 = lambda c: F.when(n(c) >= 0.0, n(c))
    full = lambda c: blank_to_null(F.col(c))  # whole texts: two long ids that share a prefix stay two
    flag = lambda c: F.when(blank_to_null(F.col(c)).isNotNull(), truthy(F.col(c)))
    good = df.where(F.col("reason").isNull()).select(
        F.coalesce(full("name"), F.lit("Site")).alias("name"), full("brand").alias("brand"), full("country").alias("country"),
        F.col("_lat").alias("latitude"), F.col("_lon").alias("longitude"), F.col("_val").alias("asset_value_usd"), floor0("annual_revenue_usd").alias("annual_revenue_usd"),
        _in_vocabulary("construction", A.CONSTRUCTION_FACTOR).alias("construction"), F.round(between("year_built", 1800, 2100)).alias("year_built"), flag("defended").alias("defended"),
        _in_vocabulary("roof_type", A.ROOF_TYPE_FACTOR).alias("roof_type"), F.round(between("roof_year", 1800, 2100)).alias("roof_year"),
        _in_vocabulary("opening_protection", A.OPENING_FACTOR).alias("opening_protection"), floor0("first_floor_elev_m").alias("first_floor_elev_m"),
        flag("equipment_elevated").alias("equipment_elevated"), _in_vocabulary("wui_class", [*A.FIRE_WUI_PERCENT, "none"]).alias("wui_class"),
        floor0("defensible_space_m").alias("defensible_space_m"), _in_vocabulary("archetype", A.ARCHETYPES).alias("archetype"),
        between("ground_elev_m", -500, 9000).alias("ground_elev_m"), between("cell_ground_elev_m", -500, 9000).alias("cell_ground_elev_m"), flag("roof_class_a").alias("roof_class_a"),
        full("named_insured").alias("named_insured"), full("site_id").alias("site_id"), full("site_name").alias("site_name"), full("campus_code").alias("campus_code"),
        full("campus_name").alias("campus_name"), _in_vocabulary("owned_or_leased", ["owned", "leased"]).alias("owned_or_leased"), floor0("bi_ee_usd").alias("bi_ee_usd"),
        floor0("premium_annual_usd").alias("premium_annual_usd"), floor0("mitigation_annual_usd").alias("mitigation_annual_usd"),
        F.when(n("timeshare_share").between(0.0, 1.0), n("timeshare_share")).alias("timeshare_share"))
    return good, df.where(F.col("reason").isNotNull()).select(*S.SITE_REQUIRED, "reason")


def site_points(df: DataFrame) -> DataFrame:
    """name, latitude, longitude of rows with usable coordinates; a missing name stays null for the caller to number."""
    df = _optional(S.lower_headers(df), ["name"])
    S.require(df, ["latitude", "longitude"])
    out = df.select("name", *[finite_or_null(F.col(c).try_cast("double")).alias(c) for c in ("latitude", "longitude")])
    return out.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())


def load_grid(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Hazard grid rows: hazard defaults to tc, unreadable intensities to 0, rows without a key drop. Columns in keep stay."""
    df = S.lower_headers(df)
    S.require(df, ["lat", "lon", "scenario"])
    df = _optional(df, ["hazard", *A.V_COLS])
    out = df.select(text.number_of(F.col("lat")).alias("lat"), text.number_of(F.col("lon")).alias("lon"), blank_to_null(F.col("scenario")).alias("scenario"),
                    F.coalesce(blank_to_null(F.col("hazard")), F.lit("tc")).alias("hazard"), *[F.coalesce(text.number_of(F.col(c)), F.lit(0.0)).alias(c) for c in A.V_COLS], *keep)
    return out.where(F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("scenario").isNotNull())


def load_grids(frames: list[DataFrame], within: str | None = None) -> tuple[DataFrame, int]:
    """Several grids merged, the later file winning per cell, scenario and hazard; files without the schema are counted.

    Within a file the row with the largest `within` (lower-case column of row numbers) wins; without it, any of them.
    """
    good = [f for f in frames if {"lat", "lon", "scenario"} <= {c.strip().lower() for c in f.columns}]
    merged = last_wins([load_grid(f, (within,) if within else ()) for f in good], ["lat", "lon", "scenario", "hazard"], within)
    return merged.drop(within) if within else merged, len(frames) - len(good)


def load_claims(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims report: (claims, skipped rows). Incurred is derived when absent; a mismatch is flagged."""
    df = S.rename_by_alias(df, S.CLAIM_ALIASES)
    S.require(df, ["date_of_loss", "claimant", "coverage"])
    if not {"net_incurred", "net_paid"} & set(df.columns):
        raise ValueError("missing required columns: ['net_incurred']")
    df = _optional(df, [c for c in S.CLAIM_ALIASES if c not in df.columns])
    m = lambda c: text.money_of(F.col(c))
    z = lambda c: F.coalesce(m(c), F.lit(0.0))
    derived = z("net_paid") + z("net_outstanding") - z("recovery")
    inc = F.coalesce(m("net_incurred"), F.when(m("net_paid").isNotNull(), derived))
    day = text.date_of(F.col("date_of_loss"))
    both = m("net_incurred").isNotNull() & m("net_paid").isNotNull() & m("net_outstanding").isNotNull()
    off = both & (F.abs(m("net_incurred") - derived) > F.greatest(F.lit(1.0), F.abs(m("net_incurred")) * 0.02))
    t = lambda c: F.trim(F.coalesce(c, F.lit("")))
    out = df.select(
        t("claim_no").alias("claim_no"), day.alias("date_of_loss"), F.year(day).alias("year"), t("claimant").alias("claimant"), t("coverage").alias("coverage"),
        F.coalesce(F.lower("status").rlike("open|pend"), F.lit(False)).alias("open"), t("carrier").alias("carrier"), m("net_paid").alias("net_paid"),
        m("net_outstanding").alias("net_outstanding"), m("recovery").alias("recovery"), inc.alias("net_incurred"),
        F.when(m("net_incurred").isNotNull(), "reported").otherwise("derived").alias("incurred_basis"), off.alias("basis_mismatch"),
        t("area").alias("area"), t("description").alias("description"))
    usable = F.col("date_of_loss").isNotNull() & F.col("net_incurred").isNotNull()
    return out.where(usable), out.where(~usable)


def load_schedule(df: DataFrame) -> DataFrame:
    """Broker schedule under canonical names; rows need a name or a site id."""
    out = S.rename_by_alias(df, S.SCHEDULE_ALIASES)
    if not {"name", "site_id"} & set(out.columns):
        raise ValueError("a schedule needs a location name or id column")
    out = _optional(out, ["name", "site_id"])
    return out.where(blank_to_null(F.col("name")).isNotNull() | blank_to_null(F.col("site_id")).isNotNull())


def load_observed(df: DataFrame, order: str | None = None) -> DataFrame:
    """Observed annual losses, non-negative; the first row per name wins when an order is given."""
    S.require(df, ["name", "observed_annual_loss_usd"])
    keep = [order] if order else []
    out = df.select(*keep, F.trim("name").alias("name"), text.number_of(F.col("observed_annual_loss_usd")).alias("observed_annual_loss_usd"))
    out = out.where((F.col("name") != "") & (F.col("observed_annual_loss_usd") >= 0.0))
    return keep_one(out, ["name"], order) if order else out


def load_detections(frames: list[DataFrame]) -> DataFrame:
    """Fire-detection archives of mixed instruments, unioned by header; rows without coordinates drop."""
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [S.lower_headers(f) for f in frames])
    S.require(df, ["latitude", "longitude", "acq_date", "instrument", "confidence"])
    if not {"brightness", "bright_ti4"} & set(df.columns):
        raise ValueError("missing required columns: ['brightness' or 'bright_ti4']")
    out = df.withColumns({c: finite_or_null(F.col(c).try_cast("double")) for c in ("latitude", "longitude")})
    return out.withColumn("acq_date", F.col("acq_date").try_cast("date")).where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())


def read_sidecar(spark: SparkSession, path: str) -> DataFrame:
    """Provenance layers (hazard, scenario, cells) of a single or combined sidecar."""
    meta = spark.read.option("multiLine", True).json(path)
    return meta.select(F.explode("layers").alias("_l")).select("_l.*")


def read_pack(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Results pack as written by write_pack: per-site and portfolio tables."""
    return {"per_site": spark.read.json(f"{path}/per_site"), "portfolio": spark.read.json(f"{path}/portfolio")}


def read_pack_document(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A nested results-pack document exploded to tables; one of another kind or version is refused."""
    doc = spark.read.option("multiLine", True).json(path)
    if not {"kind", "pack_version", "scenarios"} <= set(doc.columns):
        raise ValueError("not a results pack")
    if not doc.where(~((F.col("kind") == "results_pack") & (F.col("pack_version") == 1)).eqNullSafe(True)).isEmpty():
        raise ValueError("not a results pack of version 1")
    keys = doc.schema["scenarios"].dataType.names
    per = [doc.select(F.lit(k).alias("scenario"), F.col(f"scenarios.{k}.per_site").alias("_s"), F.to_json(f"scenarios.{k}.portfolio").alias("portfolio")) for k in keys]
    rows = reduce(lambda a, b: a.unionByName(b), per)
    return {"per_site": rows.select("scenario", F.posexplode("_s").alias("site_index", "site")).select("scenario", "site_index", "site.*"),
            "portfolio": rows.select("scenario", "portfolio")}


def daily_means(df: DataFrame) -> DataFrame:
    """Daily table with tmean as the mean of tmax and tmin; NaN becomes null."""
    hi, lo = finite_or_null(F.col("tmax")), finite_or_null(F.col("tmin"))
    return df.withColumn("tmax", hi).withColumn("tmean", (hi + lo) * 0.5)
