"""Builders shared by the registered queries: stand-in tables wired into the operators."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perilframe import assumptions as A
from perilframe.operators import adaptation, exceedance, finance, scoring, tcor
from perilframe.plans import standin as S
from perilframe.plans.impact import Impact

DEG = 0.5
S2 = ["present", "ssp245_2050"]
S4 = ["present", "ssp245_2030", "ssp245_2050", "ssp245_2080"]


def r(c: Column | str, n: int = 2) -> Column:
    """Round half away from zero, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, n) + F.lit(0.0)


def rounded(df: DataFrame, places: dict[str, int]) -> DataFrame:
    return df.select(*[r(c, places[c]).alias(c) if c in places else F.col(c) for c in df.columns])


def impact(spark: SparkSession, sf: str, keep: bool = False) -> Impact:
    return Impact(sites=S.site_knobs(spark, sf), centroids=S.centroids(spark, sf), catalog=S.catalog(spark, sf),
                  wind=S.wind(spark, sf), surge=S.surge(spark, sf), rain=S.rain(spark, sf), river=S.river(spark, sf),
                  raster=S.raster(spark, sf), recipe=A.recipe_table(spark), deg=DEG, members=S.river_members(spark, sf), keep=keep)


def fin(spark: SparkSession, sf: str, scenarios: list[str] = S2) -> DataFrame:
    """Scored sites with finance: one row per site and scenario, kept because every view reads it.

    Materialising it also keeps base and adapted damage in separate stages, whose generated code
    then stays within the size the JVM compiles.
    """
    df = scoring.site_hazards(S.site_knobs(spark, sf), S.hazard_grid(spark, sf, scenarios), scenarios, DEG,
                              S.grid_layers(scenarios))
    return finance.finance(scoring.score(df)).persist(StorageLevel.MEMORY_AND_DISK)


hazards = scored = fin  # the finance frame carries every hazard and scoring column


def measures(spark: SparkSession, sf: str, scenarios: list[str] = S2) -> DataFrame:
    return adaptation.measure_rows(fin(spark, sf, scenarios)).persist(StorageLevel.MEMORY_AND_DISK)


def insured(spark: SparkSession, sf: str) -> DataFrame:
    return tcor.insured_sites(S.site_knobs(spark, sf))


def events(spark: SparkSession, sf: str) -> DataFrame:
    """The event table, kept because retention, interruption and the demand shock all read it."""
    return impact(spark, sf).event_site_loss(scenarios=S2).persist(StorageLevel.MEMORY_AND_DISK)


def location_ladders(spark: SparkSession, sf: str) -> DataFrame:
    """Pack ladders (dense over sites the event model covers) for river and rain, interim elsewhere."""
    im = impact(spark, sf)
    interim = tcor.interim_ladders(scored(spark, sf))
    cells = F.explode(F.expr(A.sql_literal([{"scenario": s, "peril": p} for s in S2 for p in ("rflood", "prain")]))).alias("_c")
    covered = im.site_map.where("covered").select("site_key", cells).select("site_key", "_c.*")
    pack = exceedance.dense_ladder(covered, im.ladders(("rflood", "prain")).where(F.col("scenario").isin(S2)), ["scenario", "site_key", "peril"])
    return tcor.prefer_pack(interim, pack).persist(StorageLevel.MEMORY_AND_DISK)
