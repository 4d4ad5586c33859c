"""Streaming forms of the two incremental operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import assumptions as A
from ..functions import text
from ..operators import grid


def heat_sums(daily: DataFrame, watermark: str = "2 days") -> DataFrame:
    """Running hot-day counts and degree days per cell and year from a daily stream.

    Input: cell, ts (observation day), tmax, tmean. A re-sent day of a cell counts once. The
    state is one row per cell and year; run in update mode and fold with heat_indicators_from.
    """
    days = daily.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["cell", "ts"])
    sums = [F.sum((F.col("tmax").isNull() | F.col("tmean").isNull() | F.isnan("tmax") | F.isnan("tmean")).cast("long")).alias("_bad")]
    for i, d in enumerate(A.HEAT_DELTA.values()):
        sums += [F.sum((F.col("tmax") > A.HEAT_HOT_C - d).cast("long")).alias(f"_h{i}"),
                 F.sum((F.col("tmax") > A.HEAT_DANGER_C - d).cast("long")).alias(f"_d{i}"),
                 F.sum(F.greatest(F.col("tmean") - (A.COOLING_BASE_C - d), F.lit(0.0))).alias(f"_c{i}")]
    return days.groupBy("cell", F.year("ts").alias("year")).agg(*sums)


def heat_indicators_from(sums: DataFrame) -> DataFrame:
    """Yearly state to indicators per scenario, the same figures as the batch operator."""
    names = [f"_{k}{i}" for i in range(len(A.HEAT_DELTA)) for k in "hdc"]
    cells = sums.groupBy("cell").agg(*[F.sum(n).alias(n) for n in names], F.count("*").alias("_years"), F.sum("_bad").alias("_bad"))
    cells = cells.where("_bad = 0")  # as in batch, a cell with a bad day has no indicators
    per = lambda n: F.col(n) / F.col("_years")
    rows = F.array(*[F.struct(F.lit(s).alias("scenario"), per(f"_h{i}").alias("days32"), per(f"_d{i}").alias("days35"), per(f"_c{i}").alias("cdd"))
                     for i, s in enumerate(A.HEAT_DELTA)])
    return cells.select("cell", F.explode(rows).alias("_r")).select("cell", "_r.*")


def claim_sessions(claims: DataFrame, gap: str = "3 days", watermark: str = "30 days") -> DataFrame:
    """Occurrences of unnamed claims per class: claims chain while gaps stay within three days.

    Input: ts, coverage, net_incurred, description. Gaps count whole days, inclusive, so
    times are cut to days and the session window is one second longer than the gap.
    """
    rows = claims.withColumn("ts", F.date_trunc("DAY", "ts")).withWatermark("ts", watermark).withColumn("cls", F.coalesce(text.coverage_class(F.col("coverage")), F.lit("unmapped")))
    rows = rows.where(text.storm_key(F.col("description"), F.year("ts")).isNull())
    session = F.session_window("ts", F.lit(f"{gap} 1 second"))
    return rows.groupBy("cls", session.alias("w")).agg(F.count("*").alias("claims"), F.sum("net_incurred").alias("incurred")).select(
        "cls", F.col("w.start").alias("first_claim"), "claims", "incurred")


def batch_heat(daily: DataFrame) -> DataFrame:
    """Batch counterpart on the same input, for reconciliation."""
    return grid.heat_indicators(daily.withColumn("year", F.year("ts")))
