"""Keyed keep-first / keep-last and ordered pick, as aggregations that combine map-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_one(df: DataFrame, keys: list[str], ordinal: Column | str, last: bool = False) -> DataFrame:
    """One row per key: the one with the smallest (or largest) ordinal.

    An aggregation instead of a ranked window, so a key with very many copies is reduced on the
    map side. The ordinal must be unique within a key for a deterministic pick.
    """
    rest = [c for c in df.columns if c not in keys]
    ordinal = F.col(ordinal) if isinstance(ordinal, str) else ordinal
    pick = F.max_by if last else F.min_by
    row = pick(F.struct(*rest), ordinal).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, "_row.*").select(*df.columns)


def last_wins(frames: list[DataFrame], keys: list[str], within: str | None = None) -> DataFrame:
    """Union of frames; on a key collision the later frame wins, then the later row by `within`."""
    row = F.col(within) if within else F.lit(0)
    tagged = [f.withColumn("_ordinal", F.struct(F.lit(i).alias("i"), row.alias("r")))
              for i, f in enumerate(frames)]
    out = tagged[0]
    for f in tagged[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return keep_one(out, keys, "_ordinal", last=True).drop("_ordinal")
