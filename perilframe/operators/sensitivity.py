"""Sampled bands, curve calibration and the year-loss table.

Equal intensities of a site are summed before any sweep, so a sweep repeats compact rows. Every
draw is a hash of its own key: results do not depend on partitioning or on lost executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import assumptions as A
from ..functions.curves import wind_damage


def uniform(*key: Column | int | str) -> Column:
    """Stateless uniform in [0, 1) from a key."""
    cols = [k if isinstance(k, Column) else F.lit(k) for k in key]
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 52)) / float(1 << 52)


PRIME = 1_000_003  # joint draws are remainders modulo it, so that any engine repeats them exactly
DRAWS = {"haz": ("haz_mult", 7919, 104_729), "dmg": ("dmg_scale", 5573, 611_953), "exp": ("exp_mult", 3343, 350_377)}


def factors(sample: Column) -> list[Column]:
    """haz_mult, dmg_scale and exp_mult of a sample number: products of two remainders, scattered over each factor's range."""
    def one(key: str) -> Column:
        name, a, b = DRAWS[key]
        lo, hi = A.MC_FACTORS[key]
        u = F.pmod(F.pmod((sample + 1) * a, F.lit(PRIME)) * (sample + 1 + b), F.lit(PRIME)) / float(PRIME)
        return (u * (hi - lo) + lo).alias(name)
    return [one(k) for k in A.MC_FACTORS]


def sampled(rows: DataFrame, n: int = A.MC_SAMPLES) -> DataFrame:
    """rows once per joint draw, with sample and its factors. Rows repeat inside the task; sum them by sample next."""
    out = rows.withColumn("sample", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return out.select("*", *factors(F.col("sample")))


def one_at_a_time(rows: DataFrame) -> DataFrame:
    """rows at the low and high end of each factor with the others neutral: factor, side and the knob columns."""
    neutral = {name: 1.0 for name, _, _ in DRAWS.values()}
    sets = [{"factor": k, "side": side} | neutral | {DRAWS[k][0]: A.MC_FACTORS[k][i]} for k in A.MC_FACTORS for i, side in enumerate(("lo", "hi"))]
    return rows.select("*", F.explode(F.expr(A.sql_literal(sets))).alias("_f")).select("*", "_f.*").drop("_f")


def swings(totals: DataFrame) -> DataFrame:
    """totals (scenario, factor, side, total) -> scenario, factor, swing; a handful of rows."""
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("total")))
    return totals.groupBy("scenario", "factor").agg(F.abs(side("hi") - side("lo")).alias("swing"))


def bands(totals: DataFrame, column: str = "total", by: list[str] | None = None) -> DataFrame:
    """5th, 50th and 95th percentile with linear interpolation, over one row per sample."""
    q = F.percentile(column, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    return totals.groupBy(*(by or [])).agg(q.alias("_q")).select(*(by or []), *[F.get("_q", F.lit(i)).alias(n) for i, n in enumerate(["p5", "p50", "p95"])])


def v_half_sweep(rows: DataFrame, step: float = 1.0, lo: float = A.V_HALF_LO, hi: float = A.V_HALF_HI) -> DataFrame:
    """Annual wind damage at every candidate half-damage speed, one pass over compact rows.

    rows: x (wind speed), freq, wind_mult, asset_value_usd.
    """
    n = int(round((hi - lo) / step))
    grid = [float(lo + i * step) for i in range(n + 1)]
    out = rows.select("*", F.explode(F.expr(A.sql_literal(grid))).alias("v_half"))
    frac = F.least(wind_damage(F.col("x"), F.col("v_half")) * F.col("wind_mult"), F.lit(1.0))
    return out.groupBy("v_half").agg(F.sum(F.col("freq") * frac * F.col("asset_value_usd")).alias("wind_aal"))


FINE_STEP = 0.01


def calibration(wind_rows: DataFrame, flood: DataFrame, pairs: DataFrame) -> DataFrame:
    """Half-damage speed at which the model's present loss of the backtested sites equals what was observed there.

    wind_rows: site_key, x, freq, wind_mult, v_half, asset_value_usd of the present catalog. flood: site_key, flood_usd, the
    annual flood damage, which the speed does not touch. pairs: site_key, observed; rows without a site don't count.

    Damage falls as the speed rises. One sweep over whole speeds brackets the answer, a second one over hundredths inside
    the bracket narrows it, and a straight line gives the rest. Where no speed of the sweep fits, its bound is returned as
    clipped. bias is observed over modelled at the sites' own curves; review marks one outside half to twice.
    """
    known = pairs.where(F.col("site_key").isNotNull())
    rows = wind_rows.join(known.select("site_key").distinct(), "site_key", "left_semi")
    total = known.agg(F.sum("observed").alias("o"), F.count(F.lit(1)).alias("n")).first()
    fixed = flood.join(known.select("site_key").distinct(), "site_key", "left_semi").agg(F.coalesce(F.sum("flood_usd"), F.lit(0.0))).first()[0]
    own = F.least(wind_damage(F.col("x"), F.col("v_half")) * F.col("wind_mult"), F.lit(1.0))
    base = rows.agg(F.coalesce(F.sum(F.col("freq") * own * F.col("asset_value_usd")), F.lit(0.0))).first()[0] + fixed
    rows = rows.drop("v_half")
    observed = float(total["o"] or 0.0)

    def swept(step: float, lo: float, hi: float) -> list[tuple[float, float]]:
        return sorted((r.v_half, r.wind_aal + fixed) for r in v_half_sweep(rows, step, lo, hi).collect())  # one row per candidate

    coarse = swept(1.0, A.V_HALF_LO, A.V_HALF_HI) or [(A.V_HALF_LO, fixed), (A.V_HALF_HI, fixed)]
    clipped = not coarse[-1][1] < observed < coarse[0][1]
    if clipped:
        speed = A.V_HALF_LO if observed >= coarse[0][1] else A.V_HALF_HI
    else:
        at = max(v for v, m in coarse if m >= observed)
        fine = swept(FINE_STEP, at, at + 1.0)
        (v, m), (w, k) = next((a, b) for a, b in zip(fine, fine[1:], strict=False) if a[1] >= observed >= b[1])
        speed = v + ((m - observed) / (m - k) * (w - v) if m > k else 0.0)
    bias = observed / base if base else None
    row = (int(total["n"]), observed, float(base), bias, float(speed), float(A.V_HALF), clipped, None if bias is None else not 0.5 <= bias <= 2.0)
    return wind_rows.sparkSession.createDataFrame([row], "matched long, observed_usd double, modelled_usd double, bias double, fitted_v_half double, published_v_half double, clipped boolean, review boolean")


def catalog_years(spark, weights: DataFrame, years: int = A.SIM_YEARS, seed: int = A.SIM_SEED) -> DataFrame:
    """The alternative catalog each simulated year draws, per country: at most years x countries rows.

    weights: country, source, weight (normalised per country).
    """
    from pyspark.sql import Window
    w = Window.partitionBy("country").orderBy("source")
    edges = weights.withColumn("_hi", F.sum("weight").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    edges = edges.withColumn("_lo", F.col("_hi") - F.col("weight")).withColumn("_last", F.lead("source").over(w).isNull())
    rows = edges.select("*", F.explode(F.sequence(F.lit(0), F.lit(years - 1))).alias("year"))
    u = uniform(seed, "catalog", F.col("country"), F.col("year"))
    return rows.where((u >= F.col("_lo")) & ((u < F.col("_hi")) | F.col("_last"))).select("country", "source", "year")


def occurrences(events: DataFrame, keys: list[str], rate: str = "freq", years: int = A.SIM_YEARS, seed: int = A.SIM_SEED) -> DataFrame:
    """(keys, year, n): Poisson occurrences of each row over the simulated years, zeros left out.

    Each row draws from a generator seeded by its own key, so the work follows the rows.
    """
    src = events.select(*keys, F.col(rate).cast("double").alias("_rate"), F.xxhash64(F.lit(seed), *keys).alias("_seed"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.select(*keys).schema) + ", year int, n int"

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            hit, year, count = [], [], []
            for i, (rate_i, seed_i) in enumerate(zip(pdf["_rate"], pdf["_seed"])):
                n = np.random.default_rng(int(seed_i) & (2**63 - 1)).poisson(rate_i, years)
                at = np.nonzero(n)[0]
                hit.append(np.full(len(at), i)), year.append(at), count.append(n[at])
            idx = np.concatenate(hit) if hit else np.array([], int)
            out = pdf[keys].iloc[idx].reset_index(drop=True)
            out["year"], out["n"] = (np.concatenate(x).astype("int32") if x else np.array([], "int32") for x in (year, count))
            yield out

    return src.mapInPandas(draw, schema)


def year_losses(parts: list[DataFrame], spark, years: int = A.SIM_YEARS, cap_usd: float | None = None) -> DataFrame:
    """Loss per simulated year, dense over years, with the optional annual cap. parts: year, loss."""
    out = parts[0].select("year", "loss")
    for p in parts[1:]:
        out = out.unionByName(p.select("year", "loss"))
    total = out.groupBy("year").agg(F.sum("loss").alias("loss"))
    dense = spark.range(years).select(F.col("id").cast("int").alias("year")).join(total, "year", "left").fillna(0.0, ["loss"])
    return dense.withColumn("loss", F.least("loss", F.lit(float(cap_usd)))) if cap_usd else dense


def year_summary(table: DataFrame) -> DataFrame:
    """Mean, median, 90th and 99th percentile by floor rank, over one row per simulated year."""
    arr = F.array_sort(F.collect_list("loss"))  # one value per simulated year
    at = lambda p: F.get("_a", F.least(F.floor(F.size("_a") * p).cast("int"), F.size("_a") - 1))
    return table.agg(F.avg("loss").alias("mean"), arr.alias("_a")).select("mean", at(0.5).alias("median"), at(0.9).alias("p90"), at(0.99).alias("p99"))
