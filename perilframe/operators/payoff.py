"""What a measure pays the owner: certain retained savings and the negotiable premium part.

No dollar counts twice: certain savings are reductions of retained loss, the negotiated part
prices only the transferred slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import assumptions as A
from ..functions import interruption as bi
from ..functions.common import by_shuffle, total
from ..functions.curves import capped, ladder_integral
from .adaptation import DEFAULT_ANNUITY, adapted, in_scope, knob_rows, measure_sets
from .scoring import NEUTRAL, RPS, peril_fractions

_PERILS = ["tc_joint", "rflood", "prain", "wfire"]


def loss_factors(fin: DataFrame) -> DataFrame:
    """Per site and in-scope measure: rung factors (modified over base loss) per ladder peril.

    The 1-in-2 and 1-in-5 rungs ride the 1-in-10 factor; the storm factor blends wind and surge
    by loss; a zero base keeps factor 1.
    """
    rows = adapted(knob_rows(fin, measure_sets()).where(in_scope(F.col("measure"))))
    value, knobs = F.col("asset_value_usd"), {k: F.col(k) for k in NEUTRAL}
    mod = peril_fractions(knobs)
    after = {p: {rp: mod[p]["rungs"][rp] * value for rp in RPS} for p in ("tc", "cflood", "rflood", "prain")}
    rows = rows.select("*", *[F.array(*[after[p][rp] for rp in RPS]).alias(f"_m_{p}") for p in after])
    ratio = lambda b, m: F.when(b > 0.0, m / b).otherwise(1.0)
    at = lambda c, i: F.get(F.col(c), F.lit(i))

    def rungs(base: list[Column], new: list[Column]) -> Column:
        f = [ratio(b, m) for b, m in zip(base, new)]
        return F.array(f[0], f[0], *f)

    n = range(len(RPS))
    storm = rungs([at("loss_tc", i) + at("loss_cflood", i) for i in n], [at("_m_tc", i) + at("_m_cflood", i) for i in n])
    one = {p: rungs([at(f"loss_{p}", i) for i in n], [at(f"_m_{p}", i) for i in n]) for p in ("rflood", "prain")}
    fire = ratio(F.col("f_wfire"), F.col("g_wfire"))
    cost = value * F.col("cost_pct") / 100.0 + F.col("cost_site")
    return rows.select("scenario", "site_key", "measure", "ordinal", "k_reopen", cost.alias("cost"),
                       F.greatest(F.col("heat_cost") - F.col("a_heat"), F.lit(0.0)).alias("heat_saving"),
                       storm.alias("x_tc_joint"), one["rflood"].alias("x_rflood"), one["prain"].alias("x_prain"),
                       F.array_repeat(fire, len(A.LADDER_RPS)).alias("x_wfire"))


def payoffs(fin: DataFrame, ladders: DataFrame, sites: DataFrame, load: float = A.PREMIUM_LOAD,
            realization: float = A.CREDIT_REALIZATION, af: float = DEFAULT_ANNUITY) -> DataFrame:
    """Certain and negotiated value of every in-scope measure at every site, with both BCRs.

    The storm deductible is shared: a site's change is measured on its whole group's ladder,
    which arrives as one summed ladder per group rather than as the group's members.
    """
    wide = ladders.where(F.col("peril").isin(_PERILS)).groupBy("scenario", "site_key").agg(
        *[F.first(F.when(F.col("peril") == p, F.col("ladder")), ignorenulls=True).alias(f"l_{p}") for p in _PERILS])
    econ = sites.select("site_key", "campus", "bi_value", "bi_daily", "bi_anchor_days", "bi_limit", "bi_region")
    base = wide.join(by_shuffle(econ), "site_key")
    group = base.groupBy("scenario", "campus").agg(
        F.array(*[F.sum(F.get("l_tc_joint", F.lit(i))) for i in range(len(A.LADDER_RPS))]).alias("l_group"))
    # What is the same under every measure is joined and split once per site, before sites are repeated for measures.
    base = base.where(F.coalesce(*[F.col(f"l_{p}") for p in _PERILS]).isNotNull()).join(by_shuffle(group), ["scenario", "campus"])
    base = base.select("*", *_interruption("l", bi.econ_of()))
    df = loss_factors(fin).join(by_shuffle(base), ["scenario", "site_key"])
    times = lambda p: F.zip_with(f"l_{p}", f"x_{p}", lambda a, b: a * b)
    df = df.select("*", *[times(p).alias(f"n_{p}") for p in _PERILS])
    df = df.withColumn("n_group", F.zip_with(F.col("l_group"), F.zip_with("n_tc_joint", "l_tc_joint", lambda a, b: a - b), lambda a, b: a + b))
    pos = lambda x: F.greatest(x, F.lit(0.0))
    gross, kept = [pos(ladder_integral(F.col("l_tc_joint")) - ladder_integral(F.col("n_tc_joint")))], []
    storm = capped(A.DEDUCTIBLE["hurricane"])
    kept.append(pos(ladder_integral(F.col("l_group"), storm) - ladder_integral(F.col("n_group"), storm)))
    for p in ("rflood", "prain", "wfire"):
        c = capped(A.DEDUCTIBLE[A.PERIL_CLASS[p]])
        gross.append(pos(ladder_integral(F.col(f"l_{p}")) - ladder_integral(F.col(f"n_{p}"))))
        kept.append(pos(ladder_integral(F.col(f"l_{p}"), c) - ladder_integral(F.col(f"n_{p}"), c)))
    keep = ["scenario", "site_key", "measure", "ordinal", "cost", "heat_saving"]
    reopened = bi.econ_of() | {"anchor_days": F.col("bi_anchor_days") * F.col("k_reopen")}
    df = df.select(*keep, total(gross).alias("d_gross"), total(kept).alias("d_kept"), *[f"_l_{p}" for p in _PERILS], *_interruption("n", reopened))
    out = _interruption_change(df)
    certain = F.col("d_kept") + F.col("bi_kept") + F.col("heat_saving")
    transferred = pos(F.col("d_gross") - F.col("d_kept")) + pos(F.col("bi_gross") - F.col("bi_kept"))
    saving = transferred * load * realization
    bcr = lambda x: F.when(F.col("cost") > 0.0, x * af / F.col("cost")).otherwise(0.0)
    return out.select("scenario", "site_key", "measure", "ordinal", "cost", certain.alias("certain"), transferred.alias("transferred"),
                      saving.alias("premium_saving"), bcr(certain).alias("bcr_certain"), bcr(certain + saving).alias("bcr_with_credit"))


def _interruption(side: str, econ: dict[str, Column]) -> list[Column]:
    """Interruption of each peril's ladder on one side, base (l) or modified (n)."""
    return [bi.split_ladder(F.col(f"{side}_{p}"), econ, F.lit(p in A.STORM_TIMED)).alias(f"_{side}_{p}") for p in _PERILS]


def _interruption_change(df: DataFrame) -> DataFrame:
    """Add the interruption saved, base less modified ladders, summed over the rows of a scenario, site and measure."""
    def change(term: str) -> Column:
        at = lambda side, p: F.coalesce(F.col(f"_{side}_{p}.{term}"), F.lit(0.0))
        return total([at("l", p) - at("n", p) for p in _PERILS])
    rest = [c for c in df.columns if not c.startswith("_")]
    one = Window.partitionBy("scenario", "site_key", "measure")
    saved = lambda c: F.greatest(F.sum(c).over(one), F.lit(0.0))
    return (df.select(*rest, change("gross").alias("_g"), change("retained").alias("_r"))
            .select(*rest, saved("_g").alias("bi_gross"), saved("_r").alias("bi_kept")))


def renewal_ask(funded: DataFrame, pay: DataFrame) -> DataFrame:
    """Negotiated premium savings summed over the funded actions: the upper end of the ask."""
    rows = funded.where("funded").select("scenario", "site_key", "measure").join(pay, ["scenario", "site_key", "measure"])
    return rows.groupBy("scenario").agg(F.count("*").alias("n"), F.sum("premium_saving").alias("premium_ask"), F.sum("certain").alias("certain"))
