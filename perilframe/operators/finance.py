"""Direct damage, interruption and heat cost, portfolio tail, layers, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import assumptions as A
from ..functions.common import share, total
from ..functions.curves import layer_parts
from . import scoring

RPS = A.RETURN_PERIODS


def finance(scored: DataFrame) -> DataFrame:
    """Add direct_ead, bi_ead, heat_cost, total_aal and per-return-period direct and interruption losses."""
    gop = F.col("revenue_usd") * F.col("gop_margin")
    share_year = F.col("reopen_months") / 12.0
    frac = total([F.col(f"f_{p}") for p in A.ACUTE])
    excess = F.greatest(F.col("heat_ind.days_over_35") - A.HEAT_COMFORT_DAYS, F.lit(0.0))
    df = scored.select(
        "*", gop.alias("gop"), F.col("ead").alias("direct_ead"), (gop * share_year * frac).alias("bi_ead"),
        excess.alias("heat_excess_days"), (gop / 365.0 * excess * F.col("heat_drop")).alias("heat_cost"))
    per_value = F.when(F.col("asset_value_usd") != 0.0, F.col("gop") * share_year / F.col("asset_value_usd")).otherwise(0.0)
    df = df.withColumn("total_aal", F.col("direct_ead") + F.col("bi_ead") + F.col("heat_cost"))
    direct = [scoring.loss_at(rp) for rp in RPS]
    return df.select("*", F.array(*direct).alias("direct_rp"), F.array(*[d * per_value for d in direct]).alias("bi_rp"))


def peril_cost(p: str) -> Column:
    """Direct plus interruption cost of one peril; heat has its own cost."""
    if p == "heat":
        return F.col("heat_cost")
    return F.col(f"ead_{p}") + F.col("gop") * (F.col("reopen_months") / 12.0) * F.col(f"f_{p}")


def correlated(sum_v: Column, sum_sq: Column, rho: float = A.LOSS_CORRELATION) -> Column:
    """Blend of fully dependent and independent site losses."""
    return F.sqrt(F.greatest(sum_sq * (1.0 - rho) + sum_v * sum_v * rho, F.lit(0.0)))


def portfolio(fin: DataFrame, keys: list[str] = ["scenario"]) -> DataFrame:
    """Totals and the correlation-blended tail; sums only, so it combines map-side."""
    loss = {rp: F.get("direct_rp", F.lit(i)) + F.get("bi_rp", F.lit(i)) for i, rp in enumerate(RPS)}
    aggs = [F.count("*").alias("sites"), F.sum("asset_value_usd").alias("value"), F.sum("revenue_usd").alias("revenue")]
    aggs += [F.sum(c).alias(c) for c in ("direct_ead", "bi_ead", "heat_cost", "total_aal")]
    for rp, v in loss.items():
        aggs += [F.sum(v).alias(f"_s{rp}"), F.sum(v * v).alias(f"_q{rp}")]
    out = fin.groupBy(*keys).agg(*aggs)
    out = out.select("*", *[correlated(F.col(f"_s{rp}"), F.col(f"_q{rp}")).alias(f"var{rp}") for rp in RPS])
    return (out.drop(*[f"_{x}{rp}" for rp in RPS for x in "sq"])
            .withColumn("acute_aal", F.col("direct_ead") + F.col("bi_ead"))
            .withColumn("aal_pct_value", share(F.col("total_aal"), F.col("value")) * 100.0)
            .withColumn("aal_pct_revenue", share(F.col("total_aal"), F.col("revenue")) * 100.0))


def with_tail(live: DataFrame, pack: DataFrame | None) -> DataFrame:
    """Portfolio rows with the event-based curve where one exists, labelled either way.

    `pack` has scenario and ep (array over return periods); it holds one row per scenario.
    """
    blend = "correlation blend (direct + interruption)"
    i100, i250 = RPS.index(100), RPS.index(250)
    if pack is None:
        return live.select("*", F.col("var100").alias("tail100"), F.col("var250").alias("tail250"),
                           F.lit(blend).alias("tail_basis"))
    ep = pack.select("scenario", F.col("ladder").alias("_ep"))
    out = live.join(F.broadcast(ep), "scenario", "left")
    return out.select(
        *live.columns, F.coalesce(F.get("_ep", F.lit(i100)), F.col("var100")).alias("tail100"),
        F.coalesce(F.get("_ep", F.lit(i250)), F.col("var250")).alias("tail250"),
        F.when(F.col("_ep").isNotNull(), "joint event tail (direct damage)").otherwise(blend).alias("tail_basis"))


def disclosure(tailed: DataFrame, pathway: str = "ssp245") -> DataFrame:
    """Present, 2050 and 2080 rows of one pathway as percent of value."""
    pct = lambda c: share(F.col(c), F.col("value")) * 100.0
    keys = ["present", f"{pathway}_2050", f"{pathway}_2080"]
    return tailed.where(F.col("scenario").isin(keys)).select(
        "scenario", pct("acute_aal").alias("acute_pct"), pct("heat_cost").alias("chronic_pct"),
        pct("total_aal").alias("total_pct"), pct("tail100").alias("tail100_pct"), "tail_basis")


def cost_split(fin: DataFrame) -> DataFrame:
    """Annual cost by peril, by type and by brand in one pass over the sites."""
    perils = [*A.ACUTE, "heat"]
    cells = [F.struct(F.lit("peril").alias("cut"), F.lit(p).alias("name"), peril_cost(p).alias("cost")) for p in perils]
    cells += [F.struct(F.lit("type").alias("cut"), F.lit(n).alias("name"), F.col(c).alias("cost"))
              for n, c in (("direct", "direct_ead"), ("interruption", "bi_ead"), ("heat", "heat_cost"))]
    cells.append(F.struct(F.lit("brand").alias("cut"), F.coalesce("brand", F.lit("Unbranded")).alias("name"),
                          F.col("total_aal").alias("cost")))
    return (fin.select("scenario", F.explode(F.array(*cells)).alias("_c"))
            .groupBy("scenario", "_c.cut", "_c.name").agg(F.sum("_c.cost").alias("cost")))


def site_shares(fin: DataFrame) -> DataFrame:
    """Cost share against value share, with concentration flags."""
    whole = fin.groupBy("scenario").agg(F.sum("total_aal").alias("_t"), F.sum("asset_value_usd").alias("_v"))
    out = fin.join(F.broadcast(whole), "scenario")
    cost = share(F.col("total_aal"), F.col("_t")) * 100.0
    value = share(F.col("asset_value_usd"), F.col("_v")) * 100.0
    flag = (F.when(F.col("cost_share") > F.col("value_share") * 1.5, "concentration")
            .when(F.col("cost_share") < F.col("value_share") * 0.6, "diversifier").otherwise("in line"))
    return (out.select("scenario", "site_key", "name", "total_aal", cost.alias("cost_share"), value.alias("value_share"))
            .withColumn("flag", flag))


def overview(scored: DataFrame) -> DataFrame:
    """Headline figures: value, heat means, and high or severe sites."""
    return scored.groupBy("scenario").agg(
        F.count("*").alias("sites"), F.sum("asset_value_usd").alias("tiv"),
        F.avg("heat_ind.days_over_32").alias("avg_days_32"), F.avg("heat_ind.days_over_35").alias("avg_days_35"),
        F.avg("heat_ind.days_humid_35").alias("avg_days_humid"),
        F.count_if(F.col("band").isin("High", "Severe")).alias("high_severe"))


def decision_rows(fin: DataFrame, best: DataFrame | None = None) -> DataFrame:
    """What drives each site, its 1-in-100 year in physical units, and its model confidence."""
    perils = [*A.ACUTE, "heat"]
    df = fin.select("*", *[peril_cost(p).alias(f"cost_{p}") for p in perils])
    i = RPS.index(100)
    damage = F.get("direct_rp", F.lit(i))
    from ..functions.curves import ponding_depth
    depth = F.greatest(F.get("i_cflood", F.lit(i)), F.get("i_rflood", F.lit(i)),
                       ponding_depth(F.get("i_mm", F.lit(i))), F.lit(0.0))
    out = df.select(
        "scenario", "site_key", "name", scoring.dominant("cost_", perils).alias("dominant"),
        F.greatest(*[F.col(f"cost_{p}") for p in perils]).alias("dominant_cost"), "ead",
        damage.alias("damage_100"), depth.alias("depth_100"),
        (F.col("reopen_months") / 12.0 * 365.0 * share(damage, F.col("asset_value_usd"))).alias("downtime_100"),
        scoring.modelled_count().alias("modelled"))
    if best is None:
        return out
    return out.join(best.select("scenario", "site_key", F.col("measure").alias("best_measure"),
                                F.col("bcr").alias("best_bcr")), ["scenario", "site_key"], "left")


def layer_table(tail: DataFrame, attachments: list[int], exhaust: int = A.LAYER_EXHAUST_RP,
                load: float = A.PREMIUM_LOAD, prefix: str = "var", aal: str = "acute_aal") -> DataFrame:
    """Retained, transferred and excess shares of the acute cost at each candidate attachment.

    The curve integral is applied to the acute cost, so the three slices always reconcile.
    """
    curve = {rp: F.col(f"{prefix}{rp}") for rp in RPS}
    rows = []
    for a in attachments:
        below, layer, whole = layer_parts(curve, curve[a], curve[exhaust])
        part = lambda x: F.col(aal) * F.least(F.when(whole != 0.0, x / whole).otherwise(x), F.lit(1.0))
        rows.append(F.struct(F.lit(a).alias("attach_rp"), F.lit(exhaust).alias("exhaust_rp"),
                             curve[a].alias("attach_usd"), curve[exhaust].alias("exhaust_usd"),
                             part(below).alias("below"), part(layer).alias("layer")))
    out = tail.select("scenario", F.col(aal).alias("aal"), F.explode(F.array(*rows)).alias("_l"))
    return out.select("scenario", "_l.*", F.greatest(F.col("aal") - F.col("_l.below") - F.col("_l.layer"), F.lit(0.0)).alias("above"),
                      (F.col("_l.layer") * load).alias("premium"))


def retention_sweep(tail: DataFrame, exhaust: int = A.LAYER_EXHAUST_RP) -> DataFrame:
    return layer_table(tail, [rp for rp in RPS if rp < exhaust], exhaust)


def quote_gap_pct(quote: Column, premium: Column) -> Column:
    """Signed gap of a quote to the modelled premium; null when either is missing."""
    return F.when((quote > 0.0) & (premium > 0.0), (quote / premium - 1.0) * 100.0)


def urgency(fin: DataFrame, pathway: str, limit_bps: float = A.TOLERANCE_SITE_BPS) -> DataFrame:
    """First horizon at which a site's annual cost crosses the tolerance."""
    steps = {"present": 2026} | {f"{pathway}_{h}": h for h in A.HORIZONS}
    bps = share(F.col("total_aal"), F.col("asset_value_usd")) * 1e4
    horizon = A.lookup(F.col("scenario"), steps)
    first = F.min(F.when(bps > limit_bps, horizon))
    when = F.when(F.col("_y").isNull(), "monitor").when(F.col("_y") == 2026, "now").otherwise(F.col("_y").cast("string"))
    return (fin.where(F.col("scenario").isin(list(steps))).groupBy("site_key").agg(first.alias("_y"))
            .select("site_key", when.alias("act_by")))


def year_bracket(year: Column) -> Column:
    """struct(lower, upper, fraction): the modelled horizons around a calendar year."""
    ys = A.YEARS_MODELLED
    y = F.least(F.greatest(year, F.lit(ys[0])), F.lit(ys[-1]))
    out = F
    for a, b in zip(ys, ys[1:]):
        out = out.when(y <= b, F.struct(F.lit(a).alias("lower"), F.lit(b).alias("upper"),
                                        ((y - a) / float(b - a)).alias("fraction")))
    return out.otherwise(None)


def top_per(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """First n rows per key. Spark limits each input partition to n rows per key before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
