"""Claims history: occurrences, aggregates, calibration against the model, backtest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import assumptions as A
from ..functions import text
from ..functions.common import by_shuffle, share
from . import matching

CLUSTER_DAYS = 3


def classified(claims: DataFrame, sites: DataFrame) -> DataFrame:
    """Claims with coverage class, matched site and named-storm key."""
    m = matching.match_names(claims, sites, "claimant")
    rows = matching.attach_match(claims, m, ["claimant"])
    return rows.select("*", text.coverage_class(F.col("coverage")).alias("cls"),
                       text.storm_key(F.col("description"), F.col("year")).alias("storm"))


def occurrences(rows: DataFrame) -> DataFrame:
    """Add event_key: the named storm, else claims of one class chained within three days.

    Chaining only needs the distinct days of a class, at most one row per calendar day, so the
    ordered pass stays small however many claims fall on a day.
    """
    cls = F.coalesce("cls", F.lit("unmapped"))
    df = rows.withColumn("_cls", cls)
    days = df.where(F.col("storm").isNull()).select("_cls", "date_of_loss").distinct()
    w = Window.partitionBy("_cls").orderBy("date_of_loss")
    gap = F.datediff(F.col("date_of_loss"), F.lag("date_of_loss").over(w))
    days = days.withColumn("_new", F.when(gap <= CLUSTER_DAYS, 0).otherwise(1))
    days = days.withColumn("_start", F.max(F.when(F.col("_new") == 1, F.col("date_of_loss"))).over(w))
    key = F.concat(F.lit("ev:"), F.col("_cls"), F.lit(":"), F.col("_start").cast("string"))
    keyed = days.select("_cls", "date_of_loss", key.alias("_key"))
    return (df.join(keyed, ["_cls", "date_of_loss"], "left")
            .withColumn("event_key", F.coalesce("storm", "_key"))
            .withColumn("named", F.col("storm").isNotNull()).drop("_cls", "_key"))


def occurrence_summary(rows: DataFrame) -> DataFrame:
    """Claims, distinct sites, incurred and first year per occurrence."""
    return rows.groupBy("event_key", "named").agg(
        F.count("*").alias("claims"), F.countDistinct("site_key").alias("sites"),
        F.sum("net_incurred").alias("incurred"), F.min("year").alias("year"))


def aggregates(rows: DataFrame) -> DataFrame:
    """Incurred by site, class, year, unmatched claimant and unmapped coverage, one pass.

    Site, class and year count only claims with both a site and a class.
    """
    good = F.col("site_key").isNotNull() & F.col("cls").isNotNull()
    cell = lambda cut, name, cond: F.when(cond, F.struct(F.lit(cut).alias("cut"), name.cast("string").alias("name")))
    cells = F.array_compact(F.array(
        cell("site", F.col("site_key"), good), cell("class", F.col("cls"), good), cell("year", F.col("year"), good),
        cell("unmatched", F.col("claimant"), F.col("site_key").isNull()),
        cell("unmapped", F.coalesce(F.col("coverage"), F.lit("(blank)")), F.col("cls").isNull()),
        cell("open", F.lit("open"), F.col("open")), cell("matched", F.lit("matched"), good),
        cell("total", F.lit("total"), F.lit(True))))
    return (rows.select("net_incurred", F.explode(cells).alias("_c"))
            .groupBy("_c.cut", "_c.name").agg(F.count("*").alias("claims"), F.sum("net_incurred").alias("incurred")))


def calibration(rows: DataFrame, modelled: DataFrame) -> DataFrame:
    """Modelled annual retained loss against actual incurred per class.

    Named storms stay out of flood and general. `modelled` has cls and modelled_annual. A ratio
    outside 0.5..2 is a bias.
    """
    years = rows.agg((F.max("year") - F.min("year") + 1).alias("_years"))
    body = F.col("cls").isin("hurricane", "bi") | ~F.col("named")
    actual = (rows.where(F.col("site_key").isNotNull() & body).groupBy("cls").agg(F.sum("net_incurred").alias("_inc")))
    df = (modelled.join(F.broadcast(actual), "cls", "left").withColumn("_k", F.lit(1))
          .join(F.broadcast(years.withColumn("_k", F.lit(1))), "_k"))
    df = df.withColumn("actual_annual", F.coalesce("_inc", F.lit(0.0)) / F.col("_years"))
    ratio = F.when(F.col("actual_annual") > 0.0, F.col("modelled_annual") / F.col("actual_annual"))
    return df.select("cls", "modelled_annual", "actual_annual", ratio.alias("ratio"),
                     F.when(ratio > 2.0, "above_actuals").when(ratio < 0.5, "below_actuals").alias("bias"))


def backtest(site_ead: DataFrame, sites: DataFrame, observed: DataFrame) -> DataFrame:
    """Observed against modelled annual loss per matched site (case-insensitive exact name)."""
    low = lambda c: F.lower(F.trim(F.col(c)))
    # duplicate site names: the last one wins, as a later entry replaces an earlier one
    names = sites.groupBy(low("name").alias("_n")).agg(F.max("site_key").alias("site_key"))
    obs = observed.select(low("name").alias("_n"), F.col("name").alias("observed_name"), "observed_annual_loss_usd")
    df = obs.join(by_shuffle(names), "_n", "left").join(by_shuffle(site_ead.select("site_key", F.col("ead").alias("modelled"))), "site_key", "left")
    ratio = F.when(F.col("modelled") > 0.0, F.col("observed_annual_loss_usd") / F.col("modelled"))
    return df.select("observed_name", "site_key", "modelled", F.col("observed_annual_loss_usd").alias("observed"), ratio.alias("ratio"))


def backtest_bias(pairs: DataFrame) -> DataFrame:
    s = pairs.agg(F.count("*").alias("rows"), F.count("site_key").alias("matched"), F.sum("modelled").alias("modelled"),
                  F.sum(F.when(F.col("site_key").isNotNull(), F.col("observed"))).alias("observed"))
    bias = share(F.col("observed"), F.col("modelled"))
    return s.withColumn("bias", bias).withColumn("consistent", (bias > 0.5) & (bias < 2.0))
