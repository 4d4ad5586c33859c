"""Short-term capital plan: every fundable project of every portfolio, phased into three years."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import assumptions as A
from . import budget as budget_ops
from .finance import top_per

PORTFOLIO = "portfolio"


def plan_order() -> list[Column]:
    return [F.col("bcr").desc(), F.col("name").asc(), F.col("measure").asc()]


def plan_candidates(projects: DataFrame, n: int = A.PLAN_TOP_PHASED) -> DataFrame:
    """A view of the best n projects per portfolio, for short lists; phase() takes all of them."""
    return top_per(projects, [PORTFOLIO], plan_order(), n)


def renovation_year(year: str = "renovation_year"):
    """Plan year of a planned renovation when it falls inside the plan."""
    y = F.col(year) - A.REFERENCE_YEAR + 1
    return F.when((y > 0) & (y <= A.PLAN_YEARS), y.cast("int"))


def phase(projects: DataFrame, budget: float | None = None, alone: int = budget_ops.ALONE) -> DataFrame:
    """Assign plan years in BCR order under an annual budget, for each portfolio by itself.

    A renovation inside the plan fixes the year and discounts the cost; when that year is full the project may take
    another year and keeps the discount. What fits no year is deferred: year is null and deferred true. Without a budget
    the renovation's year is taken, else the first. Every project is in the result, numbered in its portfolio by falling
    BCR, deferred ones behind.

    projects: portfolio, site_key, name, measure, cost, bcr, reno_year (null without a renovation) and whatever else they
    carry. (name, measure) must name a project within a portfolio.
    """
    synergy = F.col("reno_year").isNotNull()
    cost = F.when(synergy, F.round(F.col("cost") * A.RENOVATION_SYNERGY, 2)).otherwise(F.col("cost"))
    rows = budget_ops.in_order(projects.withColumn("synergy", synergy).withColumn("cost", cost), [PORTFOLIO], plan_order())
    if budget is None:
        done = rows.withColumn("year", F.coalesce("reno_year", F.lit(1)).cast("int"))
    else:
        items = rows.select(PORTFOLIO, "seq", budget_ops.cents(F.col("cost")).alias("cents"), F.col("reno_year").alias("wish"))
        years = budget_ops.fill(items, [PORTFOLIO], [round(budget * 100)] * A.PLAN_YEARS, alone)
        done = rows.join(years.withColumnRenamed("line", "year"), "seq")
    return budget_ops.places(done, [PORTFOLIO], F.col("year").isNull()).withColumn("deferred", F.col("year").isNull()).drop("seq", "reno_year")


def first_project(plan: DataFrame) -> DataFrame:
    """First plan row per site."""
    from .keyed import keep_one
    return keep_one(plan, [PORTFOLIO, "name"], "position")


def plan_scenario(rows: DataFrame, preferred: tuple[str, ...] = ("ssp245_2050", "present")) -> DataFrame:
    """The rows of the first preferred scenario that every measure has rows for; none if there is no such scenario."""
    rank = reduce(lambda out, k: out.when(F.col("scenario") == preferred[k], k), range(len(preferred)), F).otherwise(None)
    every = rows.agg(F.count_distinct("measure").alias("_every"))
    whole = (rows.withColumn("_rank", rank).where("_rank is not null").groupBy("scenario", "_rank").agg(F.count_distinct("measure").alias("_n"))
             .join(F.broadcast(every), F.col("_n") == F.col("_every")))  # one row against a row per preferred scenario
    first = whole.agg(F.min_by("scenario", "_rank").alias("scenario"))
    return rows.join(F.broadcast(first), "scenario", "left_semi")


def payback_order(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows (by..., name, measure, averted, cost) with payback years and their position: shortest first, rows without one last."""
    payback = F.when(F.col("averted") > 0.0, F.col("cost") / F.col("averted"))
    known = rows.withColumn("payback_years", F.round(payback, 6))
    ranked = budget_ops.in_order(known, by, [F.col("payback_years").asc_nulls_last(), F.col("name").asc(), F.col("measure").asc()])
    return budget_ops.places(ranked, by, F.col("payback_years").isNull()).drop("seq")
