"""Exceedance curves, return-period losses and ranks without a one-task sort.

A running total by descending loss is taken in three levels of value buckets. Equal losses are
summed before the first shuffle, each bucket carries its own subtotal, and the windows run over
subtotals (a few hundred per key) or over the distinct losses of one narrow bucket. One key can
therefore hold any part of all rows and still be spread over the cluster.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import assumptions as A
from ..functions.common import by_shuffle

_EPS = 1e-12
_PER_OCTAVE = 8
_FINE = 4096
_OFFSET = 20000


def _coarse(v: Column) -> Column:
    mag = F.floor(F.log2(F.abs(v)) * _PER_OCTAVE) + _OFFSET
    return F.when(v > 0.0, mag).when(v < 0.0, -mag).otherwise(F.lit(0)).cast("long")


def _fine(v: Column, coarse: Column) -> Column:
    lower = F.pow(F.lit(2.0), (F.abs(coarse) - _OFFSET) / float(_PER_OCTAVE))
    step = F.floor((F.abs(v) / lower - 1.0) / (2.0 ** (1.0 / _PER_OCTAVE) - 1.0) * _FINE)
    return F.when(v > 0.0, step).when(v < 0.0, -step).otherwise(F.lit(0)).cast("long")


def cumulative(df: DataFrame, keys: list[str], value: str, amount: str, order: str | None = None, bounded: bool = False) -> DataFrame:
    """Distinct values per key, in descending order, with the total amount above each.

    Columns: keys, value, cum_before (amount strictly above), cum_first (after the first row of
    the value in `order`), cum_last (after all of them) and above (the next larger value).
    bounded: a key has at most a row for each event, as one centroid or one site has. Its rows are then sorted in one task, and all is
    shuffled once, where buckets take six shuffles.
    """
    first = F.min_by(amount, order) if order else F.sum(amount)
    if bounded:
        df = df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])).repartition(*keys)  # unknown keys match nothing in the joins of buckets either
    rows = df.groupBy(*keys, value).agg(F.sum(amount).alias("_amt"), first.alias("_first"))
    if bounded:
        w = Window.partitionBy(*keys).orderBy(F.col(value).desc())
        cum = F.coalesce(F.sum("_amt").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        done = rows.withColumn("cum_before", cum).withColumn("above", F.lag(value).over(w))
        return done.select(*keys, value, "cum_before", (F.col("cum_before") + F.col("_first")).alias("cum_first"),
                           (F.col("cum_before") + F.col("_amt")).alias("cum_last"), "above")
    rows = rows.withColumn("_b1", _coarse(F.col(value)))
    rows = rows.withColumn("_b2", _fine(F.col(value), F.col("_b1")))
    fine = rows.groupBy(*keys, "_b1", "_b2").agg(F.sum("_amt").alias("_amt"), F.min(value).alias("_low"))
    coarse = fine.groupBy(*keys, "_b1").agg(F.sum("_amt").alias("_amt"), F.min("_low").alias("_low"))

    def before(part: list[str], by: str):
        w = Window.partitionBy(*part).orderBy(F.col(by).desc())
        return w, w.rowsBetween(Window.unboundedPreceding, -1)

    w1, p1 = before(keys, "_b1")
    coarse = coarse.select(*keys, "_b1", F.coalesce(F.sum("_amt").over(p1), F.lit(0.0)).alias("_c1"),
                           F.lag("_low").over(w1).alias("_l1"))
    w2, p2 = before([*keys, "_b1"], "_b2")
    fine = fine.select(*keys, "_b1", "_b2", F.coalesce(F.sum("_amt").over(p2), F.lit(0.0)).alias("_c2"),
                       F.lag("_low").over(w2).alias("_l2"))
    base = fine.join(by_shuffle(coarse), [*keys, "_b1"]).select(
        *keys, "_b1", "_b2", (F.col("_c1") + F.col("_c2")).alias("_base"),
        F.coalesce("_l2", "_l1").alias("_low_above"))
    w3, p3 = before([*keys, "_b1", "_b2"], value)
    joined = rows.join(by_shuffle(base), [*keys, "_b1", "_b2"])
    cum = F.col("_base") + F.coalesce(F.sum("_amt").over(p3), F.lit(0.0))
    return (joined.withColumn("cum_before", cum)
            .withColumn("above", F.coalesce(F.lag(value).over(w3), F.col("_low_above")))
            .select(*keys, value, "cum_before",
                    (F.col("cum_before") + F.col("_first")).alias("cum_first"),
                    (F.col("cum_before") + F.col("_amt")).alias("cum_last"), "above"))


def loss_points(df: DataFrame, keys: list[str], loss: str = "loss", freq: str = "freq",
                order: str = "event_id", bounded: bool = False) -> DataFrame:
    """Exceedance points of positive losses with positive frequency."""
    live = df.where((F.col(freq) > 0.0) & (F.col(loss) > 0.0))
    return cumulative(live.select(*keys, loss, freq, order), keys, loss, freq, order, bounded)


def _at(points: DataFrame, keys: list[str], loss: str, rps: list[int], value) -> DataFrame:
    """Evaluate return periods against the points that bracket them, without a join."""
    targets = F.array(*[F.lit(rp) for rp in rps])
    hit = F.filter(targets, lambda rp: (F.lit(1.0) / rp > F.col("cum_before") + _EPS)
                   & (F.lit(1.0) / rp <= F.col("cum_last") + _EPS))
    found = points.withColumn("rp", F.explode(hit)).withColumn("_value", value(F.col("rp")))
    rung = lambda rp: F.coalesce(F.max(F.when(F.col("rp") == rp, F.col("_value"))), F.lit(0.0))
    return found.groupBy(*keys).agg(F.array(*[rung(rp) for rp in rps]).alias("ladder"))


def step_ladder(points: DataFrame, keys: list[str], loss: str = "loss",
                rps: list[int] = A.LADDER_RPS) -> DataFrame:
    """Array of losses at return periods, step convention: the loss whose cumulative frequency
    first reaches 1/rp, else 0. Keys without any hit are absent (all zero)."""
    return _at(points, keys, loss, rps, lambda rp: F.col(loss))


def interpolated_ladder(points: DataFrame, keys: list[str], loss: str = "loss",
                        rps: list[int] = A.RETURN_PERIODS) -> DataFrame:
    """Array of losses at return periods, linear in ln(return period) with a flat rare tail."""
    def value(rp: Column) -> Column:
        top, here = F.lit(1.0) / F.col("cum_before"), F.lit(1.0) / F.col("cum_first")
        t = (F.log(rp.cast("double")) - F.log(here)) / (F.log(top) - F.log(here))
        flat = F.col("above").isNull() | (F.lit(1.0) / rp >= F.col("cum_first") - _EPS)
        return F.when(flat, F.col(loss)).otherwise(F.col(loss) + t * (F.col("above") - F.col(loss)))
    return _at(points, keys, loss, rps, value)


def explode_ladder(df: DataFrame, rps: list[int], column: str = "ladder", name: str = "loss") -> DataFrame:
    """Array ladder to long rows (rp, loss)."""
    pairs = F.arrays_zip(F.array(*[F.lit(rp) for rp in rps]).alias("rp"), F.col(column).alias("value"))
    rest = [c for c in df.columns if c != column]
    return (df.select(*rest, F.explode(pairs).alias("_p"))
            .select(*rest, F.col("_p.rp").alias("rp"), F.col("_p.value").alias(name)))


def dense_ladder(universe: DataFrame, ladders: DataFrame, keys: list[str],
                 rps: list[int] = A.LADDER_RPS) -> DataFrame:
    """One ladder per universe row; keys that never reached a rung read zeros."""
    zeros = F.array(*[F.lit(0.0) for _ in rps])
    return (universe.join(by_shuffle(ladders), keys, "left")
            .withColumn("ladder", F.coalesce(F.col("ladder"), zeros)))


def value_at_rank(df: DataFrame, keys: list[str], value: str, position) -> DataFrame:
    """The value at an ascending 0-based position, chosen per key from its row count.

    `position` maps the count column to a position column, for example floor(0.995 * n).
    """
    counted = df.where(F.col(value).isNotNull()).withColumn("_one", F.lit(1.0))
    k = keys or ["_all"]
    if not keys:
        counted = counted.withColumn("_all", F.lit(1))
    points = cumulative(counted, k, value, "_one")
    n = counted.groupBy(*k).agg(F.count("*").alias("n"))
    from_top = F.col("n") - position(F.col("n"))
    hit = (F.col("cum_before") < from_top) & (F.col("cum_last") >= from_top)
    out = points.join(n, k).where(hit).select(*k, "n", F.col(value))
    return out if keys else out.drop("_all")


def floor_rank(p: float):
    """Nearest-rank position floor(p * n), kept inside the list."""
    return lambda n: F.least(F.floor(n * p).cast("long"), n - 1)
