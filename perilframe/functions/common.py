"""Small Column helpers shared by the function modules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_shuffle(df: DataFrame) -> DataFrame:
    """The frame as a side of a join by shuffle, for tables that grow with the portfolio or the event sets.

    Spark takes a side for small by the bytes of its files or of its compressed shuffle; exploded and well compressed
    rows take many times that in the driver, through which a broadcast goes.
    """
    return df.hint("merge")


def may_match(df: DataFrame, col: str, wanted: DataFrame, bits: int = 1 << 24) -> DataFrame:
    """Rows of df whose `col` may be among the values of wanted (one column), to be joined with them afterwards.

    A bitmap of `bits` bits goes to every task, 64 to a row, so at most bits / 64 rows however many values there are. Rows
    that match nothing then need no shuffle: the semi join is planned below the aggregation that makes df, where col is
    one of its keys. Where the bitmap fills up, more rows pass, and the join decides.
    """
    value = wanted.columns[0]
    same = df.schema[col].dataType == wanted.schema[value].dataType
    at = lambda c: F.pmod(F.xxhash64(c if same else c.cast("string")), F.lit(bits))
    bit = lambda place: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))
    row = lambda place: F.floor(place / 64).cast("long")
    known = wanted.where(F.col(value).isNotNull())
    map_ = known.groupBy(row(at(F.col(value))).alias("_row64")).agg(F.bit_or(bit(at(F.col(value)))).alias("_map64"))
    here = at(df[col])
    return df.join(F.broadcast(map_), (row(here) == F.col("_row64")) & (F.col("_map64").bitwiseAND(bit(here)) != 0), "left_semi")


def total(cols: list[Column]) -> Column:
    """Left-to-right sum of columns."""
    return reduce(lambda a, b: a + b, cols)


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def blank_to_null(x: Column) -> Column:
    """Trimmed text, null when empty."""
    t = F.trim(x.cast("string"))
    return F.when(t != "", t)


def finite_or_null(x: Column) -> Column:
    """NaN and infinities become null; everything else is kept."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def money(x: Column, places: int = 2) -> Column:
    """Half-even rounding used at every sink."""
    return F.bround(x, places)


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the whole is 0 or absent."""
    return F.when(whole != 0, part / whole).otherwise(0.0)
