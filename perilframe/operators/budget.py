"""Sequential budget filling as distributed halving phases.

Actions come in a fixed order; each takes the first budget line on its list of wishes that still has room for it. One
action after another this is a chain as long as the table. Here a phase settles many actions at once: while a line has more
than half of what it had when the phase began, every action of at most that half fits for certain, and none that cost more
than the whole fits. Only actions in between are in doubt. Under the guess that no doubtful action fits, the lines' running
totals are prefix sums, and the guess holds up to the first action that does fit where it was doubtful, or that takes a line
to its half. Up to there all is settled; there a line loses half of its money. Rounds grow with the logarithm of budget over
least cost, times the lines, never with the rows.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import written

BLOCK_BITS = 12  # consecutive actions whose running totals one window sees
ALONE = 4096  # actions of a group that are left, up to which one task settles them in order


def cents(money: Column) -> Column:
    """Money in whole cents, so that sums don't depend on their order."""
    return F.round(money * 100.0).cast("long")


def in_order(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """rows with seq, a number that rises in `order` within each group. The order must be total."""
    keys = [*[F.col(c).asc() for c in by], *order]
    return written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("seq", F.monotonically_increasing_id()))


def _lines(n: int) -> list[str]:
    return [f"l{y}" for y in range(1, n + 1)]


def _first(n: int, fits) -> Column:
    """The wished line where `fits`, else the first line where it does."""
    wish = reduce(lambda out, y: out.when((F.col("wish") == y) & fits(y), y), range(1, n + 1), F)
    return F.coalesce(wish.otherwise(None), *[F.when(fits(y), y) for y in range(1, n + 1)]).cast("int")


def _guess(n: int) -> Column:
    """The line that an action takes if no doubtful one has room: the first whose half is enough."""
    return _first(n, lambda y: F.col("cents") * 2 <= F.col(f"l{y}"))


def fill(items: DataFrame, by: list[str], budgets: list[int], alone: int = ALONE) -> DataFrame:
    """items (by..., seq, cents, wish) -> (seq, line): the line from 1 that each action takes, null if it fits none.

    budgets are the lines' cents, the same for each group. An action tries its wish, if it has one, then the lines in
    order. Equal to settling actions one by one in the order of seq. Groups may hold any share of the rows; one window sees
    a block of 2^BLOCK_BITS actions or the subtotals of a group's blocks. What is left of a group when no more than `alone`
    actions can still fit is settled in order by one task.
    """
    n = len(budgets)
    lines, sums = _lines(n), [f"b{y}" for y in range(1, n + 1)]
    items = items.select(*by, "seq", "cents", "wish").withColumn("block", F.shiftright("seq", BLOCK_BITS))
    state = written(items.select(*by).distinct().select(*by, F.lit(-1).cast("long").alias("after"), *[F.lit(b).cast("long").alias(x) for x, b in zip(lines, budgets, strict=True)]))
    phases = tails = None
    while not state.isEmpty():
        live = items.join(state, by).where((F.col("seq") > F.col("after")) & (F.col("cents") <= F.greatest(*lines, F.lit(-1).cast("long")))).withColumn("guess", _guess(n))
        taken = lambda y: F.when(F.col("guess") == y, F.col("cents")).otherwise(0)
        doubt = lambda y: F.when((F.col("cents") * 2 > F.col(f"l{y}")) & (F.col("cents") <= F.col(f"l{y}")), F.col("cents"))
        each = live.groupBy(*by, "after", *lines, "block").agg(F.count(F.lit(1)).alias("rows"), *[F.sum(taken(y)).alias(f"s{y}") for y in range(1, n + 1)],
                                                               *[F.min(doubt(y)).alias(f"m{y}") for y in range(1, n + 1)])
        sofar = Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        whole = Window.partitionBy(*by)
        halved = lambda total, y: (total * 2 >= F.col(f"l{y}")) & (total > 0)
        blocks = each.select("*", F.sum("rows").over(whole).alias("left"), *[F.coalesce(F.sum(f"s{y}").over(sofar), F.lit(0)).alias(b) for y, b in enumerate(sums, 1)])
        sure = reduce(Column.__or__, [halved(F.col(f"b{y}") + F.col(f"s{y}"), y) for y in range(1, n + 1)])
        may = reduce(Column.__or__, [F.coalesce(F.col(f"m{y}") <= F.col(f"l{y}") - F.col(f"b{y}"), F.lit(False)) for y in range(1, n + 1)])
        blocks = written(blocks.withColumn("sure", sure).withColumn("end", F.min(F.when(F.col("sure"), F.col("block"))).over(whole)).withColumn("may", may))

        few = blocks.where(F.col("left") <= alone).select(*by, "after", *lines).distinct()
        tails = few if tails is None else tails.unionByName(few)
        some = blocks.where((F.col("left") > alone) & (F.col("sure") | F.col("may")) & (F.col("end").isNull() | (F.col("block") <= F.col("end"))))
        prior = Window.partitionBy(*by, "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
        run = live.join(some.select(*by, "block", *sums), [*by, "block"])
        run = run.select(*[c for c in run.columns if c not in sums], *[(F.col(b) + F.coalesce(F.sum(taken(y)).over(prior), F.lit(0))).alias(b) for y, b in enumerate(sums, 1)])
        run = run.withColumn("real", _first(n, lambda y: F.col("cents") <= F.col(f"l{y}") - F.col(f"b{y}")))
        ends = ~F.col("real").eqNullSafe(F.col("guess")) | reduce(
            Column.__or__, [F.coalesce(F.col("guess") == y, F.lit(False)) & halved(F.col(f"b{y}") + F.col("cents"), y) for y in range(1, n + 1)])
        event = run.where(ends).groupBy(*by).agg(F.min(F.struct("seq", "real", "cents", *sums)).alias("e"))
        groups = blocks.where(F.col("left") > alone).select(*by, "after", *lines).distinct()
        log = written(groups.join(event, by, "left").select(*by, "after", F.col("e.seq").alias("upto"), F.col("e.real").alias("real"), *lines,
                                                        *[(F.col(f"e.b{y}") + F.when(F.col("e.real") == y, F.col("e.cents")).otherwise(0)).alias(f"spent{y}") for y in range(1, n + 1)]))
        phases = log if phases is None else phases.unionByName(log)
        state = log.where(F.col("upto").isNotNull()).select(*by, F.col("upto").alias("after"), *[(F.col(x) - F.col(f"spent{y}")).alias(x) for y, x in enumerate(lines, 1)])
    if phases is None:  # no groups
        return items.select("seq", F.lit(None).cast("int").alias("line"))
    # A group's phases are as many as the lines' money can be halved.
    listed = phases.groupBy(*by).agg(F.collect_list(F.struct("after", "upto", "real", *lines)).alias("phases"))
    mine = F.filter("phases", lambda p: (F.col("seq") > p["after"]) & (p["upto"].isNull() | (F.col("seq") <= p["upto"])))
    ruled = items.join(listed, by, "left").withColumn("p", F.get(mine, 0)).select("seq", "cents", "wish", "p.*")
    settled = ruled.select("seq", F.when(F.col("seq") == F.col("upto"), F.col("real")).otherwise(_guess(n)).alias("line"))
    rest = items.join(tails, by).where((F.col("seq") > F.col("after")) & (F.col("cents") <= F.greatest(*lines, F.lit(-1).cast("long"))))
    late = _in_sequence(rest, by, n).select("seq", F.col("line").alias("late"))
    return settled.join(late, "seq", "left").select("seq", F.coalesce("line", "late").alias("line"))


def _in_sequence(rows: DataFrame, by: list[str], n: int) -> DataFrame:
    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        left = {y: int(pdf[f"l{y}"].iloc[0]) for y in range(1, n + 1)}
        chosen = []
        for cost, wish in zip(pdf["cents"], pdf["wish"], strict=True):
            line = next((y for y in ([int(wish)] if pd.notna(wish) else []) + list(left) if cost <= left.get(y, -1)), None)
            if line is not None:
                left[line] -= int(cost)
            chosen.append(line)
        return pd.DataFrame({"seq": pdf["seq"], "line": pd.array(chosen, dtype="Int32")})

    return rows.groupBy(*by).applyInPandas(settle, "seq long, line int")


def places(rows: DataFrame, by: list[str], last: Column) -> DataFrame:
    """rows (by..., seq) with position: 1, 2, ... in the order of seq, rows where `last` holds behind all others.

    Counts of blocks are summed in order, then rows within a block; no window sees more than either.
    """
    rows = rows.withColumn("_last", last).withColumn("_block", F.shiftright("seq", BLOCK_BITS))
    each = rows.groupBy(*by, "_last", "_block").agg(F.count(F.lit(1)).alias("_n"))
    sofar = Window.partitionBy(*by).orderBy("_last", "_block").rowsBetween(Window.unboundedPreceding, -1)
    before = each.select(*by, "_last", "_block", F.coalesce(F.sum("_n").over(sofar), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*by, "_last", "_block").orderBy("seq"))
    return rows.join(before, [*by, "_last", "_block"]).withColumn("position", (F.col("_before") + inside).cast("long")).drop("_last", "_block", "_before")
