"""Business interruption of one loss: downtime, seasonal revenue and policy terms.

The seasonal calendar walk has a closed form. A window of d days starting with month m covers
q = floor(d / month) whole months, so its revenue-weighted length is a prefix sum plus a part
of one month. Its expectation over arrival months is the same formula on averaged tables.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import assumptions as A

_MAX_DAYS = A.BI_MAX_MONTHS * A.BI_MONTH_DAYS


def downtime_days(damage: Column, anchor_days: Column) -> Column:
    """Damage ratio to downtime: piecewise share of the reopening anchor, then the structural floor."""
    nodes = A.BI_DOWNTIME_NODES
    frac = F
    for (x0, y0), (x1, y1) in zip(nodes, nodes[1:]):
        frac = frac.when(damage <= x1, (damage - x0) * (y1 - y0) / (x1 - x0) + y0)
    days = frac.otherwise(1.0) * anchor_days
    floored = F.when(damage >= A.BI_IMPEDING_DAMAGE, F.greatest(days, F.lit(A.BI_IMPEDING_DAYS))).otherwise(days)
    return F.when((damage > 0.0) & (anchor_days > 0.0), floored).otherwise(0.0)


def _prefix(shape: list[float]) -> list[float]:
    out = [0.0]
    for w in shape + shape:
        out.append(out[-1] + w)
    return out


def _averaged(shape: list[float], timing: list[float]) -> tuple[list[float], list[float]]:
    """Prefix sums and month weights averaged over arrival months."""
    pre = _prefix(shape)
    cum = [sum(w * (pre[m + r] - pre[m]) for m, w in enumerate(timing)) for r in range(12)]
    month = [sum(w * shape[(m + r) % 12] for m, w in enumerate(timing)) for r in range(12)]
    return cum, month


def _by_region(region: Column, tables: dict[str, list[float]]) -> Column:
    return A.lookup(region, tables, F.expr(A.sql_literal(tables["global_mean"])))


def _walk(days: Column, year_sum: Column, cum_of, month_of) -> Column:
    d = F.least(days, F.lit(_MAX_DAYS))
    q = F.floor(d / A.BI_MONTH_DAYS)
    rest = (q % 12).cast("int")
    whole = F.floor(q / 12).cast("double") * year_sum + cum_of(rest)
    return whole * A.BI_MONTH_DAYS + (d - q * A.BI_MONTH_DAYS) * month_of(rest)


def season_days(region: Column, month: Column, days: Column) -> Column:
    """Revenue-weighted days of a downtime window that starts with a month (0-11)."""
    pre = _by_region(region, {r: _prefix(s) for r, s in A.BI_SEASON.items()})
    m = month.cast("int")
    return _walk(days, F.get(pre, F.lit(12)),
                 lambda rest: F.get(pre, m + rest) - F.get(pre, m),
                 lambda rest: F.get(pre, m + rest + 1) - F.get(pre, m + rest))


def expected_season_days(region: Column, timing: list[float], days: Column) -> Column:
    """Mean of season_days over the arrival months of a peril."""
    tables = {r: _averaged(s, timing) for r, s in A.BI_SEASON.items()}
    cum = _by_region(region, {r: t[0] for r, t in tables.items()})
    month = _by_region(region, {r: t[1] for r, t in tables.items()})
    year = A.lookup(region, {r: sum(s) * sum(timing) for r, s in A.BI_SEASON.items()},
                    sum(A.BI_SEASON["global_mean"]) * sum(timing))
    return _walk(days, year, lambda r: F.get(cum, r), lambda r: F.get(month, r))


def damage_ratio(loss: Column, value: Column) -> Column:
    return F.when(value > 0.0, F.least(F.greatest(loss, F.lit(0.0)) / value, F.lit(1.0))).otherwise(0.0)


def split_at_month(loss: Column, econ: dict[str, Column], month: Column) -> Column:
    """struct(gross, waiting, overage, retained, down_days) of one loss arriving in a month."""
    down = downtime_days(damage_ratio(loss, econ["value"]), econ["anchor_days"])
    seg = lambda d: season_days(econ["region"], month, d)
    return _terms(seg, down, econ["daily"], econ["limit"])


def _terms(seg, down: Column, daily: Column, limit: Column) -> Column:
    gross = daily * seg(down)
    waiting = daily * seg(F.least(down, F.lit(A.BI_WAITING_DAYS)))
    beyond = daily * (seg(down) - seg(F.least(down, F.lit(A.BI_INDEMNITY_DAYS))))
    insurable = F.greatest(gross - waiting - beyond, F.lit(0.0))
    over = F.coalesce(F.greatest(insurable - limit, F.lit(0.0)), F.lit(0.0))
    closed = down <= 0.0
    zero = F.lit(0.0)
    pick = lambda x: F.when(closed, zero).otherwise(x)
    return F.struct(pick(gross).alias("gross"), pick(waiting).alias("waiting"),
                    pick(beyond + over).alias("overage"),
                    pick(waiting + beyond + over).alias("retained"), down.alias("down_days"))


def split_expected(loss: Column, econ: dict[str, Column], timing: list[float]) -> Column:
    """The policy split of one loss, averaged over the arrival months of its peril.

    Everything but the limit is linear in the seasonal days and uses the averaged tables; only
    a site with a limit pays for the month-by-month part. Downtime is a Column expression; the
    seasonal walks run over Arrow batches, since as one generated method they pass the size the
    JVM compiles.
    """
    down = downtime_days(damage_ratio(loss, econ["value"]), econ["anchor_days"])
    return _split_udf(tuple(float(w) for w in timing))(down, econ["daily"], econ["limit"], econ["region"])


def _region_codes() -> dict[str, int]:
    """Rows of the seasonal tables; the first serves regions that have none."""
    return {r: i for i, r in enumerate(["global_mean", *[r for r in A.BI_SEASON if r != "global_mean"]])}


def _season_split(timing: tuple[float, ...]):
    """f(days, daily value, limit, region code): gross, waiting and overage, averaged over arrival months, of numpy columns.

    It holds plain numbers only, so that a task needs no module of this package.
    """
    month, most, waits, covers = A.BI_MONTH_DAYS, _MAX_DAYS, A.BI_WAITING_DAYS, A.BI_INDEMNITY_DAYS
    regions = list(_region_codes())
    shapes = [list(A.BI_SEASON[r]) for r in regions]
    cum, per = (np.array(t) for t in zip(*[_averaged(s, list(timing)) for s in shapes]))
    year = np.array([sum(s) * sum(timing) for s in shapes])
    pre = np.array([_prefix(s) for s in shapes])
    months = [(m, w) for m, w in enumerate(timing) if w > 0.0]

    def steps(days):
        d = np.minimum(days, most)
        q = np.floor(d / month)
        return np.floor(q / 12), (q % 12).astype(int), d - q * month

    def split(days, usd, cap, at):
        def seg(d):
            years, rest, part = steps(d)
            return (years * year[at] + cum[at, rest]) * month + part * per[at, rest]

        wait, cover = np.minimum(days, waits), np.minimum(days, covers)
        total = seg(days)
        gross, waiting, beyond = usd * total, usd * seg(wait), usd * (total - seg(cover))
        over, k = np.zeros(len(days)), np.flatnonzero(~np.isnan(cap) & (days > 0.0))
        table, walks = pre[at[k]], [steps(x[k]) for x in (cover, wait)]
        row = np.arange(len(k))
        for m, w in months:
            a, b = [(years * table[:, 12] + (table[row, m + rest] - table[:, m])) * month
                    + part * (table[row, m + rest + 1] - table[row, m + rest]) for years, rest, part in walks]
            over[k] = over[k] + w * np.maximum(np.maximum(usd[k] * (a - b), 0.0) - cap[k], 0.0)
        return gross, waiting, beyond + over

    return split


def _split_udf(timing: tuple[float, ...]):
    """split_expected of (downtime days, daily value, limit, region)."""
    terms, code, whole = _season_split(timing), _region_codes(), float(sum(timing))

    @F.pandas_udf("gross double, waiting double, overage double, retained double, down_days double")
    def split(down: pd.Series, daily: pd.Series, limit: pd.Series, region: pd.Series) -> pd.DataFrame:
        days, usd, cap = (x.to_numpy(float) for x in (down, daily, limit))
        gross, waiting, overage = terms(days, usd, cap, region.map(code).fillna(0).to_numpy(int))
        return pd.DataFrame({"gross": gross, "waiting": waiting, "overage": overage,
                             "retained": waiting + overage, "down_days": days * whole})

    return split


def split_ladder(ladder: Column, econ: dict[str, Column], storm: Column) -> Column:
    """struct(gross, waiting, overage, retained): split_expected of every rung of a loss ladder, integrated over frequency.

    `storm` tells whether the ladder's losses arrive in storm months. A ladder is one row of an Arrow batch: as a row
    for each rung, it meets the split of both timings eight times and has to be shuffled together again.
    """
    rungs = [F.get(ladder, F.lit(i)) for i in range(len(A.LADDER_RPS))]
    terms = [econ[k].cast("double") for k in ("value", "daily", "anchor_days", "limit")]
    return _ladder_udf()(*[x.cast("double") for x in rungs], *terms, econ["region"], F.coalesce(storm, F.lit(False)))


@cache
def _ladder_udf():
    f = [1.0 / rp for rp in A.LADDER_RPS]
    # value * weight summed over rungs equals the trapezoid with a closed tail
    weights = [0.5 * (f[max(i - 1, 0)] - f[min(i + 1, len(f) - 1)]) for i in range(len(f))]
    weights[-1] += f[-1]
    n, code, nodes = len(f), _region_codes(), list(A.BI_DOWNTIME_NODES)
    impeding, impeding_days = A.BI_IMPEDING_DAMAGE, A.BI_IMPEDING_DAYS
    seasons = [(timed, _season_split(tuple(float(w) for w in months)))
               for timed, months in ((True, A.BI_STORM_MONTHS), (False, A.BI_FLAT_MONTHS))]

    def downtime(damage, anchor):
        share, left = np.ones(len(damage)), np.ones(len(damage), bool)
        for (x0, y0), (x1, y1) in zip(nodes, nodes[1:]):
            here = left & (damage <= x1)
            share[here] = (damage[here] - x0) * (y1 - y0) / (x1 - x0) + y0
            left &= ~here
        days = share * anchor
        days = np.where(damage >= impeding, np.fmax(days, impeding_days), days)
        return np.where((damage > 0.0) & (anchor > 0.0), days, 0.0)

    @F.pandas_udf("gross double, waiting double, overage double, retained double")
    def integrated(*given: pd.Series) -> pd.DataFrame:
        losses = [c.to_numpy(float) for c in given[:n]]
        value, usd, anchor, cap = (c.to_numpy(float) for c in given[n:n + 4])
        at, storm = given[n + 4].map(code).fillna(0).to_numpy(int), given[n + 5].to_numpy(bool)
        out = np.zeros((3, len(usd)))
        with np.errstate(all="ignore"):
            for timed, terms in seasons:
                k = np.flatnonzero(storm == timed)
                for loss, w in zip(losses, weights) if len(k) else ():
                    damage = np.where(value[k] > 0.0, np.fmin(np.fmax(loss[k], 0.0) / value[k], 1.0), 0.0)
                    out[:, k] += w * np.stack(terms(downtime(damage, anchor[k]), usd[k], cap[k], at[k]))
        gross, waiting, overage = out
        return pd.DataFrame({"gross": gross, "waiting": waiting, "overage": overage, "retained": waiting + overage})

    return integrated


def monthly_retained(loss: Column, econ: dict[str, Column]) -> Column:
    """array<double>[12]: retained interruption by arrival month."""
    return F.transform(F.sequence(F.lit(0), F.lit(11)),
                       lambda m: split_at_month(loss, econ, m)["retained"])


def arrival_month(u: Column, timing: list[float]) -> Column:
    """Month index whose cumulative weight first reaches a uniform draw."""
    out, acc = F, 0.0
    for m, w in enumerate(timing[:-1]):
        acc += w
        out = out.when(u <= acc, F.lit(m))
    return out.otherwise(11)


def economics(scale_reopen: float = 1.0) -> dict[str, Column]:
    """Interruption economics of a site row that carries revenue, margin and reopening columns."""
    gop = F.col("revenue_usd") * F.col("gop_margin")
    timeshare = F.least(F.greatest(F.coalesce(F.col("timeshare_share"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return {
        "bi_value": F.col("asset_value_usd"),
        "bi_daily": gop / 365.0 * (F.lit(1.0) - timeshare * A.BI_TIMESHARE_CONTINUING),
        "bi_anchor_days": F.col("reopen_months") * scale_reopen / 12.0 * 365.0,
        "bi_limit": F.when(F.col("bi_ee_usd") > 0.0, F.col("bi_ee_usd")),
    }


def econ_of(prefix: str = "bi_") -> dict[str, Column]:
    """The stored economics columns as arguments of the split functions."""
    return {k: F.col(prefix + k) for k in ("value", "daily", "anchor_days", "limit", "region")}


def timing_of(peril: str) -> list[float]:
    return A.BI_STORM_MONTHS if peril in A.STORM_TIMED else A.BI_FLAT_MONTHS
