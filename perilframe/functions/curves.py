"""Hazard-to-damage curves and return-period integrals, as expressions over columns."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import assumptions as A
from .common import total

Rung = Callable[[Column], Column]


def wind_damage(v: Column, v_half: Column | float = A.V_HALF) -> Column:
    """Cubic wind damage ratio t^3 / (1 + t^3) above the threshold speed."""
    half = v_half if isinstance(v_half, Column) else F.lit(v_half)
    t = F.greatest((v - A.V_THRESH) / (half - A.V_THRESH), F.lit(0.0))
    # 1 - 1 / (1 + t^3) names t once, which keeps the generated code of wide rows small
    return F.lit(1.0) - F.lit(1.0) / (F.pow(t, F.lit(3.0)) + 1.0)


def flood_damage(depth: Column, freeboard: Column, cap: Column | float = A.FLOOD_CAP) -> Column:
    """Concave stage damage above freeboard, capped."""
    top = cap if isinstance(cap, Column) else F.lit(cap)
    over = F.greatest(depth - freeboard, F.lit(0.0))
    return F.least(top, F.lit(1.0) - F.exp(over * -0.6))


def ponding_depth(mm: Column) -> Column:
    """Event rainfall (mm) to ponding depth (m) after site drainage."""
    return F.greatest(mm - A.RAIN_DRAIN_MM, F.lit(0.0)) / 1000.0 * A.RAIN_POND


def depth_at_structure(depth: Column, relief: Column) -> Column:
    """Shift a wet depth by the site's relief; dry stays dry, unknown relief changes nothing."""
    shifted = F.when(depth > 0.0, F.greatest(depth - relief, F.lit(0.0))).otherwise(0.0)
    return F.when(relief.isNull(), depth).otherwise(shifted)


def flame_damage(cfl_ft: Column) -> Column:
    """Flame length (ft) to conditional damage; a band edge takes the lower band."""
    out = F
    for edge, ratio in zip(A.FLAME_BANDS_FT, A.FLAME_RATIOS):
        out = out.when(cfl_ft <= edge, F.lit(ratio))
    return out.otherwise(F.lit(A.FLAME_RATIOS[-1]))


def band_of(pct: Column) -> Column:
    """Severity band of an annual loss in percent of value."""
    return (F.when(pct >= 1.5, "Severe").when(pct >= 0.75, "High").when(pct >= 0.25, "Moderate")
            .when(pct > 0.001, "Low").otherwise("Minimal"))


def heat_band(days: Column) -> Column:
    """Severity band of days over 32 C."""
    return (F.when(days > 160, "Severe").when(days > 100, "High").when(days > 45, "Moderate")
            .when(days > 10, "Low").otherwise("Minimal"))


def annuity(years: int, rate: float) -> float:
    """Present value of one unit a year."""
    return sum((1.0 + rate) ** -t for t in range(1, years + 1))


def sub_ten(v10: Column, v25: Column) -> dict[int, Column]:
    """Log-linear extension of a return-period vector to 1-in-5 and 1-in-2.

    The slope is never negative, so the extension never exceeds the 1-in-10 value.
    """
    base = F.greatest(v10, F.lit(0.0))
    slope = F.greatest((F.greatest(v25, F.lit(0.0)) - base) / (math.log(25) - math.log(10)),
                       F.lit(0.0))
    return {rp: F.greatest(base - slope * (math.log(10) - math.log(rp)), F.lit(0.0))
            for rp in (2, 5)}


def trapezoid(by_rp: dict[int, Column], f_min: float = 0.0) -> Column:
    """Integral over exceedance frequency of values at return periods, flat tail closed."""
    rungs = [rp for rp in sorted(by_rp) if 1.0 / rp >= f_min]
    if not rungs:
        return F.lit(0.0)
    parts = [(by_rp[a] + by_rp[b]) * 0.5 * (1.0 / a - 1.0 / b) for a, b in zip(rungs, rungs[1:])]
    last = max(by_rp)
    if f_min <= 1.0 / last:
        parts.append(by_rp[last] * (1.0 / last))
    return total(parts) if parts else F.lit(0.0)


def batch_integral() -> Callable:
    """f(vec, damage): expected annual damage fractions of intensity vectors (return period x row), frequent events included.

    It holds plain numbers only, so that a task needs no module of this package.
    """
    rps = [2, 5, *A.RETURN_PERIODS]
    f = [1.0 / rp for rp in rps]
    weights = [0.5 * (f[max(i - 1, 0)] - f[min(i + 1, len(f) - 1)]) for i in range(len(f))]
    weights[-1] += f[-1]
    gap, below = math.log(25) - math.log(10), [math.log(10) - math.log(rp) for rp in (2, 5)]

    def integral(vec: np.ndarray, damage: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        base = np.fmax(vec[0], 0.0)
        slope = np.fmax((np.fmax(vec[1], 0.0) - base) / gap, 0.0)
        out = np.zeros(vec.shape[1])
        for x, w in zip([*[np.fmax(base - slope * b, 0.0) for b in below], *vec], weights, strict=True):
            out = out + damage(x) * w
        return out

    return integral


# --- loss ladders: array<double>, one entry per LADDER_RPS rung -------------------------------

def ladder_points(ladder: Column, transform: Rung | None = None) -> dict[int, Column]:
    t = transform or (lambda loss: loss)
    return {rp: t(F.greatest(F.coalesce(F.get(ladder, F.lit(i)), F.lit(0.0)), F.lit(0.0)))
            for i, rp in enumerate(A.LADDER_RPS)}


def ladder_integral(ladder: Column, transform: Rung | None = None, f_min: float = 0.0) -> Column:
    """Annual expectation of a transformed loss ladder."""
    return trapezoid(ladder_points(ladder, transform), f_min)


def ladder_freq_at(ladder: Column, threshold: float) -> Column:
    """Largest exceedance frequency at which the ladder reaches a threshold, else 0."""
    out = F
    for i, rp in enumerate(A.LADDER_RPS):
        out = out.when(F.coalesce(F.get(ladder, F.lit(i)), F.lit(0.0)) >= threshold, F.lit(1.0 / rp))
    return out.otherwise(0.0)


def capped(limit: float) -> Rung:
    return lambda loss: F.least(loss, F.lit(float(limit)))


def interim_ladder(loss_by_rp: dict[int, Column]) -> Column:
    """Loss ladder from six return-period losses, extended below 1-in-10 in loss space."""
    low = sub_ten(loss_by_rp[10], loss_by_rp[25])
    return F.array(low[2], low[5],
                   *[F.greatest(loss_by_rp[rp], F.lit(0.0)) for rp in A.RETURN_PERIODS])


def layer_parts(curve: dict[int, Column], attach: Column, exhaust: Column) -> tuple[Column, Column, Column]:
    """(below, layer, whole) integrals of an exceedance curve split at two losses."""
    width = F.greatest(exhaust - attach, F.lit(0.0))
    below = trapezoid({rp: F.least(v, attach) for rp, v in curve.items()})
    layer = trapezoid({rp: F.least(F.greatest(v - attach, F.lit(0.0)), width)
                       for rp, v in curve.items()})
    return below, layer, trapezoid(curve)
