"""Embedding whitening: exact centred scatter, pivoted Cholesky, one-sided Jacobi on the triangular factor."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 64, 1_000_000  # an entry c counts as the integer floor(SCALE * c) + SHIFT
COMPONENTS = 32  # components that are returned, by falling eigenvalue
EXACT = 2.0**53  # integers that a double holds exactly
ROWS = 4096  # rows of a batch that are multiplied at once
LONG = np.longdouble
PRIMES = (2_147_483_647, 2_147_483_629)


class Fit(NamedTuple):
    """n rows of the fit list with the sums S, the whole eigenvalues and components (columns), and the trace of V."""
    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float


def usable(vector: Column) -> Column:
    """The vector is there and none of its entries is null or not finite."""
    return vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))


def vectors_of(rows: DataFrame) -> DataFrame:
    """(vec_id, x) of the usable rows, x being the integers as a list of long."""
    entry = lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT
    kept = rows.select("vec_id", F.col("embedding").alias("v")).where(usable(F.col("v")))
    return kept.select("vec_id", F.transform("v", entry).alias("x"))


def matrix_of(column: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def products(y: np.ndarray) -> np.ndarray:
    """The sum of y y' over rows, as exact Python integers: in doubles where no sum can leave their exact range."""
    most = float(np.abs(y).max(initial=0))
    if most * most * len(y) < EXACT:
        z = y.astype(np.float64)
        return (z.T @ z).astype(np.int64).astype(object)
    z = y.astype(object)
    return z.T @ z


def sums_of(x: DataFrame) -> tuple[int, list[int]]:
    """Count and per-dimension sums of the vectors of the commonest length, the longer one on ties."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[int, int] = {}
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = batch.column(0).value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(sizes):
                part = matrix_of(batch.column(0).filter(pa.array(sizes == d)))
                high, low = part >> 20, part & 0xFFFFF  # neither half can overflow within a batch
                count[d] = count.get(d, 0) + len(part)
                total[d] = total.get(d, 0) + high.sum(0).astype(object) * (1 << 20) + low.sum(0).astype(object)
        for d, n in count.items():
            made = [(int(d), i, n, str(total[d][i])) for i in range(d)] or [(0, 0, n, "0")]
            yield pa.RecordBatch.from_pylist([dict(zip(("d", "i", "n", "s"), r, strict=True)) for r in made],
                                             pa.schema([("d", pa.int32()), ("i", pa.int32()), ("n", pa.int64()), ("s", pa.string())]))

    parts = x.select("x").mapInArrow(run, "d int, i int, n long, s string")
    found = parts.groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).cast("string").alias("s")).collect()  # a row for each dimension
    if not found:
        return 0, []
    n, d = max((r.n, r.d) for r in found)
    return n, [int(r.s) for r in sorted(found, key=lambda r: r.i) if r.d == d][:d]


def scatter_of(x: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """n^2 V in exact integers.

    Vectors are centred at the integers next to the means before they are multiplied; the rest of the mean, less than one,
    is taken off exactly afterwards. Each task sends one sum for each pair of dimensions, whatever its rows are.
    """
    d = len(sums)
    middle = [(2 * s + n) // (2 * n) for s in sums]
    upper = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d), object)
        centre = np.array(middle, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                total = total + products(matrix_of(batch.column(0).slice(at, ROWS)) - centre)
        at = [k for k in range(len(upper[0])) if total[upper[0][k], upper[1][k]]]
        yield pa.RecordBatch.from_arrays([pa.array(upper[0][at], pa.int32()), pa.array(upper[1][at], pa.int32()),
                                          pa.array([str(total[upper[0][k], upper[1][k]]) for k in at], pa.string())], ["i", "j", "p"])

    parts = x.where(F.size("x") == d).select("x").mapInArrow(run, "i int, j int, p string")
    out = np.zeros((d, d), object)
    for r in parts.groupBy("i", "j").agg(F.sum(F.col("p").cast("decimal(38,0)")).cast("string").alias("p")).collect():  # a row for each pair of dimensions
        out[r.i, r.j] = out[r.j, r.i] = int(r.p)
    left = np.array([s - n * m for s, m in zip(sums, middle, strict=True)], object)
    return out * n - np.outer(left, left)


def rank(scatter: np.ndarray) -> int:
    """The rank of an integer matrix, by elimination modulo primes: never above the true one, below it by a chance of d / prime each."""
    def modulo(prime: int) -> int:
        m, found = (scatter % prime).astype(np.int64), 0
        for col in range(m.shape[1]):
            at = np.flatnonzero(m[found:, col])
            if len(at):
                m[[found, found + at[0]]] = m[[found + at[0], found]]
                m[found] = m[found] * pow(int(m[found, col]), -1, prime) % prime
                m[found + 1:] = (m[found + 1:] - m[found + 1:, col:col + 1] * m[found]) % prime
                found += 1
        return found
    return max(modulo(p) for p in PRIMES)


def factor(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pivoted Cholesky: the order of the pivots, and a lower trapezoid L with scatter[order][:, order] = L L'.

    It has as many columns as the integers have rank, so that rounding of dependent dimensions makes none.
    """
    a = scatter.astype(LONG)
    order, cols = np.arange(len(a)), []
    for k in range(rank(scatter)):
        p = k + int(np.argmax(np.diag(a)[order[k:]]))
        order[[k, p]] = order[[p, k]]
        pivot = order[k]
        if a[pivot, pivot] <= 0:  # what is left is less than rounding
            break
        col = np.zeros(len(a), LONG)
        col[order[k:]] = a[order[k:], pivot] / np.sqrt(a[pivot, pivot])
        a = a - np.outer(col, col)
        cols.append(col)
    return order, np.stack(cols, axis=1)[order] if cols else np.zeros((len(a), 0), LONG)


def rotated(lower: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The columns of the factor after plane rotations that make them orthogonal (Hestenes), longest first.

    Pairs are rotated in rounds of disjoint ones (a round-robin tournament), each round in one step.
    """
    w = lower.copy()
    r = w.shape[1]
    seats = np.arange(r + r % 2)
    eps = np.finfo(LONG).eps * 8
    for _ in range(sweeps):
        turned = False
        for _ in range(max(1, len(seats) - 1)):
            p, q = seats[:len(seats) // 2], seats[len(seats) // 2:][::-1]
            met = (p < r) & (q < r)
            p, q = np.minimum(p, q)[met], np.maximum(p, q)[met]
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
            x, y = w[:, p], w[:, q]
            a, b, c = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            turn = np.abs(c) > eps * np.sqrt(a * b)
            if not turn.any():
                continue
            turned = True
            p, q, x, y, a, b, c = p[turn], q[turn], x[:, turn], y[:, turn], a[turn], b[turn], c[turn]
            zeta = (b - a) / (2 * c)
            t = np.where(zeta < 0, -1, 1) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
            cos = 1 / np.sqrt(1 + t * t)
            w[:, p], w[:, q] = cos * x - cos * t * y, cos * t * x + cos * y
        if not turned:
            break
    return w[:, np.argsort(-(w * w).sum(0), kind="stable")]


def fit(x: DataFrame) -> Fit:
    """The whitening of the vectors x (vec_id, x): rotated column norms give eigenvalues, normalised columns components."""
    n, sums = sums_of(x)
    if not sums:
        return Fit(n, sums, np.zeros(0, LONG), np.zeros((0, 0), LONG), 0.0)
    scatter = scatter_of(x, n, sums)
    order, lower = factor(scatter)
    columns = np.zeros_like(lower)
    columns[order] = rotated(lower)
    squares = (columns * columns).sum(0)
    return Fit(n, sums, squares / LONG(n) / LONG(n), columns / np.sqrt(squares), float(LONG(sum(np.diag(scatter))) / LONG(n) / LONG(n)))


def project(x: DataFrame, learned: Fit, top: int = COMPONENTS) -> DataFrame:
    """(vec_id, deviation, w): exact deviation of each vector of the fitted length, and its first `top` whitened coordinates."""
    n, sums, d = learned.n, learned.sums, len(learned.sums)
    middle = [s // n for s in sums]
    left = np.array([(s - n * m) / n for s, m in zip(sums, middle, strict=True)])  # what S/n is above middle
    scaled = (learned.components[:, :top] / np.sqrt(learned.values[:top])).astype(np.float64)
    offset = [s - n * m for s, m in zip(sums, middle, strict=True)]

    def deviation(y: np.ndarray) -> list[int]:
        z = y.astype(object) * n - np.array(offset, object) if n * float(np.abs(y).max(initial=0) + 1) * d ** 0.5 >= 2.0**31 else y * n - np.array(offset)
        return [int(v) for v in (z * z).sum(1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                y = matrix_of(part.column(1)) - np.array(middle, np.int64)
                w = (y - left) @ scaled
                size = pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(deviation(y), pa.int64()), pa.ListArray.from_arrays(size, pa.array(w.reshape(-1)))],
                                                 ["vec_id", "deviation", "w"])

    return x.where(F.size("x") == d).mapInArrow(run, "vec_id long, deviation long, w array<double>")


def identity_error(projected: DataFrame, n: int, r: int) -> float:
    """The largest absolute entry of the covariance of w, measured over all rows, minus the identity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((r + 1, r))
        for batch in batches:
            w = matrix_of(batch.column(0))
            total += np.concatenate([np.ones((len(w), 1)), w], axis=1).T @ w if len(w) else 0
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(r + 1, dtype=np.int32), r)), pa.array(np.tile(np.arange(r, dtype=np.int32), r + 1)), pa.array(total.reshape(-1))],
                                         ["i", "j", "p"])

    out = np.zeros((r + 1, r))
    for row in projected.select("w").mapInArrow(run, "i int, j int, p double").groupBy("i", "j").agg(F.sum("p").alias("p")).collect():
        out[row.i, row.j] = row.p / n
    return float(np.abs(out[1:] - np.outer(out[0], out[0]) - np.eye(r)).max())


def whiten(rows: DataFrame, top: int = COMPONENTS) -> DataFrame:
    """rows (vec_id, embedding) -> (vec_id, component, n, deviation, whitened, explained, identity_error).

    A row for each remaining vector and component, from 1. Rows whose vector is null or has a null or non-finite entry are
    dropped. One length of vectors is fitted, the commonest (the longer on ties); vectors of other lengths have no place in
    it and are dropped too. Dimensions that depend on others give no component, so that there may be fewer than `top`;
    where all vectors are equal, or in an empty table, there is none and the result is empty. Rows that repeat count each;
    a null vec_id is passed on. Extra columns are not read. Eigenvalues that tie have any basis of their space, the same
    for all rows. Entries must lie within 2^47, else the integers don't fit and the job fails, as it does where n or the
    entries are so large that an exact deviation exceeds a long.

    Four passes over the vectors: sums, scatter, the check of the result, and the result; each has one small sum per task for each pair of dimensions; only those sums, of a size
    that the dimensions alone decide, reach the driver.
    """
    x = vectors_of(rows)
    learned = fit(x)
    r = min(top, len(learned.values))
    if not r:
        return rows.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    done = project(x, learned, top)
    error = identity_error(done, learned.n, r)
    share = F.array(*[F.lit(float(v) / learned.trace) for v in learned.values[:r]])
    return (done.select("vec_id", "deviation", F.posexplode("w").alias("k", "whitened"))
            .select("vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(learned.n).cast("long").alias("n"), "deviation", "whitened",
                    F.get(share, F.col("k")).alias("explained"), F.lit(error).alias("identity_error")))
