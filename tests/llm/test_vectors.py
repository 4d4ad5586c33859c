import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from perilframe.llm import hard_negatives, queries, whitening

SMALL = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, whitened double, n string"


def rows_of(spark, vectors, labels=None, ids=None):
    labels = labels or [k % 3 for k in range(len(vectors))]
    return spark.createDataFrame([(ids[k] if ids else k, None if v is None else [None if c is None else float(c) for c in v], labels[k], 0.5, "x") for k, v in enumerate(vectors)], SCHEMA)


def plain_fit(vectors):
    """Exact covariance in integers, its eigenvalues by a library."""
    x = [[math.floor(64 * float(np.float32(c))) + 1000000 for c in v] for v in vectors]
    n = len(x)
    sums = [sum(c) for c in zip(*x, strict=True)]
    z = np.array([[n * c - s for c, s in zip(r, sums, strict=True)] for r in x], object)
    v = np.array([[float(Fraction(int(c), n**3)) for c in r] for r in z.T @ z])
    return x, [Fraction(s, n) for s in sums], v


def test_whitening_against_exact_covariance(spark):
    got = queries.op11_whitening(spark, SMALL).collect()
    table = sorted(spark.read.parquet(f"{SMALL}/embeddings.parquet").collect(), key=lambda r: r.vec_id)
    x, mean, v = plain_fit([r.embedding for r in table])
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    n = len(x)
    assert len(got) == n * 32 and {r.component for r in got} == set(range(1, 33)) and {r.n for r in got} == {n}
    sums = [sum(r[i] for r in x) for i in range(len(mean))]
    deviation = {t.vec_id: sum((n * c - s) ** 2 for c, s in zip(r, sums, strict=True)) for t, r in zip(table, x, strict=True)}
    assert all(r.deviation == deviation[r.vec_id] for r in got)
    assert all(abs(r.explained / (values[r.component - 1] / np.trace(v)) - 1) < 1e-9 for r in got)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9
    w = np.zeros((n, 32))
    for r in got:
        w[r.vec_id, r.component - 1] = r.whitened
    want = (np.array(x, float) - [float(m) for m in mean]) @ vectors[:, :32] / np.sqrt(values[:32])
    assert np.abs(np.abs(w) - np.abs(want)).max() < 1e-8
    assert np.abs(w.T @ w / n - np.eye(32)).max() < 1e-9


def test_factor_and_rotation_of_graded_and_dependent_dimensions():
    rnd = np.random.default_rng(1)
    x = rnd.integers(-50, 50, (400, 6)) * np.array([1, 10, 10**3, 10**5, 10**7, 1])
    x = np.concatenate([x, x[:, :1] + x[:, 1:2], np.full((400, 1), 7), x[:, 3:4]], axis=1).astype(object)  # a sum, a constant, a copy
    scatter = len(x) * (x.T @ x) - np.outer(x.sum(0), x.sum(0))
    order, lower = whitening.factor(scatter)
    assert lower.shape == (9, 6) and (np.triu(lower[:6], 1) == 0).all() and np.all(np.diff(np.diag(lower[:6])) <= 0)
    again = lower @ lower.T
    assert np.abs((again - scatter[np.ix_(order, order)].astype(np.longdouble)) / scatter.diagonal().max()).max() < 1e-17
    turned = whitening.rotated(lower)
    gram = turned.T @ turned
    size = np.sqrt(np.diag(gram))
    assert np.abs(gram / np.outer(size, size) - np.eye(6)).max() < 1e-14 and np.all(np.diff(size) <= 0)
    assert np.abs(turned @ turned.T - again).max() / np.abs(again).max() < 1e-17


def test_whitening_odd_rows(spark):
    rnd = np.random.default_rng(2)
    good = [list(v) for v in rnd.normal(size=(40, 4))]
    good = [[*v, v[0], 3.0] for v in good]  # a copied and a constant dimension
    bad = [None, [1.0, None, 0, 0, 0, 0], [float("nan")] * 6, [float("inf"), 0, 0, 0, 0, 0], [float("-inf")] * 6, [], [1.0, 2.0]]
    got = whitening.whiten(rows_of(spark, [*good, good[0], *bad], ids=[*range(40), 0, *range(100, 107)])).collect()
    assert len(got) == 41 * 4 and {r.vec_id for r in got} == set(range(40)) and {r.n for r in got} == {41} and got[0].identity_error < 1e-9
    assert sum(r.explained for r in got if r.vec_id == 1) == pytest.approx(1)
    far = [[1e5 * a, 1e-2 * b, 5e9 + 1e-2 * c] for a, b, c in rnd.normal(size=(30, 3))]
    assert {r.identity_error < 1e-4 for r in whitening.whiten(spark.createDataFrame([(None, [float(c) for c in v]) for v in far], "vec_id long, embedding array<double>")).collect()} == {True}
    assert whitening.whiten(rows_of(spark, [[1.0, 2.0]] * 5)).count() == 0
    empty = whitening.whiten(rows_of(spark, [[1.0]]).limit(0))
    assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def plain_mine(rows):
    """rows (vec_id, label, integers): every anchor against every row."""
    out = []
    for i, label, x in rows:
        if i % 50:
            continue
        score = {j: sum(a * b for a, b in zip(x, y, strict=True)) for j, _, y in rows if j != i}
        of = {j: other for j, other, _ in rows}
        for p in sorted((j for j in score if of[j] == label), key=lambda j: (-score[j], j))[:5]:
            fit = [j for j in score if of[j] != label and 50 * score[p] <= 100 * score[j] <= 95 * score[p]]
            out += [(i, p, k, j, score[p], score[j]) for k, j in enumerate(sorted(fit, key=lambda j: (-score[j], j))[:3], 1)]
    return sorted(out)


def test_hard_negatives_against_all_pairs(spark):
    got = sorted(tuple(r) for r in queries.op12_hard_negatives(spark, SMALL).collect())
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, [math.floor(256 * c) for c in r.embedding]) for r in table]
    assert got == plain_mine(rows) and len(got) > 50


def test_hard_negatives_odd_rows(spark):
    rnd = np.random.default_rng(3)
    for d in (1, 3, 70):  # less and more than a word of bits
        base = rnd.normal(size=(60, d)) / 4
        vectors = [list(v) for v in base] + [list(base[0])] * 20 + [[0.0] * d] * 10 + [list(-base[0])] * 3  # ties, zeros, negative scores
        labels = [int(k) for k in rnd.integers(0, 3, len(vectors) - 1)] + [9]  # the last one has no positive
        ids = [25 * k for k in range(len(vectors))]
        bad = [(7, None, 1), (50_000, [None] * d, 1), (100_000, [float("nan")] * d, 1), (150_000, [0.1] * d, None), (None, [0.1] * d, 1), (200_000, [], 1)]
        rows = rows_of(spark, vectors, labels, ids).unionByName(spark.createDataFrame([(i, v, x, 0.5, "x") for i, v, x in bad], SCHEMA))
        again = rows.unionByName(rows.limit(30))  # repeated rows
        got = sorted(tuple(r) for r in hard_negatives.mine(again, F.col("vec_id") % 50 == 0).collect())
        plain = [(i, x, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v, x in zip(ids, vectors, labels, strict=True)]
        assert got == plain_mine(plain) and got
    assert hard_negatives.mine(rows.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_intervals_hold(monkeypatch):
    rnd = np.random.default_rng(4)
    for d in (2, 64, 100):
        x = np.floor(256 * rnd.normal(size=(300, d)) * rnd.exponential(size=(300, 1))).astype(np.int64)
        x[5], x[6] = 0, x[7]
        estimate, width = hard_negatives.Anchors(x[:40]).intervals(slice(0, 40), *hard_negatives.encode(x))
        score = x[:40] @ x.T
        assert (np.abs(estimate - score) <= width).all()
        if d > 2:
            assert np.median(width / np.outer(np.linalg.norm(x[:40], axis=1) + 1, np.linalg.norm(x, axis=1) + 1)) < 0.2
