"""Whitening against exact fractions and a plain solver."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowtide.llm import whitening


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string, `row` string, x string, component string")


def rows_of(vectors, start=0):
    return [(start + i, v, "n", "r", "x", "c") for i, v in enumerate(vectors)]


def covariance(x):
    """Exact covariance of whole numbers, as doubles."""
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    return np.array([[float(sum((n * r[i] - sums[i]) * (n * r[j] - sums[j]) for r in x) / Fraction(n**3)) for j in range(d)] for i in range(d)])


def test_against_exact_fractions(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(90, 12)) * np.linspace(0.3, 2, 12)).tolist()
    bad = [None, [float("nan")] * 12, [math.inf] * 12, [None, *[0.0] * 11], [1.0, 2.0], []]
    got = whitening.whiten(table(spark, [*rows_of(vectors), *rows_of(bad, 500)]).repartition(7), 8).collect()
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in vectors]
    v = covariance(x)
    values, axes = np.linalg.eigh(v)
    n, sums = len(x), np.array(x).sum(0)
    assert len(got) == n * 8
    by = {(r.vec_id, r.component): r for r in got}
    centred = np.array(x) - sums / n
    for k in range(8):
        want = centred @ axes[:, -1 - k] / math.sqrt(values[-1 - k])
        own = np.array([by[i, k + 1].whitened for i in range(n)])
        assert min(np.abs(own - want).max(), np.abs(own + want).max()) < 1e-9
        assert by[0, k + 1].explained == pytest.approx(values[-1 - k] / np.trace(v), rel=1e-12)
    assert all(by[i, 1].deviation == sum((n * a - int(s)) ** 2 for a, s in zip(x[i], sums, strict=True)) for i in range(n))
    assert {r.n for r in got} == {n}
    assert {r.identity_error for r in got} == {got[0].identity_error}
    assert got[0].identity_error < 1e-12


def test_sums_keep_what_doubles_lose():
    rng = np.random.default_rng(5)
    big = rng.normal(size=(2000, 3)) * 10.0 ** rng.integers(-8, 9, (2000, 3))
    zero = np.zeros_like(big)
    hi, lo = whitening.total(whitening.outer((big, zero)))
    i, j = np.triu_indices(3)
    for k in range(6):
        exact = sum(Fraction(a) * Fraction(b) for a, b in zip(big[:, i[k]].tolist(), big[:, j[k]].tolist(), strict=True))
        assert abs(Fraction(float(hi[k])) + Fraction(float(lo[k])) - exact) <= abs(exact) * Fraction(1, 10**25) + Fraction(1, 10**12)
    a, b = np.array([1e16, 1.0, 0.1]), np.array([1.0, 1e-17, 0.2])
    s, e = whitening.two_sum(a, b)
    p, f = whitening.two_product(a, b)
    for m in range(3):
        assert Fraction(s[m]) + Fraction(e[m]) == Fraction(a[m]) + Fraction(b[m])
        assert Fraction(p[m]) + Fraction(f[m]) == Fraction(a[m]) * Fraction(b[m])


def test_close_eigenvalues_and_refinement():
    rng = np.random.default_rng(8)
    q, _ = np.linalg.qr(rng.normal(size=(20, 20)))
    values = np.array([5.0, 5.0, 4.0 + 1e-6, 4.0, *np.linspace(3, 0.1, 16)])
    v = (q * values) @ q.T
    found, axes = whitening.eigen(((v + v.T) / 2).astype(np.longdouble))
    assert np.abs(found - values).max() < 1e-12
    assert np.abs(axes.T @ axes - np.eye(20)).max() < 1e-14
    assert np.abs(v @ axes - axes * found).max() < 1e-13


@pytest.mark.parametrize("vectors", [[], [None], [[1.0, 2.0]], [[0.5, 0.5]] * 6, [[]]])
def test_no_variance_gives_no_rows(spark, vectors):
    out = whitening.whiten(table(spark, rows_of(vectors)))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert out.count() == 0


def test_fewer_dimensions_than_components(spark):
    line = [[float(i), 2.0 * i, 7.0] for i in range(10)]
    out = whitening.whiten(table(spark, [*rows_of(line), (None, [100.0, 3.0, 7.0], "n", "r", "x", "c"), *rows_of(line[:1])])).collect()
    assert {r.component for r in out} == {1, 2}
    assert sum(r.vec_id is None for r in out) == 2
    assert sum(r.vec_id == 0 for r in out) == 4  # a repeated row
    assert out[0].identity_error < 1e-9


def test_very_large_entries_are_held(spark):
    out = whitening.whiten(table(spark, rows_of([[1e300, 1.0], [-1e300, 2.0], [0.0, 4.0]])))
    assert out.count() == 3  # the other component has no share of the variance
    assert out.where(F.col("deviation").isNull()).count() > 0
    assert out.where("isnan(whitened)").count() == 0
