"""Stochastic descent follows a plain loop of the same updates."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowtide.learn.descent import stochastic_descent

FEATURES = ["a", "b", "c", "d", "e"]


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(5)
    out = []
    for i in range(400):
        a, b, c = r.normal(3, 2), r.normal(-1, 0.5), float(r.integers(0, 2))
        flag = int(a - 2 * b + r.normal() > 5)
        out.append((i, flag, 1.0 + flag, None if i % 13 == 0 else a, float("nan") if i % 17 == 0 else b, c, 7.0, r.normal()))
    return spark.createDataFrame(out, "id long, flag int, weight double, a double, b double, c double, d double, e double").repartition(5)


def plain(rows, alpha, ratio, epochs, seed, batches, rate=0.5):
    """One weight after another, over rows held in memory."""
    held = [r.asDict() for r in rows.withColumn("batch", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(batches))).orderBy("id").collect()]
    x = np.array([[np.nan if r[f] is None else r[f] for f in FEATURES] for r in held])
    mean = np.nanmean(x, 0)
    scale = np.array([s if s > 0 else 1 for s in np.nanstd(x, 0)])
    z = np.nan_to_num((x - mean) / scale)
    w, paid, bias, total, t = [0.0] * len(FEATURES), [0.0] * len(FEATURES), 0.0, 0.0, 0

    def pay(k):
        before = w[k]
        if before > 0:
            w[k] = max(0.0, before - (total + paid[k]))
        elif before < 0:
            w[k] = min(0.0, before + (total - paid[k]))
        paid[k] += w[k] - before

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for b in order.permutation(batches):
            mine = [i for i, r in enumerate(held) if r["batch"] == b]
            if not mine:
                continue
            step, size = rate / (1 + t / batches), sum(held[i]["weight"] for i in mine)
            off = {i: held[i]["weight"] * (1 / (1 + np.exp(-(sum(w[k] * z[i, k] for k in range(len(w))) + bias))) - held[i]["flag"]) for i in mine}
            w = [w[k] * (1 - step * alpha * (1 - ratio)) - step * sum(off[i] * z[i, k] for i in mine) / size for k in range(len(w))]
            bias -= step * sum(off.values()) / size
            total += step * alpha * ratio
            for k in range(len(w)):
                if any(z[i, k] for i in mine):
                    pay(k)
            t += 1
    for k in range(len(w)):
        pay(k)
    return np.array(w) / scale, bias


@pytest.mark.parametrize(("alpha", "ratio"), [(2e-5, 0.08), (0.05, 0.7)])
def test_updates_are_the_plain_ones(rows, alpha, ratio):
    got = stochastic_descent(rows, FEATURES, alpha, ratio, 3, 11, batches=4, tolerance=-1)
    weights, bias = plain(rows, alpha, ratio, 3, 11, 4)
    np.testing.assert_allclose(got.weights, weights, rtol=1e-8, atol=1e-11)
    assert got.bias == pytest.approx(bias, rel=1e-8)
    assert got.rounds == 3
    assert got.weights[3] == 0  # a constant feature


def test_strong_l1_leaves_noise_out_and_descent_stops(rows):
    model = stochastic_descent(rows, FEATURES, 0.1, 1.0, 40, 3, batches=4, tolerance=0.5, patience=2)
    assert model.weights[4] == 0
    assert model.weights[0] > 0 > model.weights[1]
    assert model.rounds < 40


def test_predictions_with_missing_values(rows):
    model = stochastic_descent(rows, FEATURES, 1e-4, 0.1, 3, 3, batches=4)
    for r in model.predict(rows.where("id in (0, 17, 20)")).collect():
        x = [m if r[f] is None or np.isnan(r[f]) else r[f] for f, m in zip(FEATURES, model.means, strict=True)]
        assert r.p == pytest.approx(1 / (1 + np.exp(-(np.dot(np.array(x) - model.means, model.weights) + model.bias))))


def test_no_rows_are_an_error(rows):
    with pytest.raises(ValueError, match="no rows"):
        stochastic_descent(rows.limit(0), FEATURES, 1e-4, 0.1, 3, 3)
