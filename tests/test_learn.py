"""Binning, boosting and randomised trees against plain single-process versions."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowtide.learn import binning, boosting, forest, trees
from rowtide.learn.binning import Matrix
from rowtide.learn.trees import UNIT, Rule, Tree
from rowtide.operators import ensemble

FEATURES = ["a", "b", "c", "d", "e"]


def made(seed, n=600):
    """Rows with an interaction: flag follows the sign of a * b, blurred."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 5))
    x[:, 2] = rng.integers(0, 4, n)
    x[:, 4] = 7.0
    y = (rng.random(n) < 1 / (1 + np.exp(-3 * x[:, 0] * x[:, 1] - 0.5 * (x[:, 2] == 3)))).astype(int)
    return x, y, np.where(y == 1, 1.5, 1.0)


def table(spark, x, y, w, stop=None):
    rows = [(i, int(y[i]), float(w[i]), bool(stop is not None and stop[i]), *(None if math.isnan(v) else float(v) for v in x[i])) for i in range(len(x))]
    return spark.createDataFrame(rows, "id long, flag int, weight double, is_validation boolean, " + ", ".join(f"{c} double" for c in FEATURES)).repartition(5)


def plain_edges(x, bins):
    out = []
    for column in x.T:
        v = np.sort(column[~np.isnan(column)])
        at = [v[max(0, math.ceil(len(v) * i / bins) - 1)] for i in range(1, bins)] if len(v) else []
        out.append(np.array(sorted({float(e) for e in at if e < v[-1]})))
    return out


def plain_codes(x, edges):
    return np.array([[0 if math.isnan(v) else 1 + int((e < v).sum()) for v, e in zip(row, edges, strict=True)] for row in x], np.uint8)


class PlainLeaf:
    def __init__(self, rows, g, h, codes, rule, columns):
        self.rows, self.split = rows, None
        self.value = float(rule.value(g[rows].sum() / UNIT, h[rows].sum() / UNIT))
        best = 1e-12
        for f in columns:
            for cut in range(int(codes.max()) + 1):
                left = rows[codes[rows, f] <= cut]
                right = rows[codes[rows, f] > cut]
                if min(len(left), len(right)) < rule.least_rows or min(h[left].sum(), h[right].sum()) / UNIT < rule.least_hessian:
                    continue
                worth = [float(rule.worth(g[r].sum() / UNIT, h[r].sum() / UNIT)) for r in (left, right, rows)]
                if worth[0] + worth[1] - worth[2] > best:
                    best, self.split = worth[0] + worth[1] - worth[2], (f, cut, left, right)
        self.gain = best


def plain_tree(codes, g, h, use, rule, leaves, rate, columns):
    """Values of all rows: one leaf is split at a time, the one of greatest gain first."""
    out = [PlainLeaf(np.flatnonzero(use), g, h, codes, rule, columns)]
    while len(out) < leaves and any(x.split for x in out):
        best = max((x for x in out if x.split), key=lambda x: x.gain)
        out.remove(best)
        out += [PlainLeaf(r, g, h, codes, rule, columns) for r in best.split[2:]]
        best.kids = out[-2:]
    return out


@pytest.mark.parametrize("bins", [4, 20, 254])
def test_edges_are_exact_quantiles_on_small_data(spark, bins):
    x, y, w = made(1, 300)
    x[::7, 0] = np.nan
    x[:, 3] = np.nan
    m = Matrix.write(table(spark, x, y, w), FEATURES, bins)
    want = plain_edges(x, bins)
    assert [e.tolist() for e in m.edges] == [e.tolist() for e in want]
    got = {r.id: r for r in m.rows.collect()}
    codes = plain_codes(x, want)
    assert all(list(got[i].bins) == codes[i].tolist() for i in range(len(x)))
    assert m.codes <= bins + 1
    assert {len(r.bins) for r in got.values()} == {len(FEATURES)}  # a byte for each feature


def test_rows_that_stop_boosting_do_not_shape_bins(spark):
    x, y, w = made(2, 100)
    stop = np.arange(100) % 2 == 0
    x[stop, 0] += 1000
    m = Matrix.write(table(spark, x, y, w, stop), FEATURES, 10)
    assert m.edges[0].tolist() == plain_edges(x[~stop], 10)[0].tolist()


@pytest.mark.parametrize(("rule", "leaves"), [(Rule(10), 8), (Rule(20, 0.5, 2.0), 31), (Rule(1, 0.0, 0.05), 5)])
def test_boosting_is_the_plain_version_tree_by_tree(spark, rule, leaves):
    x, y, w = made(3)
    m = Matrix.write(table(spark, x, y, w), FEATURES, 16)
    model = boosting.boost(m, rule, 0.2, 3, leaves, seed=5)
    codes = plain_codes(x, m.edges)
    margin = np.full(len(x), math.log(w[y == 1].sum() / w[y == 0].sum()))
    for tree in model.trees:
        p = 1 / (1 + np.exp(-margin))
        g, h = np.rint(w * (p - y) * UNIT), np.rint(w * p * (1 - p) * UNIT)
        want = plain_tree(codes, g, h, np.ones(len(x), bool), rule, leaves, 0.2, range(5))
        own = tree.leaves(codes)
        for leaf in want:
            assert len(set(own[leaf.rows])) == 1
            assert abs(tree.value[own[leaf.rows[0]]] - 0.2 * leaf.value) < 1e-12
        assert len(set(own)) == len(want)
        margin += tree.values(codes)
    assert model.rounds == 3
    assert np.abs(model.margins(codes) - margin).max() < 1e-12


def test_partitions_and_small_jobs_do_not_matter(spark, monkeypatch):
    x, y, w = made(4)
    stop = np.arange(len(x)) % 4 == 0
    fit = lambda n: boosting.boost(Matrix.write(table(spark, x, y, w, stop).repartition(n), FEATURES, 12), Rule(5), 0.3, 4, 8, 0.8, 0.7, patience=3, seed=9)
    one = fit(1)
    monkeypatch.setattr(trees, "JOB_BYTES", 3 * 5 * 14 * 24)
    monkeypatch.setattr(trees, "FEW_TASKS", 0)
    monkeypatch.setattr(trees, "CHUNK", 64)
    monkeypatch.setattr(boosting, "SNAPSHOT", 2)
    monkeypatch.setattr(binning, "FILE_BYTES", 1000)
    many = fit(7)
    assert one.trees == many.trees
    assert np.allclose(one.history, many.history, atol=1e-12)


def test_interaction_beats_trees_of_one_level(spark):
    x, y, w = made(6, 1500)
    stop = np.arange(len(x)) % 3 == 0
    df = table(spark, x, y, w, stop)
    m = Matrix.write(df, FEATURES, 32)
    deep, flat = (boosting.boost(m, Rule(10, 0, 1.0), 0.4, 10, n, patience=5, seed=1) for n in (16, 2))
    auc = lambda model: ensemble.roc_auc(model.predict(df.where("is_validation"), "score").select("flag", "score")).first().auc
    assert auc(deep) > 0.8
    assert auc(deep) > auc(flat) + 0.1


@pytest.mark.parametrize("by_auc", [True, False])
def test_early_stopping_goes_back_to_the_best_round(spark, by_auc):
    x, y, w = made(7, 500)
    stop = np.arange(len(x)) % 2 == 0
    df = table(spark, x, y, w, stop)
    m = Matrix.write(df, FEATURES, 16)
    fitted = boosting.boost(m, Rule(3), 0.9, 16, 12, patience=4, by_auc=by_auc, seed=2)
    every = boosting.boost(m, Rule(3), 0.9, 16, 12, patience=None, seed=2)
    codes, margin, scores = plain_codes(x, m.edges), np.full(len(x), every.base), []
    for tree in [None, *every.trees]:
        margin = margin + (tree.values(codes) if tree else 0)
        p = 1 / (1 + np.exp(-margin[stop]))
        if by_auc:
            diff = p[y[stop] == 1][:, None] - p[y[stop] == 0][None, :]
            scores.append(((diff > 0) + (diff == 0) / 2).mean())
        else:
            scores.append(-(w[stop] * -np.log(np.where(y[stop] == 1, p, 1 - p))).sum() / w[stop].sum())
    best = 0
    for n, s in enumerate(scores):
        if s > scores[best] + 1e-9:
            best = n
        if n - best >= 4:
            break
    assert fitted.rounds == best < 16
    assert fitted.trees == every.trees[:best]
    assert np.abs(np.array(fitted.history) - scores[: len(fitted.history)]).max() < 1e-4


def test_one_side_sampling_sizes_and_sums(spark):
    x, y, w = made(8, 2000)
    stop = np.arange(len(x)) % 10 == 0
    m = Matrix.write(table(spark, x, y, w, stop), FEATURES, 16)
    fit = boosting.Fit(m, Rule(5), 0.5, 8, 1.0, 1.0, (0.24, 0.12), True, 3)
    for n in range(3):
        fit.round(n)
    codes = plain_codes(x, m.edges)
    margin = fit.model.margins(codes)
    g = w * (1 / (1 + np.exp(-margin)) - y)
    batch = trees.Batch(np.arange(len(x)), y, w, stop, np.zeros(len(x)), codes)
    total, sums = 1800, []
    for n in range(3, 23):
        factor = fit.sample(n)(batch, g)
        top, other = int(total * 0.24), int(total * 0.12)
        assert (factor == 1).sum() == top
        assert (factor > 1).sum() == other
        assert not factor[stop].any()
        assert np.abs(g[factor == 1]).min() >= np.abs(g[~stop & (factor != 1)]).max() - 1e-9
        assert set(factor.tolist()) == {0.0, 1.0, (total - top) / other}
        sums.append((factor * g).sum())
    spread = np.std(sums) / math.sqrt(len(sums))
    assert abs(np.mean(sums) - g[~stop].sum()) < 4 * spread
    assert boosting.boost(m, Rule(5), 0.5, 4, 8, goss=(0.24, 0.12), patience=9, seed=3).history[-1] > 0.7


@pytest.mark.parametrize("keys", [[], [5], [7, 7, 7], [0, 0, 1, 1 << 63, (1 << 64) - 1], list(range(0, 1 << 20, 4099))])
def test_exact_cut(keys):
    def count(prefix, bits):
        out = {}
        for k in keys:
            if k >> (64 - bits) == prefix:
                d = k >> (48 - bits) & 0xFFFF
                out[d] = out.get(d, 0) + 1
        return out

    for k in (0, 1, 2, 3, len(keys), len(keys) + 1):
        found = boosting.exact_cut(count, k)
        if k >= len(keys):
            assert found is None
        else:
            cut, n = found
            assert sum(x < cut for x in keys) == n <= k < sum(x <= cut for x in keys)


def test_randomised_trees_are_the_plain_version(spark, monkeypatch):
    x, y, w = made(9, 400)
    m = Matrix.write(table(spark, x, y, w), FEATURES, 30)
    codes = plain_codes(x, m.edges)
    monkeypatch.setattr(trees, "JOB_BYTES", 4 * 5 * m.codes * 24)
    model = forest.randomised_trees(m, 5, 0.6, 10, seed=11, at_once=3)

    def grow(tree, node, rows, t):
        """Follow the fitted tree; every node must be what its own rows and random numbers say."""
        one, all_ = np.rint(w * (y == 1) * UNIT), np.rint(w * UNIT)
        assert abs(tree.value[node] - one[rows].sum() / all_[rows].sum()) < 1e-12
        rng, best, gain = np.random.default_rng([11, t, node]), None, 1e-12
        order, drawn = rng.permutation(5), rng.random(5)
        gini = lambda r: 2 * one[r].sum() / UNIT * (all_[r].sum() - one[r].sum()) / max(all_[r].sum(), 1e-9)
        for f in [f for f in order if codes[rows, f].min() < codes[rows, f].max()][:3] if len(rows) >= 20 else []:
            low, high = int(codes[rows, f].min()), int(codes[rows, f].max())
            cut = low + int(drawn[f] * (high - low))
            left, right = rows[codes[rows, f] <= cut], rows[codes[rows, f] > cut]
            if min(len(left), len(right)) >= 10 and gini(rows) - gini(left) - gini(right) > gain:
                best, gain = (f, cut, left, right), gini(rows) - gini(left) - gini(right)
        assert (tree.feature[node], tree.cut[node]) == (best[:2] if best else (-1, 0))
        if best:
            grow(tree, tree.left[node], best[2], t)
            grow(tree, tree.right[node], best[3], t)

    for t, tree in enumerate(model.trees):
        grow(tree, 0, np.arange(len(x)), t)
    scored = {r.id: r.p for r in model.predict(table(spark, x, y, w), "p").collect()}
    assert all(abs(scored[i] - s) < 1e-12 for i, s in enumerate(model.scores(codes)))


def test_edge_tables(spark):
    """No rows, one class, constant features, unknown and missing values in prediction."""
    x, y, w = made(10, 60)
    for rows, flags in ((x[:0], y[:0]), (x, np.ones(60, int)), (np.full((60, 5), 3.0), y)):
        m = Matrix.write(table(spark, rows, flags, w), FEATURES, 8)
        model = boosting.boost(m, Rule(2), 0.3, 3, 4)
        scored = model.predict(table(spark, x, y, w).withColumn("a", F.lit(None).cast("double")), "p").collect()
        assert all(0 <= r.p <= 1 for r in scored)
        assert len(forest.randomised_trees(m, 2, 0.5, 5).trees) == 2
    with pytest.raises(ValueError, match="bins"):
        Matrix.write(table(spark, x, y, w), FEATURES, 255)
    assert Tree().feature == []


def test_edges_of_many_rows_are_exact(spark):
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(size=30_000), np.round(rng.normal(size=30_000), 1), np.where(rng.random(30_000) < 0.3, np.nan, rng.random(30_000))])
    rows = spark.createDataFrame([tuple(None if math.isnan(v) else float(v) for v in r) for r in x], "a double, b double, c double").repartition(6)
    for got, want in zip(binning.bin_edges(rows, ["a", "b", "c"], 64), plain_edges(x, 64), strict=True):
        assert got.tolist() == want.tolist()


def test_a_round_needs_no_job_below_nodes_of_few_rows(spark, monkeypatch):
    x, y, w = made(11, 150)
    m = Matrix.write(table(spark, x, y, w).withColumn("flag", F.col("flag").cast("int")), FEATURES, 32)
    assert trees.few_rows(len(FEATURES), m.codes) >= 150
    grown = []
    for few_tasks in (trees.FEW_TASKS, 0):
        monkeypatch.setattr(trees, "FEW_TASKS", few_tasks)
        fit = boosting.Fit(m, Rule(5), 0.3, 8, 1.0, 1.0, None, True, 3)
        group = f"round-{few_tasks}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            assert fit.round(0)
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        # the batches' rows and those of the root's children: no job for any level below
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) == 2
        fit.close()
        grown.append(fit.model.trees[0])
    # rows that are not asked for: a job for each level, the same tree
    monkeypatch.setattr(boosting, "few_rows", lambda columns, width: 0)
    fit = boosting.Fit(m, Rule(5), 0.3, 8, 1.0, 1.0, None, True, 3)
    assert fit.round(0)
    fit.close()
    assert grown == [fit.model.trees[0]] * 2
    assert len(fit.model.trees[0].feature) == 15


def test_nodes_that_one_task_can_hold_are_grown_there(spark, monkeypatch):
    x, y, w = made(12, 3000)
    m = Matrix.write(table(spark, x, y, w).withColumn("flag", F.col("flag").cast("int")), FEATURES, 32)
    monkeypatch.setattr(boosting, "few_rows", lambda columns, width: 20)
    grown = []
    for deep in (trees.DEEP_ROWS, 400, 0):
        monkeypatch.setattr(trees, "DEEP_ROWS", deep)
        fit = boosting.Fit(m, Rule(5), 0.3, 24, 1.0, 1.0, None, True, 3)
        group = f"deep-{deep}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            assert fit.round(0)
            jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
            assert fit.round(1)
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        fit.close()
        grown.append((jobs, fit.model.trees))
    # the root's rows, and all below its children, where levels took a job each
    assert grown[0][0] == 2 < grown[1][0] <= grown[2][0]
    assert grown[0][1] == grown[1][1] == grown[2][1]
    assert len(grown[0][1][0].feature) == 47


@pytest.mark.parametrize("second", [lambda n: n, lambda n: n - 1e5, lambda n: n * 2.0**32])
@pytest.mark.parametrize("chunk", [64, 1 << 24])
def test_sums_are_those_of_plain_loops(monkeypatch, second, chunk):
    monkeypatch.setattr(trees, "CHUNK", chunk)
    rng = np.random.default_rng(13)
    codes = np.asfortranarray(rng.integers(0, 9, (3000, 4)).astype(np.uint8))
    a, b = np.rint(rng.normal(0, 1e6, 3000)), second(np.rint(rng.random(3000) * 6e5))
    for rows in (np.arange(3000), np.arange(5, 3000, 2), np.arange(40)):
        slot, columns, n = rng.integers(0, 3, len(rows)), np.array([1, 3]), len(rows)
        got, want = np.zeros((3, 3, 18), np.int64), np.zeros((3, 3, 18), np.int64)
        trees._count(got, slot, codes, a[:n], b[:n], 9, columns, rows)
        for k, row in enumerate(rows):
            for j, c in enumerate(columns):
                want[slot[k], :, j * 9 + int(codes[row, c])] += np.array([a[k], b[k], 1], np.int64)
        assert (got == want).all()


def test_margins_are_kept_from_round_to_round(spark, monkeypatch):
    """A round adds the newest tree alone to the margins that the executors hold."""
    x, y, w = made(14, 300)
    m = Matrix.write(table(spark, x, y, w).withColumn("flag", F.col("flag").cast("int")), FEATURES, 16)
    fit = boosting.Fit(m, Rule(5), 0.3, 6, 1.0, 1.0, None, True, 3)
    monkeypatch.setattr(fit, "margins", lambda own=fit.margins: own() if fit.kept is None else pytest.fail("from the start"))
    assert all(fit.round(n) for n in range(4))
    codes = plain_codes(x, m.edges)
    held = {i: v for k in fit.kept.collect() for i, v in zip(k[0].ids.tolist(), k[0].margins.tolist(), strict=True)}
    want = fit.model.base + sum(t.values(codes) for t in fit.model.trees[:3])
    assert np.allclose([held[i] for i in sorted(held)], want, atol=1e-12)
    fit.close()
