"""Hard negatives against brute force, and the bounds of the trees."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowtide.llm import hard_negatives as hard

SCHEMA = "vec_id long, embedding array<float>, label int, score string, `row` string, slot string, x string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, y, "s", "r", "t", "x") for i, v, y in rows], SCHEMA)


def plain(rows, every, k=5, m=5):
    use = [(i, [math.floor(256 * x) for x in np.array(v, np.float32).astype(float).tolist()], y) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q, y) in enumerate(use):
        if i % every:
            continue
        scored = [(-sum(s * t for s, t in zip(q, v, strict=True)), j, z) for b, (j, v, z) in enumerate(use) if b != a and len(v) == len(q)]
        for p, j, _ in sorted(x for x in scored if x[2] == y)[:k]:
            fits = sorted(x for x in scored if x[2] != y and -80 * p <= -100 * x[0] <= -100 * p)[:m]
            out += [(i, j, rank, n, -p, -s) for rank, (s, n, _) in enumerate(fits, 1)]
    return sorted(out)


def made(seed, n=400, d=8, labels=4):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(6)]
    rows = [(i * 5, [c + rng.gauss(0, 0.4) for c in rng.choice(centres)], rng.randrange(labels)) for i in range(n)]
    rows += [(10_000 + i * 10, [0.5] * d, i % labels) for i in range(40)]  # ties
    rows += rows[:7]  # repeated rows
    return rows + [(20_000, None, 1), (20_020, [float("nan")] * d, 1), (20_040, [None, *[1.0] * (d - 1)], 2), (20_060, [1.0] * d, None), (None, [1.0] * d, 1), (20_080, [1.0, 2.0], 1), (20_100, [2.0, 1.0], 2), (20_120, [1.9, 2.0], 1), (20_140, [], 1)]


def mined(df, every=20):
    return sorted(tuple(r) for r in hard.hard_negatives(df, F.col("vec_id") % every == 0, F.col("label")).collect())


def test_against_brute_force(spark):
    rows = made(1)
    want = plain(rows, 20)
    assert len(want) > 300
    assert mined(table(spark, rows)) == want


def test_many_blocks_and_small_leaves(spark, monkeypatch):
    monkeypatch.setattr(hard, "ROW_BLOCK", 60)
    monkeypatch.setattr(hard, "ANCHOR_BLOCK", 9)
    monkeypatch.setattr(hard, "LEAF", 3)
    monkeypatch.setattr(hard, "ANCHORS", 4)
    rows = made(2, 200)
    assert mined(table(spark, rows).repartition(5)) == plain(rows, 20)


@pytest.mark.parametrize("rows", [[], [(0, [1.0, 1.0], 1)], [(0, [1.0], 1), (1, [1.0], 1)], [(0, [1.0], 1), (1, [-1.0], 1), (2, [-0.9], 2)], [(0, [1.0], 1), (1, [0.0], 1), (2, [0.0], 2)]])
def test_few_rows(spark, rows):
    assert mined(table(spark, rows)) == plain(rows, 20)


def test_nodes_bound_their_rows_and_are_pruned():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 6)) * 300
    x = np.floor(centres[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 6)) * 20)
    forest = hard.Forest.of(x, np.arange(3000), np.arange(3000), rng.integers(0, 3, 3000))
    assert sum(forest.nodes["end"][r] - forest.nodes["start"][r] for r in forest.roots) == 3000
    for nd, c in zip(forest.nodes, forest.centres, strict=True):
        assert (np.linalg.norm(forest.vectors[nd["start"] : nd["end"]] - c, axis=1) <= nd["radius"]).all()
    anchors = x[:50]

    class Counting(hard.Best):
        multiplied = 0

        def offer(self, who, scores, rows, ids):
            Counting.multiplied += scores.size
            super().offer(who, scores, rows, ids)

    line = np.full((50, 1), np.inf)
    seek = Counting(5, np.arange(50), -line, line, (1, 1))
    forest.descend(anchors, [(int(r), np.arange(50)) for r in forest.roots], seek)
    every = anchors @ x.T
    every[np.arange(50), np.arange(50)] = -np.inf
    assert (seek.scores[:, 0] == -np.sort(-every, axis=1)[:, :5]).all()
    assert Counting.multiplied < 0.5 * every.size
