"""Extremely randomised trees: no bootstrap, a seeded random cut for each node and feature, the best of a node's random features.

All trees see all rows, so they share the root's histogram; the nodes of a level of many trees are made by one job (or as few as
bounded histograms allow), and all their candidate cuts are judged on those. Cuts are drawn between the least and the greatest code
that a node has.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from rowtide.learn.binning import Matrix
from rowtide.learn.boosting import with_scores
from rowtide.learn.trees import UNIT, Batch, Tree, histograms, most_slots, units


@dataclass
class RandomisedTrees:
    """A fitted forest; a tree's leaf holds the weighted share of flag 1."""

    features: list[str]
    edges: list[np.ndarray]
    trees: list[Tree]

    @property
    def rounds(self) -> int:
        return len(self.trees)

    def scores(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(codes))
        for tree in self.trees:
            out += tree.values(codes)
        return out / max(1, len(self.trees))

    def predict(self, table: DataFrame, name: str) -> DataFrame:
        """``table`` with the mean share of flag 1 as ``name``."""
        return with_scores(table, name, self.features, self.edges, self.scores)


def impurity(ones: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Weight times Gini impurity."""
    return 2 * ones * (total - ones) / np.maximum(total, 1e-300)


def random_split(sums: np.ndarray, columns: float, least_rows: int, key: list[int]) -> tuple[int, int] | None:
    """(feature, cut) of a node: of ``columns`` (a share) random features that are not constant, the best random cut. None: a leaf."""
    rng = np.random.default_rng(key)
    there = sums[2] > 0
    low, high = there.argmax(1), sums.shape[2] - 1 - there[:, ::-1].argmax(1)
    order, drawn = rng.permutation(len(low)), rng.random(len(low))
    some = order[high[order] > low[order]][: max(1, int(columns * len(low)))]
    if not len(some):
        return None
    cuts = low[some] + (drawn[some] * (high[some] - low[some])).astype(np.int64)
    left = np.cumsum(sums[:, some], axis=2)[:, np.arange(len(some)), cuts]
    whole = sums[:, 0].sum(1)
    ones, total, n = left[0] / UNIT, left[1] / UNIT, left[2]
    gain = impurity(whole[0] / UNIT, whole[1] / UNIT) - impurity(ones, total) - impurity(whole[0] / UNIT - ones, whole[1] / UNIT - total)
    gain = np.where((n >= least_rows) & (whole[2] - n >= least_rows), gain, -np.inf)
    k = int(gain.argmax())
    return (int(some[k]), int(cuts[k])) if gain[k] > 1e-12 else None


def randomised_trees(matrix: Matrix, trees: int, columns: float = 0.55, least_rows: int = 25, seed: int = 0, at_once: int = 32, most_depth: int | None = None) -> RandomisedTrees:
    """Fit on the rows that are not for stopping. ``columns``: share of the features that a node draws; ``at_once``: trees that grow
    together. Trees grow until nodes are pure, would get fewer than ``least_rows`` rows on a side, or lie ``most_depth`` deep."""
    every, width = len(matrix.features), matrix.codes
    chosen, slots = np.arange(every), most_slots(every, width)

    def statistics(batch: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return units(batch.weights * (batch.flags == 1)), units(batch.weights), ~batch.stop

    def fetch(routes: list[tuple[Tree, dict[int, int]]], n: int) -> np.ndarray:
        return histograms(matrix.rows, every, chosen, width, statistics, routes, n, None, matrix.files)[0]

    one = Tree()
    one.add()
    root = fetch([(one, {0: 0})], 1)[0]
    out = []
    for start in range(0, trees, at_once):
        group = range(start, min(trees, start + at_once))
        out += _grown(group, root, fetch, columns, least_rows, seed, slots, most_depth)
    return RandomisedTrees(matrix.features, matrix.edges, out)


def _share(sums: np.ndarray) -> float:
    return float(sums[0, 0].sum() / max(1, sums[1, 0].sum())) if sums.shape[1] else 0.0


def _grown(group: range, root: np.ndarray, fetch: Callable, columns: float, least_rows: int, seed: int, slots: int, most_depth: int | None) -> list[Tree]:
    made = {t: Tree() for t in group}
    level = {}
    for t, tree in made.items():
        level[t, tree.add(_share(root))] = root
    depth = 0
    while level and (most_depth is None or depth < most_depth):
        depth += 1
        pairs = []
        for (t, node), sums in level.items():
            if (found := random_split(sums, columns, least_rows, [seed, t, node])) is not None:
                f, c = found
                left, right = made[t].split(node, f, c)
                fewer = 2 * sums[2, f, : c + 1].sum() <= sums[2, f].sum()
                pairs.append((t, sums, *((left, right) if fewer else (right, left))))
        level = {}
        for s in range(0, len(pairs), slots):
            part = pairs[s : s + slots]
            wanted: dict[int, dict[int, int]] = {}
            for slot, (t, _, small, _) in enumerate(part):
                wanted.setdefault(t, {})[small] = slot
            sums = fetch([(made[t], of) for t, of in wanted.items()], len(part))
            for slot, (t, whole, small, large) in enumerate(part):
                for node, own in ((small, sums[slot]), (large, whole - sums[slot])):
                    made[t].value[node] = _share(own)
                    if own[2, 0].sum() >= 2 * least_rows:
                        level[t, node] = own
    return list(made.values())
