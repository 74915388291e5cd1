"""Leaf-wise histogram boosting of log-odds, with one-side sampling by gradient and stopping by validation scores.

A round is a job for the root's histogram and about one for each level of the tree that has nodes of more rows than a histogram has
bytes for. Margins are kept with the matrix and written anew every ``SNAPSHOT`` rounds; in between, the root's job adds the newest tree to
those that the executors' memory holds from the round before, and keeps them there with the rows' statistics for the round's other
jobs. If an executor is lost, its rows are made again from the written margins and the trees since.
The root's job also adds up the validation rows' scores (counts by class and score, which merge), so the AUC or loss of a round
costs no job of its own. Boosting ends when that has not improved for ``patience`` rounds, and goes back to the best round.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession

from rowtide.learn.binning import ROWS, Matrix, column_codes
from rowtide.learn.trees import Batch, Deep, Few, Grown, Rule, Tree, batches_of, few_rows, kept_histograms, kept_statistics, leaf_wise, most_slots, units
from rowtide.sources.shared import new_folder, remove

#: Rounds between two tables of margins, and the number of scores that validation rows are counted by.
SNAPSHOT, SCORES = 16, 1 << 16


def spread(ids: np.ndarray, seed: int, n: int) -> np.ndarray:
    """A seeded 64-bit hash of each id for round ``n``."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + n * 0xD1B54A32D192ED03) % (1 << 64))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


def exact_cut(count: Callable[[np.ndarray, int], dict[int, int]], k: int) -> tuple[int, int] | None:
    """(cut, n): of unsigned 64-bit keys, so many as ``n`` <= ``k`` lie below ``cut``, and with the key ``cut`` itself there would be
    more than ``k``; None if there are no more than ``k`` keys at all. ``count(prefix, bits)``: how often each value of the next 16 bits
    follows the first ``bits`` bits."""
    prefix, below = 0, 0
    for bits in range(0, 64, 16):
        digits = count(prefix, bits)
        for digit in sorted(digits):
            if below + digits[digit] > k:
                prefix = prefix << 16 | digit
                break
            below += digits[digit]
        else:
            return None
    return prefix, below


@dataclass
class Boosting:
    """A fitted model: trees over the codes of ``features``."""

    features: list[str]
    edges: list[np.ndarray]
    base: float
    trees: list[Tree] = field(default_factory=list)
    #: The score (AUC, or less the loss) of the validation rows after each round, from none.
    history: list[float] = field(default_factory=list)

    @property
    def rounds(self) -> int:
        return len(self.trees)

    def margins(self, codes: np.ndarray) -> np.ndarray:
        out = np.full(len(codes), self.base)
        for tree in self.trees:
            out += tree.values(codes)
        return out

    def predict(self, table: DataFrame, name: str) -> DataFrame:
        """``table`` with the probability of flag 1 as ``name``. Features may be null."""
        return with_scores(table, name, self.features, self.edges, lambda codes: sigmoid(self.margins(codes)))


def with_scores(table: DataFrame, name: str, features: list[str], edges: list[np.ndarray], score: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = score(column_codes(batch, features, edges)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*batch.schema.names, name])

    kept = table.drop(name)
    return kept.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields) + f", `{name}` double")


def area(counts: np.ndarray) -> float | None:
    """ROC-AUC from counts of (zeros, ones) by rising score; scores that share a cell count half."""
    zeros, ones = counts
    n = int(zeros.sum()) * int(ones.sum())
    return float((ones * (np.cumsum(zeros) - zeros / 2)).sum() / n) if n else None


class Fit:
    """The state of one fit: the matrix with margins, the trees since its last table."""

    def __init__(self, matrix: Matrix, rule: Rule, rate: float, leaves: int, columns: float, rows: float, goss: tuple[float, float] | None, by_auc: bool, seed: int):
        self.matrix, self.rule, self.rate, self.leaves, self.columns, self.share, self.goss, self.by_auc, self.seed = matrix, rule, rate, leaves, columns, rows, goss, by_auc, seed
        self.rows, self.folder, self.since = matrix.rows, None, []
        #: The rows that the executors hold of the round before, and how many trees their margins lack.
        self.kept, self.behind = None, 0
        self.spark: SparkSession = matrix.rows.sparkSession
        self.model = Boosting(matrix.features, matrix.edges, self._base())

    def _base(self) -> float:
        """Log-odds of the training rows' weights."""
        found = self.rows.where("NOT stop").selectExpr("sum(CASE WHEN flag = 1 THEN weight ELSE 0 END) AS a", "sum(CASE WHEN flag = 0 THEN weight ELSE 0 END) AS b").first()
        a, b = float(found.a or 0), float(found.b or 0)
        return math.log(a / b) if a > 0 and b > 0 else 0.0 if a == b else math.copysign(18.0, a - b)

    def margins(self) -> Callable[[Batch], np.ndarray]:
        base, since = (self.model.base if self.folder is None else 0.0), list(self.since)

        def of(batch: Batch) -> np.ndarray:
            out = batch.margins + base
            for tree in since:
                out = out + tree.values(batch.codes)
            return out

        return of

    def snapshot(self) -> None:
        """Write the matrix with its margins; the last such table goes."""
        margins, n, names = self.margins(), len(self.matrix.features), ROWS.replace(",", "").split()[::2]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for raw in batches:
                if raw.num_rows:
                    columns = {c: raw.column(c) for c in names} | {"margin": pa.array(margins(Batch.of(raw, n)))}
                    yield pa.RecordBatch.from_arrays(list(columns.values()), names)

        folder = new_folder(self.spark, "margins")
        self.rows.mapInArrow(run, ROWS).write.option("compression", "zstd").parquet(folder)
        if self.folder:
            remove(self.spark, self.folder)
        self.rows, self.folder, self.since = self.spark.read.schema(ROWS).parquet(folder), folder, []
        self._forget()

    def _forget(self) -> None:
        if self.kept is not None:
            self.kept.unpersist()
        self.kept, self.behind = None, 0

    def close(self) -> None:
        self._forget()
        if self.folder:
            remove(self.spark, self.folder)

    def gradients(self) -> Callable[[Batch], np.ndarray]:
        margins = self.margins()
        return lambda batch: _gradients(batch, margins(batch))[0]

    def _advanced(self) -> RDD:
        """Batches with the margins of the model so far: those of the round before and its tree, or those written last."""
        if self.kept is None:
            margins = self.margins()
            return batches_of(self.rows, len(self.matrix.features)).map(lambda b: replace(b, margins=margins(b)))
        last = self.since[len(self.since) - self.behind :]
        return self.kept.map(lambda k: replace(k[0], margins=sum((tree.values(k[0].codes) for tree in last), k[0].margins)))

    def _cut(self, key: Callable[[Batch], tuple[np.ndarray, np.ndarray]], k: int) -> int:
        """The k smallest keys (of the rows that count) and no others are at most this; ties of all 64 bits apart."""
        features = len(self.matrix.features)

        def count(prefix: int, bits: int) -> dict[int, int]:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                n = np.zeros(1 << 16, np.int64)
                for raw in batches:
                    if raw.num_rows:
                        keys, counts = key(Batch.of(raw, features))
                        keys = keys[counts & (keys >> np.uint64(64 - bits) == np.uint64(prefix))] if bits else keys[counts]
                        n += np.bincount((keys >> np.uint64(48 - bits) & np.uint64(0xFFFF)).astype(np.int64), minlength=1 << 16)
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at])], ["digit", "n"])

            return {r.digit: r.n for r in self.rows.mapInArrow(run, "digit int, n long").groupBy("digit").sum("n").withColumnRenamed("sum(n)", "n").collect()}  # 65,536 rows at most

        found = exact_cut(count, k)
        return (1 << 64) - 1 if found is None else found[0] - 1 if found[0] else -1

    def sample(self, n: int) -> Callable[[Batch, np.ndarray], np.ndarray]:
        """A function of a batch and its gradients: the factor of each row in round ``n``, 0 for rows that are left out.

        One-side sampling keeps the share ``top`` of training rows with the greatest gradients and a seeded sample of ``other`` of all from
        the rest, whose factor makes up for those left out; its sizes are exact (but for gradients and hashes that tie in all 64 bits
        compared). The first 1 / rate rounds take all rows, as their gradients say little yet.
        """
        seed, share = self.seed, self.share
        if not self.goss or n < 1 / self.rate:
            return lambda batch, g: np.where(~batch.stop & (share >= 1 or (spread(batch.ids, seed, n) >> np.uint64(11)) * 2.0**-53 < share), 1.0, 0.0)
        top, other = self.goss
        total = self.rows.where("NOT stop").count()
        k_top, k_other = max(1, int(total * top)), max(1, int(total * other))
        gradients = self.gradients()
        high = self._cut(lambda b: (gradient_key(gradients(b), b.ids, seed, n), ~b.stop), k_top)
        drawn = self._cut(lambda b: (spread(b.ids, seed + 1, n), ~b.stop & ~at_most(gradient_key(gradients(b), b.ids, seed, n), high)), k_other)
        factor = (total - k_top) / k_other

        def weigh(batch: Batch, g: np.ndarray) -> np.ndarray:
            first = at_most(gradient_key(g, batch.ids, seed, n), high)
            rest = ~first & at_most(spread(batch.ids, seed + 1, n), drawn)
            return np.where(batch.stop, 0.0, np.where(first, 1.0, np.where(rest, factor, 0.0)))

        return weigh

    def round(self, n: int, grow: bool = True) -> bool:
        """Judge the model so far and, with ``grow``, add a tree; False if no tree can grow."""
        if len(self.since) >= SNAPSHOT:
            self.snapshot()
        every = len(self.matrix.features)
        chosen = np.sort(np.random.default_rng([self.seed, n]).permutation(every)[: max(1, round(self.columns * every))]) if grow else np.zeros(0, int)
        factor = self.sample(n) if grow else (lambda batch, g: np.zeros(len(g)))

        def statistics(batch: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            g, h = _gradients(batch, batch.margins)
            w = factor(batch, g)
            return units(w * g), units(w * h), w > 0

        def judge(batch: Batch) -> np.ndarray:
            p = sigmoid(batch.margins[batch.stop])
            y, w = batch.flags[batch.stop] == 1, batch.weights[batch.stop]
            at = np.minimum((p * SCORES).astype(np.int64), SCORES - 1)
            loss = -np.log(np.maximum(np.where(y, p, 1 - p), 1e-15)) * w
            return np.concatenate((np.bincount(at[~y], minlength=SCORES), np.bincount(at[y], minlength=SCORES), [int(units(loss).sum()), int(units(w).sum())])).astype(np.int64)

        width, few = self.matrix.codes, few_rows(len(chosen), self.matrix.codes)
        before, kept = self.kept, kept_statistics(self._advanced(), statistics, judge)
        self.kept, self.behind = kept, 0

        def fetch(tree: Tree, wanted: dict[int, int], k: int, whole: list[int], deep: Deep | None) -> tuple[np.ndarray, dict[int, Few], dict[int, Grown]]:
            sums, rows, _, below = kept_histograms(kept, chosen, width, tree, wanted, k, whole, 0, deep)
            return sums, rows, below

        one = Tree()
        one.add()
        try:
            root, _, judged, _ = kept_histograms(kept, chosen, width, one, {0: 0}, 1, [], 2 * SCORES + 2)
        finally:
            if before is not None:
                before.unpersist()
        auc = area(judged[: 2 * SCORES].reshape(2, -1))
        loss = judged[-2] / max(1, judged[-1])
        self.model.history.append(auc if self.by_auc and auc is not None else -loss)
        if not grow:
            return False
        # a split asks for the sums or rows of two children
        tree = leaf_wise(root[0], fetch, chosen, self.rule, self.leaves, self.rate, max(1, most_slots(len(chosen), width) // 2), few)
        self.model.trees.append(tree)
        self.since.append(tree)
        self.behind += 1
        return len(tree.feature) > 1


def _gradients(batch: Batch, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = sigmoid(margins)
    return batch.weights * (p - batch.flags), batch.weights * p * (1 - p)


def at_most(keys: np.ndarray, cut: int) -> np.ndarray:
    return keys <= np.uint64(cut) if cut >= 0 else np.zeros(len(keys), bool)


def gradient_key(g: np.ndarray, ids: np.ndarray, seed: int, n: int) -> np.ndarray:
    """Order of rows by falling size of the gradient (40 bits of it), then by a seeded hash of the id (24 bits)."""
    size = np.abs(g).view(np.uint64) >> np.uint64(24)  # not negative: bits rise with the number
    return ((np.uint64((1 << 40) - 1) - size) << np.uint64(24)) | (spread(ids, seed, n) >> np.uint64(40))


def boost(
    matrix: Matrix, rule: Rule, rate: float, rounds: int, leaves: int, columns: float = 1.0, rows: float = 1.0, goss: tuple[float, float] | None = None, patience: int | None = None, by_auc: bool = True, seed: int = 0
) -> Boosting:
    """Fit ``rounds`` trees at most. With ``patience`` and validation rows, boosting stops early and goes back to the best round
    (the first of equals); without, all rounds are kept. Boosting also ends when a tree finds no split."""
    fit = Fit(matrix, rule, rate, leaves, columns, rows, goss, by_auc, seed)
    stops = patience is not None and not matrix.rows.where("stop").isEmpty()
    history = fit.model.history
    n = 0
    while n < rounds and fit.round(n):
        n += 1
        if stops and len(history) - 1 - int(np.argmax(history)) >= patience:
            break
    else:
        if stops:
            fit.round(n, grow=False)
    if stops:
        del fit.model.trees[int(np.argmax(history)) :]
    elif fit.model.trees and len(fit.model.trees[-1].feature) == 1:
        fit.model.trees.pop()
    fit.close()
    return fit.model
