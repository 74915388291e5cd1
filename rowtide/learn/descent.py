"""Logistic regression with an elastic net by mini-batch stochastic descent.

Rows are dealt to batches by a hash of id and seed, and an epoch takes the batches in a seeded order. A batch is one Spark job: each
task adds up its rows' gradient, and the driver holds one vector for each task, whose size hangs on the features. L1 is applied
lazily: a weight makes up the penalty of all steps so far when a batch touches its feature, and at the end, and never crosses zero.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowtide.sources.shared import new_folder, remove

#: Parts of a batch that lie by themselves, so that several tasks take it.
FILES = 8
Sums = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _summed(rows: DataFrame, of: Sums) -> np.ndarray | None:
    """The sum of ``of(x, flags, weights)`` over all rows, tasks added in their order; None without rows."""

    def task(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for chunk in chunks:
            if chunk.num_rows:
                x = np.asarray(chunk.column("x").flatten(), np.float64).reshape(chunk.num_rows, -1)
                found = of(x, chunk.column("flag").to_numpy(), chunk.column("weight").to_numpy())
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total], pa.list_(pa.float64()))], ["task", "sums"])

    parts = sorted(rows.select("flag", "weight", "x").mapInArrow(task, "task int, sums array<double>").collect())  # one row for each task
    return np.sum([p.sums for p in parts], 0) if parts else None


@dataclass
class Descent:
    """What follows one batch after another: weights, bias, and the penalty of all steps and what each weight has made up of it."""

    l1: float
    l2: float
    weights: np.ndarray
    bias: float = 0.0
    penalty: float = 0.0
    paid: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def step(self, rate: float, slopes: np.ndarray, bias_slope: float, touched: np.ndarray) -> None:
        self.weights = self.weights * (1 - rate * self.l2) - rate * slopes
        self.bias -= rate * bias_slope
        self.penalty += rate * self.l1
        self.pay(touched)

    def pay(self, touched: np.ndarray) -> None:
        w, paid = self.weights, self.paid
        after = np.where(w > 0, np.maximum(0, w - (self.penalty + paid)), np.where(w < 0, np.minimum(0, w + (self.penalty - paid)), w))
        after = np.where(touched, after, w)
        self.paid, self.weights = paid + after - w, after


@dataclass(frozen=True)
class LinearModel:
    """``features`` with weights on their own scale; a missing value counts as ``means``."""

    features: list[str]
    weights: np.ndarray
    means: np.ndarray
    bias: float
    rounds: int
    losses: list[float]

    def predict(self, table: DataFrame, name: str = "p") -> DataFrame:
        terms = ", ".join(f"coalesce(nanvl(CAST(`{f}` AS DOUBLE), NULL) - {float(m)!r}D, 0D) * {float(w)!r}D" for f, w, m in zip(self.features, self.weights, self.means, strict=True) if w)
        margin = F.expr(f"aggregate(array({terms}), {float(self.bias)!r}D, (a, x) -> a + x)") if terms else F.lit(float(self.bias))
        return table.withColumn(name, 1 / (1 + F.exp(-margin)))


def stochastic_descent(
    rows: DataFrame, features: list[str], alpha: float, l1_ratio: float, epochs: int, seed: int, batches: int = 16, rate: float = 0.5, tolerance: float = 1e-4, patience: int = 5
) -> LinearModel:
    """Fit on rows with id, flag, weight and ``features``; step t (from 0) has the rate ``rate / (1 + t / batches)``.

    Features are centred and divided by their deviation (a constant one by 1); null and NaN are the mean; other values must be finite. It ends after ``epochs``,
    or when the mean loss has not fallen by ``tolerance`` below its least for ``patience`` epochs. Batches without rows are skipped;
    no rows at all are an error.
    """
    spark, n = rows.sparkSession, len(features)
    folder = new_folder(spark, "descent")
    packed = F.array(*(F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in features)).alias("x")
    batch = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(batches)).cast("int").alias("batch")
    rows.select("flag", F.col("weight").cast("double").alias("weight"), packed, batch).repartition("batch", F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(FILES))).write.partitionBy("batch").parquet(folder)
    try:
        return _descend(spark.read.schema("flag int, weight double, x array<double>, batch int").parquet(folder), features, n, alpha, l1_ratio, epochs, seed, batches, rate, tolerance, patience)
    finally:
        remove(spark, folder)


def _descend(data, features, n, alpha, l1_ratio, epochs, seed, batches, rate, tolerance, patience) -> LinearModel:
    first = _summed(data, lambda x, y, w: np.concatenate((np.nansum(x, 0), (~np.isnan(x)).sum(0))))
    if first is None:
        raise ValueError("no rows to fit")
    means = first[:n] / np.maximum(1, first[n:])
    scales = np.sqrt(_summed(data, lambda x, y, w: np.nansum((x - means) ** 2, 0)) / np.maximum(1, first[n:]))
    scales[scales <= 1e-12 * np.abs(means)] = 1.0
    at = Descent(alpha * l1_ratio, alpha * (1 - l1_ratio), np.zeros(n), paid=np.zeros(n))
    order, losses, least, since, t = np.random.default_rng(seed), [], np.inf, 0, 0
    for _ in range(epochs):
        loss = total = 0.0
        for b in order.permutation(batches):
            weights, bias = at.weights, at.bias

            def slopes(x, y, w, weights=weights, bias=bias):
                z = np.nan_to_num((x - means) / scales)
                margin = z @ weights + bias
                off = w * (1 / (1 + np.exp(-margin)) - y)
                lost = w * (np.logaddexp(0, margin) - y * margin)
                return np.concatenate((off @ z, [off.sum(), lost.sum(), w.sum()], (z != 0).sum(0)))

            found = _summed(data.where(F.col("batch") == int(b)), slopes)
            if found is None or not found[n + 2]:
                continue
            at.step(rate / (1 + t / batches), found[:n] / found[n + 2], found[n] / found[n + 2], found[n + 3 :] > 0)
            loss, total, t = loss + found[n + 1], total + found[n + 2], t + 1
        losses.append(loss / max(total, 1e-300))
        since = 0 if losses[-1] < least - tolerance else since + 1
        least = min(least, losses[-1])
        if since >= patience:
            break
    at.pay(np.ones(n, bool))
    return LinearModel(list(features), at.weights / scales, means, at.bias, len(losses), losses)
