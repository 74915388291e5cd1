"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

A document is the sparse vector of its hashed words, its word pairs and the patterns of its repetitions (a word that follows
itself at once, or after one other word: n-grams of equality, not of words, so that they also tell about unseen words), each
as its share of all of the document's n-grams, and a bias. Without the patterns, the area under the curve on held-out labels
of the test tables falls from 1.00 to 0.93. Training runs in shards of about equal size in bytes, each an online FTRL-proximal pass over its rows in the order of
doc_id; the shards' weights are averaged by their rows (parameter mixing). Scoring is a sparse dot product with the weights.
Texts are turned into n-grams a piece of the column at a time, so memory does not depend on the size of a shard.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowtide.llm.common import by_bytes, byte_view, mix64, runs_by_row, span_hashes
from rowtide.sources.shared import cut

BITS = 18
SCALE = 30.0
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.0, 0.01
#: Bound of the labelled rows that training reads, about (rows are chosen by hash, all if there are fewer).
MOST_ROWS = 32_000
#: Shards at least, and bytes of text in each, about.
SHARDS, SHARD_BYTES = 8, 16 << 20
#: Bytes of text whose n-grams are held at once (about fifty times as much memory); one longer text is taken alone.
PIECE = 1 << 18
_AGAIN, _AGAIN_BUT_ONE = mix64(np.array([1, 2], np.uint64))


def n_grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Row and hashed index of every word, word pair and pattern of repetition; words are runs of letters and digits, or of other signs."""
    data, offsets = byte_view(column)
    rows = len(offsets) - 1
    low = data | 32
    word = (data >= 128) | ((data >= 48) & (data < 58)) | ((low >= 97) & (low < 123))
    space = (data == 32) | ((data >= 9) & (data <= 13))
    parts = [runs_by_row(word, offsets), runs_by_row(~word & ~space, offsets)]
    starts, ends, row = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(starts, kind="stable")
    starts, ends, row = starts[order], ends[order], row[order]
    words = span_hashes(data, starts, ends)
    pair = row[1:] == row[:-1]
    pairs = mix64(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])
    again, but_one = pair & (words[1:] == words[:-1]), (row[2:] == row[:-2]) & (words[2:] == words[:-2])
    marks = np.full(int(again.sum()), _AGAIN), np.full(int(but_one.sum()), _AGAIN_BUT_ONE)
    index = (np.concatenate((words, pairs[pair], *marks)) >> np.uint64(64 - BITS)).astype(np.int64)
    return np.concatenate((row, row[1:][pair], row[1:][again], row[2:][but_one])), index, rows


class Learner:
    """The state of one shard's pass. The last place of the vectors is the bias."""

    def __init__(self):
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
        self.rows = 0

    @staticmethod
    def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, texts: pa.Array, labels: np.ndarray) -> None:
        """Follow the rows in their order."""
        row, index, rows = n_grams(texts)
        key, count = np.unique(row << BITS | index, return_counts=True)
        row, index = key >> BITS, key & ((1 << BITS) - 1)
        value = SCALE * count / np.maximum(np.bincount(row, count, rows), 1)[row]
        ends = np.searchsorted(row, np.arange(rows + 1))
        z, n = self.z, self.n
        for i in range(rows):
            at = slice(ends[i], ends[i + 1])
            j, v = np.append(index[at], 1 << BITS), np.append(value[at], 1.0)
            w = self._weights(z[j], n[j])
            g = (1 / (1 + np.exp(-np.clip(w @ v, -35, 35))) - labels[i]) * v
            sigma = (np.sqrt(n[j] + g * g) - np.sqrt(n[j])) / ALPHA
            z[j] += g - sigma * w
            n[j] += g * g
        self.rows += rows

    def weights(self) -> np.ndarray:
        return self._weights(self.z, self.n)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weights and rows of each shard, from rows sorted by shard."""
    shard, learner = None, Learner()
    for batch in batches:
        for part in by_bytes(batch, "text", PIECE):
            own = part.column("shard").to_numpy()
            edges = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
            for a, b in zip(edges, edges[1:], strict=False):
                if own[a] != shard:
                    if learner.rows:
                        yield _fitted(learner)
                    shard, learner = own[a], Learner()
                rows = part.slice(a, b - a)
                learner.learn(rows.column("text"), rows.column("label").to_numpy())
    if learner.rows:
        yield _fitted(learner)


def _fitted(learner: Learner) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"weights": [learner.weights().astype("<f8").tobytes()], "n": [learner.rows]})


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> np.ndarray:
    """Weights learned from the rows of ``labels`` (doc_id, label 0 or 1), the bias last; null labels and ids are left out.

    Repeated labels of a document count as their mean, 1 from 0.5 on. About ``most_rows`` rows, chosen by hash of the id,
    are used at most, so that the ids can be broadcast and the shards are few. Without rows the weights are 0 (score 0.5).
    """
    known = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    share = most_rows / max(most_rows, known.count())
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = cut(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label"))
    shards = max(SHARDS, math.ceil((rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0) / SHARD_BYTES))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(shards))).repartition(shards, "shard").sortWithinPartitions("shard", "doc_id", "text")
    fitted = dealt.select("shard", "text", "label").mapInArrow(_shards, "weights binary, n long")
    total, sums = 0, np.zeros((1 << BITS) + 1)
    for x in fitted.toLocalIterator():  # vectors of fixed size, one after another
        total += x.n
        sums += np.frombuffer(x.weights, "<f8") * x.n
    return sums / max(total, 1)


def score(docs: DataFrame, weights: np.ndarray, name: str = "score") -> DataFrame:
    """All columns of ``docs`` and ``name`` (replaced if there), the probability of label 1.

    Null, empty and blank texts have no n-gram: they score what the bias says.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2**BITS + 1 doubles
    bare = docs.drop(name)
    schema = bare.select("*", F.lit(0.0).alias(name)).schema

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text", PIECE):
                row, index, rows = n_grams(part.column("text"))
                dot = SCALE * np.bincount(row, shared.value[index], rows) / np.maximum(np.bincount(row, minlength=rows), 1) + shared.value[-1]
                p = 1 / (1 + np.exp(-np.clip(dot, -35, 35)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p)], [*part.schema.names, name])

    return bare.mapInArrow(scored, schema)
