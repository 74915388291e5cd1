"""Quality classifier: held-out accuracy, gradient updates against a plain version, edge cases."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from rowtide.llm import quality, queries


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = queries.op3_quality_classifier(spark, d).collect()
    assert len(rows) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [(r.score, labels[r.doc_id], r.predicted) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    good, bad = [s for s, y, _ in held if y], [s for s, y, _ in held if not y]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert auc > 0.9
    # clean documents stay
    assert np.mean([p for _, y, p in held if y]) > 0.95


def plain_pass(texts, labels):
    """The updates of one pass, row by row and term by term; weights by index, the bias last."""
    z, n = {}, {}
    weight = lambda j: 0.0 if abs(z.get(j, 0.0)) <= quality.L1 else -(z[j] - math.copysign(quality.L1, z[j])) / ((quality.BETA + math.sqrt(n[j])) / quality.ALPHA + quality.L2)
    row, index, _ = quality.n_grams(pa.array(texts))
    for i, y in enumerate(labels):
        own = index[row == i].tolist()
        x = {j: quality.SCALE * own.count(j) / len(own) for j in set(own)} | {1 << quality.BITS: 1.0}
        w = {j: weight(j) for j in x}
        p = 1 / (1 + math.exp(-max(-35, min(35, sum(w[j] * v for j, v in x.items())))))
        for j, v in x.items():
            g = (p - y) * v
            sigma = (math.sqrt(n.get(j, 0.0) + g * g) - math.sqrt(n.get(j, 0.0))) / quality.ALPHA
            z[j] = z.get(j, 0.0) + g - sigma * w[j]
            n[j] = n.get(j, 0.0) + g * g
    out = np.zeros((1 << quality.BITS) + 1)
    for j in z:
        out[j] = weight(j)
    return out


def test_updates_follow_the_formula():
    texts = ["good fine text here", "bad bad bad bad", "fine words again", "spam spam !!! spam", "", "ok", "to be or not to be"]
    labels = np.array([1, 0, 1, 0, 1, 1, 1])
    learner = quality.Learner()
    learner.learn(pa.array(texts[:3]), labels[:3])
    learner.learn(pa.array(texts[3:]), labels[3:])
    assert learner.weights() == pytest.approx(plain_pass(texts, labels))


def test_pairs_and_patterns_are_n_grams_of_their_own():
    of = lambda text: sorted(quality.n_grams(pa.array([text]))[1].tolist())
    assert len(of("a a")) == 4  # two words, their pair, the pattern
    assert len(of("a b a")) == 6
    assert len(of("a b c")) == 5
    assert len(set(of("a a")) & set(of("b b"))) == 1  # the pattern alone
    assert of("a b") != of("a a")


def test_the_average_of_shards_is_that_of_plain_passes(spark, documents, monkeypatch):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 9)))) for i in range(120)]
    docs = documents(rows)
    labels = spark.createDataFrame([(i, int(rng.random() < 0.6)) for i in range(120)], "doc_id long, label int")
    got = quality.train(docs, labels)
    shards: dict[int, list] = {}
    for r in docs.join(labels.withColumnRenamed("label", "y"), "doc_id").selectExpr("doc_id", "text", "y", f"pmod(xxhash64(doc_id, 1), {quality.SHARDS}) as s").orderBy("doc_id").collect():
        shards.setdefault(r.s, []).append((r.text, r.y))
    want = sum(plain_pass([t for t, _ in x], np.array([y for _, y in x])) * len(x) for x in shards.values()) / 120
    assert len(shards) == quality.SHARDS
    assert got == pytest.approx(want)
    monkeypatch.setattr(quality, "SHARD_BYTES", 20)  # more shards than the least
    assert quality.train(docs, labels) == pytest.approx(quality.train(docs.repartition(7), labels))


def test_long_texts_in_one_shard(spark, documents, monkeypatch):
    """Fifty long texts: no more n-grams at once than those of a piece or of one text."""
    monkeypatch.setattr(quality, "SHARDS", 1)
    rows = [(i, ("good words stand here %d " % i if i % 2 else "junk junk junk junk ") * 10_000) for i in range(50)]
    docs = documents(rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, label int")
    out = quality.score(docs, quality.train(docs, labels)).collect()
    assert all((r.score >= 0.5) == bool(r.doc_id % 2) for r in out)


def test_labels_source_and_ids_do_not_reach_the_score(documents):
    weights = np.random.default_rng(1).normal(size=(1 << quality.BITS) + 1)
    a = quality.score(documents([(1, "some text here", "x"), (2, "other", "y")]), weights).collect()
    b = quality.score(documents([(901, "some text here", "p"), (902, "other", "q")]), weights).collect()
    assert [r.score for r in a] == [r.score for r in b]


def test_edge_cases(spark, documents):
    docs = documents([(1, None), (2, ""), (3, " \n"), (4, "word"), (None, "word"), (4, "word"), (5, "x " * 50_000)])
    labels = spark.createDataFrame([(4, 1), (4, 0), (4, 1), (None, 1), (9, 0), (5, None)], "doc_id long, label int")
    out = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(out) == 7
    assert all(0 <= r.score <= 1 for r in out)
    blank = {r.score for r in out if not (r.text or "").strip()}
    assert len(blank) == 1  # the bias alone
    named = quality.score(docs, quality.train(docs, labels), "_own")  # a column of the caller's named score stays
    assert {r.score for r in named.collect()} == {"y"}
    assert set(out[0].asDict()) == set(docs.columns) | {"score"}
    none = quality.train(docs, labels.where("label = 7"))
    assert not none.any()
    assert quality.score(documents([]), none).collect() == []


def test_training_reads_a_bounded_sample(spark, documents):
    rng = random.Random(0)
    docs = documents([(i, " ".join(rng.choice("abcdef") for _ in range(5))) for i in range(400)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, label int")
    assert quality.train(docs, labels, most_rows=50).any()
    assert np.array_equal(quality.train(docs, labels), quality.train(docs.repartition(5), labels))
