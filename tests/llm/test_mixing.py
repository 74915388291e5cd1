"""Mixing: targets against iterated clamping, draws against their contract."""

from __future__ import annotations

import re
from collections import Counter

import pytest

from rowtide.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fill(sizes, weights, epochs=3):
    """Clamp and share out again until no source is above its cap."""
    total, full = sum(sizes), set()
    while True:
        left = total - sum(epochs * sizes[i] for i in full)
        share = sum(w for i, w in enumerate(weights) if i not in full)
        target = [epochs * s if i in full else left * weights[i] / share for i, s in enumerate(sizes)]
        over = {i for i, t in enumerate(target) if i not in full and t > epochs * sizes[i]}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("sizes", [[10, 20, 30], [1, 1000, 5], [5], [3, 3, 3, 900, 2, 1, 0], [7, 0, 0, 100]])
def test_water_filling(spark, sizes):
    weights = [i % 3 + 1 for i in range(len(sizes))]
    df = spark.createDataFrame([(f"s{i}", n, w) for i, (n, w) in enumerate(zip(sizes, weights, strict=True))], "source string, source_size long, weight long")
    got = [r.target for r in mixing.water_fill(df).orderBy("source").collect()]
    assert got == pytest.approx(fill(sizes, weights))


def rows():
    out = [(i, " ".join(["word"] * (i % 17 + 1)), f"s{i % 4}" if i % 9 else None) for i in range(400)]
    return out + [(1000, None, "s0"), (1001, "", "s1"), (1002, "tail", "s0"), (1002, "tail", "s0"), (1003, "a b c", "rare"), (1004, " x\ty", "rare"), (None, "no id", "s2")]


def test_taken_words_come_near_the_targets(documents):
    docs = documents(rows())
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows())
    size = Counter()
    for _, text, source in rows():
        size[source] += len(WORD.findall(text or ""))
    names = sorted(size, key=lambda s: (s is None, s))
    target = dict(zip(names, fill([size[s] for s in names], [i % 3 + 1 for i in range(len(names))]), strict=True))
    taken = Counter()
    for r in out:
        assert r.source_size == size[r.source]
        assert r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 20 for s in names)


def test_reruns_and_partitions_agree(documents):
    docs = documents(rows())
    runs = [sorted(map(str, mixing.mix(d).select("doc_id", "size", "taken").collect())) for d in (docs, docs.repartition(7), docs.coalesce(1))]
    assert runs[0] == runs[1] == runs[2]


def test_the_mix_itself_repeats_rows(documents):
    docs = documents([r for r in rows() if r[0] != 1002])
    want = Counter({(r.doc_id, r.source): r.copies for r in mixing.mix(docs).collect() if r.copies})
    mixed = mixing.repeat_rows(docs)
    assert mixed.columns == docs.columns
    assert Counter((r.doc_id, r.source) for r in mixed.collect()) == want


def test_empty_table(documents):
    assert mixing.mix(documents([])).collect() == []
    assert mixing.repeat_rows(documents([])).collect() == []
