"""Repeat removal against a brute-force version."""

from __future__ import annotations

import hashlib
import random

import numpy as np

from rowtide.llm import repeats

N = repeats.LENGTH


def brute(rows):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) by looking every window up in a table of least documents."""
    least: dict[bytes, float] = {}
    key = lambda i: float("inf") if i is None else i
    for i, text in rows:
        b = (text or "").encode()
        for k in range(len(b) - N + 1):
            w = b[k : k + N]
            least[w] = min(least.get(w, float("inf")), key(i))
    out = []
    for i, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - N + 1):
            if least[b[k : k + N]] < key(i):
                gone[k : k + N] = b"\1" * N
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def found(df):
    return sorted([tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()], key=str)


def test_random_texts_with_shared_passages(documents):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeé ü") for _ in range(rng.randint(1, 9))) for _ in range(40)]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randint(8, 60))) for _ in range(12)]
    rows = []
    for i in range(90):
        parts = [rng.choice(passages)[rng.randint(0, 20) :] if rng.random() < 0.5 else " ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 5))]
        rows.append((i * 3 - 20, "".join(parts)))
    assert found(repeats.remove_repeats(documents(rows))) == sorted(brute(rows), key=str)


def test_edge_cases(documents):
    passage = "the quick brown fox jumps over the lazy dog and runs away into the dark forest"
    rows = [
        (5, passage), (3, passage), (3, passage), (9, passage + "x" + passage), (None, passage), (None, passage), (4, None), (6, ""), (7, "a" * 400), (8, "a" * 49), (10, "a" * 50), (11, passage[:49]), (12, passage[:50]),
        (13, "zz" + passage[5:70] + "zz"), (14, "ü" * 25), (15, "ü" * 24 + "u"), (16, "ü" * 26),
    ]
    assert found(repeats.remove_repeats(documents(rows))) == sorted(brute(rows), key=str)


def test_periodic_and_long_texts(documents):
    rng = random.Random(5)
    long = "".join(rng.choice("ab") for _ in range(3_000))
    rows = [(1, "ab" * 300), (2, "ba" * 300), (3, "abc" * 200 + long), (4, long[100:900] + "abc" * 40), (5, long * 2), (6, "\n".join(["repeated line of text"] * 30))]
    assert found(repeats.remove_repeats(documents(rows))) == sorted(brute(rows), key=str)


def test_segments_do_not_matter(documents, monkeypatch):
    """Windows across the borders of what is handled at once."""
    monkeypatch.setattr(repeats, "SEGMENT", 64)
    rng = random.Random(7)
    base = "".join(rng.choice("abcdef ") for _ in range(500))
    data = [(k, base[rng.randint(0, 200) : rng.randint(250, 500)]) for k in range(12)]
    import numpy as np

    raw = np.frombuffer("".join(t for _, t in data).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t) for _, t in data)])
    small = repeats.Runs(raw, offsets, True)
    monkeypatch.setattr(repeats, "SEGMENT", 1 << 20)
    whole = repeats.Runs(raw, offsets, True)
    covered = lambda r: sorted({x for a, b in zip(r.first.tolist(), r.last.tolist(), strict=True) for x in range(a, b + 1)})
    assert covered(small) == covered(whole)


def test_kept_text_and_empty_table(documents):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, passage), (2, "A " + passage + " Z")]
    kept = {r.doc_id: bytes(r.kept) for r in repeats.remove_repeats(documents(rows), text=True).collect()}
    assert kept == {1: passage.encode(), 2: b"A  Z"}
    assert repeats.remove_repeats(documents([])).collect() == []


def test_suffix_array_sorts_and_groups_windows():
    rng = random.Random(11)
    contexts = []
    for _ in range(60):
        unit = "".join(rng.choice("ab\0é") for _ in range(rng.randint(1, 30)))
        contexts.append((unit * 90).encode()[: rng.randint(N, N + repeats.WINDOWS - 1)])
    contexts += [c[5:] + b"x" * 5 for c in contexts[:30]]
    text = np.frombuffer(b"".join(contexts), np.uint8)
    ends = np.repeat(np.cumsum([len(c) for c in contexts]), [len(c) for c in contexts])
    left = (ends - np.arange(len(text))).astype(np.int32)
    for together in (1, 50, 1 << 17):
        repeats.TOGETHER, before = together, repeats.TOGETHER
        order = repeats.suffix_array(text, left).tolist()
        repeats.TOGETHER = before
        assert sorted(order) == list(range(len(text)))
        windows = [text[i : i + N].tobytes() for i in order if left[i] >= N]
        assert windows == sorted(windows)
    assert repeats.suffix_array(text[:0], left[:0]).tolist() == []


def test_equality_is_decided_on_bytes():
    text = np.frombuffer(b"a" * 60 + b"a" * 59 + b"b", np.uint8)
    assert repeats.equal_windows(text, np.array([0, 0]), np.array([1, 70])).tolist() == [True, False]
    assert repeats.equal_spans(text, np.array([0, 0]), text, np.array([60, 61]), np.array([59, 59])).tolist() == [True, False]


def test_many_blocks_and_cells(spark, documents, monkeypatch):
    """The driver's documents in tens of blocks and cells, against brute force."""
    monkeypatch.setattr(repeats, "LEAST_BLOCK_BYTES", 20_000)
    monkeypatch.setattr(repeats, "CELL_ANCHORS", 500)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert sum(len((t or "").encode()) for _, t in rows) > 20 * 20_000
    assert found(repeats.remove_repeats(docs)) == sorted(brute(rows), key=str)
    rng = random.Random(8)
    passages = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(40, 300))) for _ in range(30)]
    rows = [(i, "".join(rng.choice(passages)[rng.randint(0, 30) :] for _ in range(rng.randint(1, 6)))) for i in range(300)]
    assert found(repeats.remove_repeats(documents(rows))) == sorted(brute(rows), key=str)
