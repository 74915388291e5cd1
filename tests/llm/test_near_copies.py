"""Near-duplicates against all pairs, components against union-find."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rowtide.llm import near_copies
from rowtide.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words)} if len(words) < n else {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def roots(nodes, links):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}


def brute(rows, n):
    sets = [(i, shingles(t, n)) for i, t in rows]
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if x and y and 100 * len(x & y) >= 80 * len(x | y)]
    label = roots([i for i, _ in sets], links)
    return sorted((i, len(s), label[i], label[i] == i) for i, s in sets)


def found(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect())


def corpus(seed, groups, size):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, at = [], 0
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(5, 80))]
        for _ in range(rng.randint(1, size)):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((at, " ".join(words)))
            at += 1
    rng.shuffle(rows)
    return [(k * 7 % (7 * len(rows) + 1), t) for k, (_, t) in enumerate(rows)]


@pytest.mark.parametrize("words", [2, 5])
def test_random_groups(documents, words):
    rows = corpus(words, 60, 6)
    assert found(near_copies.near_duplicates(documents(rows), words, 80)) == brute(rows, words)


def test_a_large_group_of_near_copies(documents):
    """More members than a node compares exhaustively, drifting apart from its centre."""
    rng = random.Random(1)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(700):
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(f"y{i}-{j}" for j in range(12))) for i in range(300)]
    assert found(near_copies.near_duplicates(documents(rows, extra=False), 2, 80)) == brute(rows, 2)


def test_links_in_large_nodes_that_branch_on(spark):
    """Crowds of texts just below the similarity in which each has one link of its own: every link is found."""
    rng = random.Random(4)
    rows, new = [], (f"v{i}" for i in range(10**9))
    for _ in range(12):
        base = [next(new) for _ in range(200)]
        for _ in range(75):
            at = rng.sample(range(200), 30)
            for own in (at[8:19], at[19:30]):  # 178 of 222 in common with the partner
                rows.append((len(rows), " ".join(next(new) if k in own else f"p{len(rows) // 2}.{k}" if k in at[:8] else w for k, w in enumerate(base))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_copies.near_duplicates(df, 1, 80).collect()}
    assert [i for i in range(0, len(rows), 2) if got[i] != got[i + 1]] == []
    assert len(set(got.values())) == len(rows) // 2


def test_nodes_of_like_members_are_not_branched_on(spark):
    """By the shares of equal bytes of all pairs of their blocks."""
    rng = np.random.default_rng(3)
    like = rng.integers(0, 256, near_copies.COORDINATES)
    alike = [np.where(rng.random(near_copies.COORDINATES) < 0.1, rng.integers(0, 256, near_copies.COORDINATES), like) for _ in range(60)]
    low = np.array([*alike, *rng.integers(0, 256, (40, near_copies.COORDINATES))], np.uint8)
    node = [7] * 60 + [8] * 40
    batch = pa.RecordBatch.from_arrays([pa.array(node), pa.array(range(100)), pa.array([x.tobytes() for x in low], pa.binary())], ["node", "member", "bytes"])
    found = [r for b in near_copies.best_partners(iter([batch])) for r in b.to_pylist()]
    blocks = {r["node"]: (r["agree"], r["pairs"]) for r in found if r["a"] == r["b"]}
    for n in (7, 8):
        of = [k for k, x in enumerate(node) if x == n]
        pairs = [(low[i] == low[j]).mean() for i in of for j in of if i < j]
        assert blocks[n] == (pytest.approx(sum(pairs)), len(pairs))
    table = spark.createDataFrame([(r["node"], r["agree"], r["pairs"]) for r in found], "node long, agree double, pairs long")
    judged = table.groupBy("node").agg(near_copies.branches(F.col("agree"), F.col("pairs")).alias("branch"))
    assert {r.node: r.branch for r in judged.collect()} == {7: False, 8: True}


def test_trees_hold_the_missed_share_at_the_deepest_level():
    """Pairs of similarity 0.8 with shared coordinates, sent down the trees and the subtrees."""
    rng = np.random.default_rng(5)
    n, depth = 20_000, 2
    low = rng.integers(0, 256, (2 * n, near_copies.COORDINATES), np.uint8)
    same = rng.random((n, near_copies.COORDINATES)) < 0.8
    low[n:][same] = low[:n][same]
    met = np.zeros(n, bool)
    for tree in range(near_copies.enough_trees(depth)):
        member = np.arange(2 * n)
        # a root of its own for each pair
        node = near_copies.mix64(np.tile(np.arange(n, dtype=np.uint64), 2) + np.uint64(tree << 32))
        for _ in range(depth):
            node, member = near_copies.branched(node, member, low)
        for k in range(near_copies.SUBTREES):
            below, who = near_copies.mix64(node + np.uint64(k)) if k else node, member
            for _ in range(near_copies.MORE_LEVELS):
                up = who
                below, at = near_copies.branched(below, np.arange(len(who)), low[up])
                who = up[at]
            order = np.lexsort((who, below))
            below, who = below[order], who[order]
            pair = (below[1:] == below[:-1]) & (who[1:] % n == who[:-1] % n) & (who[1:] != who[:-1])
            met[who[1:][pair] % n] = True
    assert (~met).mean() <= 5 * near_copies.MISSED
    print("missed", int((~met).sum()), "of", n)


def test_edge_cases(documents):
    rows = [(1, "a b c d e"), (2, "A B\tC d x e"), (3, "A b C\nD  e"), (4, None), (5, ""), (6, " \t\n"), (7, "word"), (8, "WORD"), (9, "É b"), (10, "é b"), (11, "a b"), (12, "b a"), (13, "a b a b a b a b"), (14, "a b a")]
    for n in (2, 5):
        assert found(near_copies.near_duplicates(documents(rows), n, 80)) == brute(rows, n)


def test_exactly_at_the_border(documents):
    """8 of 10 shingles shared links, 79 of 100 does not."""
    at = [(1, " ".join(f"a{i}" for i in range(10))), (2, " ".join(f"a{i}" for i in range(9)) + " b")]
    below = [(3, " ".join(f"c{i}" for i in range(80)) + " p q r s t"), (4, " ".join(f"c{i}" for i in range(80)) + " " + " ".join(f"d{i}" for i in range(16)))]
    assert found(near_copies.near_duplicates(documents(at + below), 2, 80)) == brute(at + below, 2)


def test_null_ids_repeated_rows_and_empty_table(documents):
    rows = [(None, "a b c"), (None, "a b c"), (3, "a b c"), (3, "a b c"), (5, "a b c"), (5, "x y z"), (6, "x y z")]
    out = near_copies.near_duplicates(documents(rows), 2, 80).collect()
    assert len(out) == 7
    assert sorted((r.doc_id, r.component_id, r.kept) for r in out if r.doc_id is not None) == [(3, 3, True), (3, 3, True), (5, 3, False), (5, 5, True), (6, 5, False)]
    assert all(r.component_id is None and r.kept for r in out if r.doc_id is None)
    empty = near_copies.near_duplicates(documents([]))
    assert empty.collect() == []


def test_without_near_copies_keeps_columns(documents):
    docs = documents([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "other words that stand here alone"), (4, None)])
    left = near_copies.without_near_copies(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [1, 3, 4]


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)]
    nodes = sorted({x for link in links for x in link})
    out = components(spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.label for r in out.collect()} == roots(nodes, links)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_sketches_agree_at_the_expected_rate():
    """A pair of similarity 0.8 shares about 80 % of its minwise bytes."""
    import numpy as np
    import pyarrow as pa

    a = " ".join(f"u{i}" for i in range(901))
    b = " ".join(f"u{i}" for i in range(801)) + " " + " ".join(f"v{i}" for i in range(100))
    rows, hashes = near_copies.shingle_sets(pa.array([a, b]), 2)
    x, y = hashes[rows == 0], hashes[rows == 1]
    low = [np.array([near_copies.mix64(np.array([np.min(s * near_copies._SEEDS[k] ^ near_copies._SEEDS[-k - 1])]))[0] for k in range(near_copies.COORDINATES)]) for s in (x, y)]
    similarity = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    assert abs((low[0] == low[1]).mean() - similarity) < 0.15


def test_lowest_hashes_rule_out_no_link():
    draw = np.random.default_rng(5)
    n = near_copies.FINE

    def lowest(hashes):
        return np.unique(hashes)[: n + 1]

    for size in (3, 100, n, n + 1, 5 * n):
        one = draw.choice(1 << 32, size, replace=False).astype(np.uint32)
        near, far = [], []
        for _ in range(20):
            # 8 of 9 kept on each side: similarity 0.8 just about
            new = draw.choice(1 << 32, size // 9, replace=False).astype(np.uint32)
            near.append(lowest(np.concatenate((one[size // 9 :], new))))
            new = draw.choice(1 << 32, size // 2, replace=False).astype(np.uint32)
            far.append(lowest(np.concatenate((one[size // 2 :], new))))
        assert near_copies.likely(lowest(one), near, 80).all()
        if size >= 100:
            assert not near_copies.likely(lowest(one), far, 80).any()
    assert near_copies.likely(None, [None, one[:1]], 80).all()
    assert near_copies.likely(lowest(one), [None], 80).all()


def test_rows_are_told_by_id_and_text(documents):
    """Texts that share an id are rows of their own; repeated rows leave one; a text never vanishes."""
    a, b = ("one two three four five six seven eight", "other words than those of the first text at all")
    left = near_copies.without_near_copies(documents([(3, a), (5, a), (5, b), (6, b), (6, b)]))
    assert sorted((r.doc_id, r.text) for r in left.collect()) == [(3, a), (5, b)]
    left = near_copies.without_near_copies(documents([(1, a), (1, a), (1, a), (2, ""), (2, ""), (2, None), (None, a), (None, a)]))
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([(1, a), (2, ""), (None, a), (None, a)], key=str) or sorted(((r.doc_id, r.text or "") for r in left.collect()), key=str) == sorted([(1, a), (2, ""), (None, a), (None, a)], key=str)


def test_clashing_columns_stay(documents):
    docs = documents([(1, "a b c d e f"), (2, "a b c d e f")]).selectExpr("*", "1 as text_id", "2 as `row`", "3 as key")
    left = near_copies.without_near_copies(docs)
    assert left.columns == docs.columns
    assert [(r.doc_id, r.text_id, r.row) for r in left.collect()] == [(1, 1, 2)]
