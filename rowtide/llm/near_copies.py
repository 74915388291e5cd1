"""MinHash near-duplicates by a chosen-path set similarity join.

Documents are sets of word shingles. Equal sets are one class. Every class has ``COORDINATES`` minwise values (a byte of each is
kept: two sets agree at one with probability J + (1 - J) / 256). A tree branches the classes recursively: a node picks one
coordinate, or two with probability 1/4, so 1 / 0.8 on average, and its members go to a child by their byte there.
Which coordinates is decided by a hash of the node's path alone, so all members agree without talking to each other. Two
sets that agree in a share s of the coordinates meet in depth d of a tree with probability p(d), where
p(d + 1) = 1.25 s p(d) - 0.25 s^2 p(d)^2. All trees use the same coordinates, so a pair that agrees in few of them is weak in
every tree: trees are repeated until, over the binomial distribution of s, fewer than one in ten thousand pairs of similarity
0.8 is missed. That holds at the deepest level as well: where large nodes branch on, each does so in several subtrees.

Small nodes are compared exhaustively by their bytes; what may be similar is confirmed on the full sets. Links only matter for
the components they make, which saves most of them. First each class confirms its best partner, and members of large nodes
their node's pivot, the member most like the node's average: large nodes are cut into blocks for that, each names its best
candidate and the best of these is the pivot. Then only pairs that still lie in different components are looked at: all
of them in small nodes; in large nodes where nearly all is one component, the few others against all; in large nodes whose
members agree so much that branching would leave no less to compare, all outside the largest component against all; other large
nodes branch on. Large groups of texts just below the similarity give many pairs that 128 bytes cannot tell from links, so members
of large nodes also have their ``FINE`` lowest shingle hashes: short sets are whole in them, longer ones well estimated.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowtide.llm.common import by_bytes, byte_view, mix64, span_hashes, word_spans
from rowtide.llm.components import components
from rowtide.llm.skew import MOST_COMMON, common, join_by
from rowtide.sources import shared

COORDINATES = 128
#: Rows that go to a Python worker at once: they carry texts and whole sets.
AT_ONCE = 500
#: Bytes of text whose shingles are made at once (one longer text is taken alone).
PIECE = 1 << 18
#: Nodes of up to this many classes are compared exhaustively.
SMALL = 32
#: Members of the blocks that large nodes are cut into, about.
BLOCK = 256
#: Members on either side of a block in which those outside a large node's largest component meet the node's others.
SIDE = 1024
#: Lowest shingle hashes that are kept of the members of large nodes (4 bytes each).
FINE = 512
#: Levels by which large nodes are branched on at most.
MORE_LEVELS = 4
#: Subtrees in which each large node branches on.
SUBTREES = 3
#: Share of equal bytes from which a pair is confirmed: 4.2 standard deviations below what a similarity of 0.8 gives.
SHOWN = 0.65
MISSED = 1e-4
#: Pairs that one copy of a set is joined with, about: sets of many pairs are copied.
PAIRS_OF_A_SET = 1024
#: Ids up to this many are broadcast (8 bytes each).
MOST_BROADCAST = 500_000
_FOLD = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = mix64(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)


def cut(df: DataFrame) -> DataFrame:
    """``df`` stored in the shared folder, with at most ``AT_ONCE`` rows at a time in Python workers."""
    conf, rows = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(rows)
    conf.set(rows, AT_ONCE)
    try:
        return shared.stored(df)
    finally:
        conf.set(rows, before)


def shingle_sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and 64-bit hash of each distinct shingle, ordered by row and hash; A-Z lower-cased, a shorter text is one shingle."""
    data, offsets = byte_view(column)
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    starts, ends, row = word_spans(data, offsets)
    hashes = span_hashes(data, starts, ends)
    folded = hashes.copy()
    for k in range(1, words):
        folded = folded[:-1] * _FOLD + hashes[k:] if len(folded) else folded
    whole = row[words - 1 :] == row[: len(row) - words + 1] if len(row) >= words else np.zeros(0, bool)
    folded, rows = mix64(folded[: len(whole)][whole]), row[: len(whole)][whole]
    counts = np.bincount(row, minlength=len(offsets) - 1)
    first = np.concatenate(([0], np.cumsum(counts)))[:-1]
    for n in range(1, words):  # texts of n words
        of = np.flatnonzero(counts == n)
        short = hashes[first[of]]
        for k in range(1, n):
            short = short * _FOLD + hashes[first[of] + k]
        folded, rows = np.concatenate((folded, mix64(short + np.uint64(n)))), np.concatenate((rows, of))
    order = np.lexsort((folded, rows))
    folded, rows = folded[order], rows[order]
    new = np.ones(len(rows), bool)
    new[1:] = (folded[1:] != folded[:-1]) | (rows[1:] != rows[:-1])
    return rows[new], folded[new]


def text_id() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_id")


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, text_id (a hash of the text), n_shingles, a 128-bit key of the set (key, key2) and its minwise bytes; no key and bytes
    for an empty set."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text", PIECE):
                rows, shingles = shingle_sets(part.column("text"), words)
                n = np.bincount(rows, minlength=part.num_rows)
                has = n > 0
                starts = np.concatenate(([0], np.cumsum(n[has])))[:-1].astype(np.int64)
                low = np.zeros((len(starts), COORDINATES), np.uint8)
                keys = [np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64)]
                if len(starts):
                    for k in range(COORDINATES):
                        low[:, k] = mix64(np.minimum.reduceat(shingles * _SEEDS[k] ^ _SEEDS[-k - 1], starts))
                    for k, key in enumerate(keys):
                        key[has] = np.add.reduceat(mix64(shingles + np.uint64(k)), starts).view(np.int64)
                raw: list = [None] * part.num_rows
                for i, j in enumerate(np.flatnonzero(has).tolist()):
                    raw[j] = low[i].tobytes()
                made = [part.column("doc_id"), part.column("text_id"), pa.array(n, pa.int64()), *(pa.array(k, mask=~has) for k in keys), pa.array(raw, pa.binary())]
                yield pa.RecordBatch.from_arrays(made, ["doc_id", "text_id", "n_shingles", "key", "key2", "bytes"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_id(), "text").mapInArrow(sketch, "doc_id long, text_id long, n_shingles long, key long, key2 long, bytes binary")


def branched(node: np.ndarray, member: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Children of the nodes that each member goes to: (child, member); ``low``: bytes by member."""
    h = mix64(node)
    one = (h % np.uint64(COORDINATES)).astype(np.int64)
    other = (one + 1 + ((h >> np.uint64(16)) % np.uint64(COORDINATES - 1)).astype(np.int64)) % COORDINATES
    also = h >> np.uint64(62) == 0
    out = []
    for coordinate, of in ((one, slice(None)), (other, also)):
        at, who, up = coordinate[of], member[of], h[of]
        out.append((mix64(up + mix64((at << 8 | low[who, at]).astype(np.uint64) + np.uint64(1))), who))
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def _bytes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, COORDINATES)


def chance(depth: int, share: float, last: float = 1.0) -> float:
    """That two sets with a share of equal bytes meet in ``depth``; ``last``: that they are compared where they meet."""
    p = last
    for _ in range(depth):
        p = 1.25 * share * p - 0.25 * share * share * p * p
    return p


def missed(depth: int, trees: int) -> float:
    """Share of the pairs of similarity 0.8 that meet in no tree, if all nodes in ``depth`` branch on to the deepest level."""
    agree = 0.8 + 0.2 / 256
    total = 0.0
    for equal in range(COORDINATES + 1):
        share = equal / COORDINATES
        below = 1 - (1 - chance(MORE_LEVELS, share)) ** SUBTREES
        of = math.comb(COORDINATES, equal) * agree**equal * (1 - agree) ** (COORDINATES - equal)
        total += of * (1 - chance(depth, share, below)) ** trees
    return total


def enough_trees(depth: int) -> int:
    return next(n for n in itertools.count(1) if missed(depth, n) <= MISSED)


def rooted(classes: DataFrame, depth: int, trees: int) -> DataFrame:
    """(node, member) of all classes in ``depth`` of every tree."""

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, ids = _bytes(batch.column("bytes")), batch.column("member").to_numpy()
            for tree in range(trees):
                member = np.arange(len(ids))
                node = np.full(len(ids), mix64(np.array([tree + 1], np.uint64))[0])
                for _ in range(depth):
                    node, member = branched(node, member, low)
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(ids[member])], ["node", "member"])

    return classes.select("member", "bytes").mapInArrow(descend, "node long, member long")


def deeper(nodes: DataFrame, classes: DataFrame, subtrees: int = 1) -> DataFrame:
    """The children of ``nodes`` (node, member, label), in so many subtrees of each."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, label = batch.column("member").to_numpy(), batch.column("label").to_numpy()
            up, low = batch.column("node").to_numpy().view(np.uint64), _bytes(batch.column("bytes"))
            for k in range(subtrees):
                root = mix64(up + np.uint64(k)) if k else up
                node, member = branched(root, np.arange(len(ids)), low)
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(ids[member]), pa.array(label[member])], ["node", "member", "label"])

    return nodes.join(classes.select("member", "bytes"), "member").select("node", "member", "label", "bytes").mapInArrow(step, "node long, member long, label long")


def sized(nodes: DataFrame) -> DataFrame:
    """(node, member, size) of the nodes of two members at least; sizes are added up before their shuffle."""
    counts = cut(nodes.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    return cut(join_by(nodes, "node", counts, "node", common(counts, "node", "size", _total(counts))))


def divided(nodes: DataFrame) -> DataFrame:
    """Members (node, member, label) of the nodes that hold several components, with the node's size and its largest one, ``top``."""
    nodes = nodes.select("node", "member", "label")
    parts = nodes.groupBy("node", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = parts.groupBy("node").agg(F.sum("n").alias("size"), F.max("n").alias("most"), F.max_by("label", F.struct("n", "label")).alias("top"), F.count(F.lit(1)).alias("parts"))
    mixed = cut(mixed.where("parts > 1").drop("parts"))
    return cut(join_by(nodes, "node", mixed, "node", common(mixed, "node", "size", _total(mixed))))


def _total(sizes: DataFrame) -> int:
    return sizes.agg(F.sum("size").alias("n")).first().n or 0


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
    """Batches of whole nodes from rows sorted by node: starts, sizes, rows. A node has few rows, so little is carried over."""
    held = None
    for batch in batches:
        held = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch]).combine_chunks()
        node = held.column("node").to_numpy()
        last = int(np.searchsorted(node, node[-1], "left")) if len(node) else 0
        if last:
            yield _starts(held.slice(0, last))
            held = held.slice(last)
    if held is not None and held.num_rows:
        yield _starts(held)


def _starts(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.RecordBatch]:
    rows = rows.combine_chunks()
    node = rows.column("node").to_numpy()
    starts = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
    return starts, np.diff(np.append(starts, len(node))), rows.to_batches()[0]


def best_partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each member's best partner in its block (a, b, shown), and each block's candidate for its node's pivot (a = b), with the number
    of the block's pairs and their shares of equal bytes, added up (``agree``)."""
    for starts, sizes, rows in _groups(batches):
        ids, low, node = rows.column("member").to_numpy(), _bytes(rows.column("bytes")), rows.column("node").to_numpy()
        out: list[tuple] = []
        for size in np.unique(sizes):
            of = starts[sizes == size]
            for at in np.array_split(of, max(1, len(of) * size * size // 20_000)):
                members = at[:, None] + np.arange(size)
                like = _likeness(low[members])
                total = like.sum(2)
                pivot = members[np.arange(len(at)), total.argmax(1)]
                like[:, np.arange(size), np.arange(size)] = -1
                to = like.argmax(2)
                x, y, shown = np.take_along_axis(members, to, 1).ravel(), members.ravel(), like.max(2).ravel()
                keep = shown >= SHOWN
                none = np.zeros(int(keep.sum()))
                out.append((ids[x[keep]], ids[y[keep]], shown[keep], node[y[keep]], none, none.astype(np.int64)))
                out.append((ids[pivot], ids[pivot], total.max(1) / size, node[pivot], (total.sum(1) - size) / 2, np.full(len(at), size * (size - 1) // 2, np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["a", "b", "shown", "node", "agree", "pairs"])


def _likeness(low: np.ndarray) -> np.ndarray:
    """Shares of equal bytes between the members of each block."""
    same = np.zeros((len(low), low.shape[1], low.shape[1]), np.int16)
    for k in range(COORDINATES):
        same += low[:, :, None, k] == low[:, None, :, k]
    return same / COORDINATES


def branches(agree: Column, pairs: Column) -> Column:
    """Whether to branch on below a large node leaves less to compare than the node itself has.

    Pairs that agree in a share s of their bytes meet SUBTREES (5/4 s)^MORE_LEVELS times on average at the deepest level; s is the
    mean over the pairs of the node's blocks. Members of one large group agree in most, so branching would only multiply them.
    """
    share = F.coalesce(F.try_divide(F.sum(agree), F.sum(pairs)), F.lit(0.0))
    return SUBTREES * F.pow(1.25 * share, F.lit(MORE_LEVELS)) < 1


def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs within nodes that look similar and have different labels."""
    for starts, sizes, rows in _groups(batches):
        ids, low, label = rows.column("member").to_numpy(), _bytes(rows.column("bytes")), rows.column("label").to_numpy()
        out = [(ids[:0], ids[:0])]
        for size in np.unique(sizes):
            of = starts[sizes == size]
            i, j = np.triu_indices(size, 1)
            for at in np.array_split(of, max(1, len(of) * size * size // 20_000)):
                members = at[:, None] + np.arange(size)
                node, pair = np.nonzero(label[members[:, i]] != label[members[:, j]])
                x, y = members[node, i[pair]], members[node, j[pair]]
                keep = (low[x] == low[y]).mean(1) >= SHOWN
                out.append((ids[x[keep]], ids[y[keep]]))
        a, b = (np.concatenate(x) for x in zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def finer(docs: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """member and ``lowest``: the up to ``FINE`` + 1 lowest 32-bit hashes of its shingles, ascending; whole if not more than ``FINE``."""
    if members.count() <= MOST_BROADCAST:
        members = F.broadcast(members)

    def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text", PIECE):
                rows, shingles = shingle_sets(part.column("text"), words)
                short = (mix64(shingles) >> np.uint64(32)).astype(np.uint32)
                ends = np.searchsorted(rows, np.arange(part.num_rows + 1))
                raw = [np.unique(short[i:j])[: FINE + 1].tobytes() for i, j in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(raw, pa.binary())], ["member", "lowest"])

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(members.withColumnRenamed("member", "doc_id"), "doc_id", "left_semi")
    # rows that share an id have several sets: which one a class stands for is open, so none is ruled out
    found = wanted.mapInArrow(lowest, "member long, lowest binary").groupBy("member").agg(F.count(F.lit(1)).alias("n"), F.min("lowest").alias("lowest"))
    return cut(found.select("member", F.when(F.col("n") == 1, F.col("lowest")).alias("lowest")))


def likely(one: np.ndarray | None, others: list[np.ndarray | None], percent: int) -> np.ndarray:
    """Which of ``others`` may have ``percent`` in common with ``one``, by their lowest hashes; true where one is not known.

    Below the smallest hash that either side left out both sets are whole, so the shares there are those of a random sample of
    the union, or exact if neither left out any. Beside 4.2 standard deviations one hash is allowed for equal short hashes.
    """
    maybe = np.ones(len(others), bool)
    known = [] if one is None else [k for k, x in enumerate(others) if x is not None]
    if not known:
        return maybe
    sizes = np.array([len(others[k]) for k in known])
    every = np.concatenate([others[k] for k in known])
    starts = np.cumsum(sizes) - sizes
    most = np.uint64(1 << 32)
    own_end = np.uint64(one[FINE]) if len(one) > FINE else most
    end = np.array([min(own_end, np.uint64(others[k][FINE])) if len(others[k]) > FINE else own_end for k in known], np.uint64)
    within = every < np.repeat(end, sizes)
    at = np.searchsorted(one, every)
    both = within & (one[np.minimum(at, len(one) - 1)] == every)
    shared = np.add.reduceat(both, starts, dtype=np.int64)
    union = np.add.reduceat(within, starts, dtype=np.int64) + np.searchsorted(one.astype(np.uint64), end) - shared
    share = percent / 100
    slack = np.where(end < most, 4.2 * np.sqrt(share * (1 - share) / np.maximum(union, 1)), 0)
    maybe[known] = shared + 1 >= (share - slack) * (union - 1)
    return maybe


def _together(nodes: DataFrame, *key: str) -> DataFrame:
    """Rows of a node (or block) in one task and side by side; they are about ``BLOCK`` at most."""
    return nodes.repartition(*key).sortWithinPartitions(*key, "member")


def confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union. ``pairs`` is read several times.

    A set that many pairs need is copied, and its pairs are dealt among the copies.
    """
    degrees = cut(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).groupBy("id").agg(F.count(F.lit(1)).alias("n")))
    size = degrees.agg(F.count(F.lit(1)).alias("ids"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs")).first()
    often = degrees.where(F.col("n") > max(PAIRS_OF_A_SET, size.pairs // MOST_COMMON)).select("id", F.ceil(F.col("n") / PAIRS_OF_A_SET).alias("copies"))
    ids = degrees.select(F.col("id").alias("doc_id"))
    needed = F.broadcast(ids) if size.ids <= MOST_BROADCAST else ids

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text", PIECE):
                rows, shingles = shingle_sets(part.column("text"), words)
                ends = np.searchsorted(rows, np.arange(part.num_rows + 1))
                raw = [shingles[i:j].tobytes() for i, j in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(raw, pa.large_binary()).cast(pa.binary())], ["id", "shingles"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(needed, "doc_id", "left_semi").mapInArrow(sets, "id long, shingles binary")
    if often.isEmpty():
        both = pairs.join(found.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(found.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
        return both.select("a", "b", "x", "y").mapInArrow(_confirm(percent), "a long, b long").distinct()
    copied = found.join(F.broadcast(often), "id", "left").select("id", "shingles", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("copies", F.lit(1).cast("long")))).alias("copy"))
    left = copied.select(F.col("id").alias("a"), F.col("copy").alias("copy_a"), F.col("shingles").alias("x"))
    right = copied.select(F.col("id").alias("b"), F.col("copy").alias("copy_b"), F.col("shingles").alias("y"))
    dealt = pairs
    for own, other in (("a", "b"), ("b", "a")):
        of = F.broadcast(often.select(F.col("id").alias(own), F.col("copies").alias(f"_{own}")))
        dealt = dealt.join(of, own, "left").withColumn(f"copy_{own}", F.pmod(F.xxhash64(other), F.coalesce(f"_{own}", F.lit(1).cast("long"))) + 1)

    return dealt.join(left, ["a", "copy_a"]).join(right, ["b", "copy_b"]).select("a", "b", "x", "y").mapInArrow(_confirm(percent), "a long, b long").distinct()


def _confirm(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    good.append(False)
                    continue
                both = np.concatenate((x, y))
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                good.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return confirm


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    Null, empty and blank texts have no shingles and link with nothing; a null id links with nothing, its row has a null
    component and is kept; of rows that share an id each has the component of its own set, and a link of either set counts. ``percent`` must be 80 or more: the
    trees are laid out for that. An empty table gives an empty result. Nothing is capped: the one step that can grow with
    a node's square is between its largest component and the members outside it, where branching on did not part them.
    """
    return _marked(docs, words, percent).drop("text_id")


def _marked(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The rows of :func:`near_duplicates` with their text_id."""
    with shared.scratch(docs.sparkSession) as kept:
        return _components_of(docs, words, percent, kept)


def _components_of(docs: DataFrame, words: int, percent: int, kept: list[DataFrame]) -> DataFrame:
    sketched = cut(sketches(docs, words))
    usable = sketched.where("doc_id is not null and n_shingles > 0")
    classes = cut(usable.groupBy("key", "key2", "n_shingles").agg(F.min("doc_id").alias("member"), F.min("bytes").alias("bytes")))
    n = classes.count()
    depth = max(1, math.ceil(math.log(max(n, 1) / SMALL + 1, 20)))
    nodes = sized(rooted(classes, depth, enough_trees(depth)))
    sketch = classes.select("member", "bytes")

    blocks = nodes.withColumn("block", F.pmod(F.xxhash64("member", "node"), F.floor(F.col("size") / BLOCK) + 1))
    # the blocks of one node need not stay together, but each must
    block_id = F.when(F.col("size") <= BLOCK, F.col("node")).otherwise(F.xxhash64("node", "block"))
    keyed = blocks.join(sketch, "member").select(block_id.alias("node"), "member", "bytes")
    found = cut(_together(keyed, "node").mapInArrow(best_partners, "a long, b long, shown double, node long, agree double, pairs long"))
    best = found.where("a <> b").groupBy("b").agg(F.max_by("a", F.struct("shown", -F.col("a"))).alias("a"))
    first = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    large = blocks.where(F.col("size") > SMALL).select("node", "member", "size", block_id.alias("block"))
    candidates = found.where("a = b").select(F.col("node").alias("block"), F.col("a").alias("pivot"), "shown", "agree", "pairs")
    of_blocks = large.select("node", "block").distinct().join(candidates, "block")
    pivots = cut(of_blocks.groupBy("node").agg(F.max(F.struct("shown", "pivot")).alias("p"), branches(F.col("agree"), F.col("pairs")).alias("branch")))
    often = cut(common(large.groupBy("node").agg(F.max("size").alias("size")), "node", "size", nodes.count()))
    pivoted = join_by(large.select("node", "member"), "node", pivots.select("node", "p"), "node", often).groupBy("member").agg(F.max("p")["pivot"].alias("pivot")).where("member <> pivot")
    first = cut(first.union(pivoted.select(F.least("member", "pivot").alias("a"), F.greatest("member", "pivot").alias("b"))).distinct())
    links = cut(confirmed(first, docs, words, percent))
    labels = components(links)

    known = labels.withColumnRenamed("node", "member")
    open_ = divided(nodes.join(known, "member", "left").select("node", "member", F.coalesce("label", "member").alias("label")))
    small: list[DataFrame] = []
    large_: list[DataFrame] = []
    fine = None
    for level in range(MORE_LEVELS + 1):
        small.append(open_.where(F.col("size") <= SMALL))
        dense = open_.where(F.col("size") > SMALL)
        if dense.isEmpty():
            break
        if fine is None:
            # children hold no other members
            fine = finer(docs, dense.select("member").distinct(), words)
        many = F.col("size") - F.col("most") > F.greatest(F.lit(SMALL), F.col("size") / 16)
        direct, left = (dense.where(~many), dense.where(many)) if level < MORE_LEVELS else (dense, dense.limit(0))
        if level == 0:
            judged = cut(join_by(left, "node", pivots.select("node", "branch"), "node", often))
            direct, left = direct.unionByName(judged.where("not branch").drop("branch")), judged.where("branch").drop("branch")
        large_.append(direct)
        if level < MORE_LEVELS:
            open_ = divided(cut(deeper(left, classes, 1 if level else SUBTREES)))
    # nodes of all levels at once: each level's are stored, and a job for each would cost more than its pairs
    compared = _together(functools.reduce(DataFrame.unionByName, small).join(sketch, "member").select("node", "member", "bytes", "label"), "node").mapInArrow(apart, "a long, b long")
    if large_:
        compared = compared.union(_others(functools.reduce(DataFrame.unionByName, large_), sketch, fine, percent))
    second = cut(compared.distinct().join(first, ["a", "b"], "left_anti"))
    more = cut(confirmed(second, docs, words, percent))
    if not more.isEmpty():
        # go on from the components that are known
        labels = components(more.union(labels.select(F.col("node").alias("a"), F.col("label").alias("b"))))
    kept += [sketched, classes]
    of_class = classes.join(labels.withColumnRenamed("node", "member"), "member", "left").select("key", "key2", "n_shingles", F.coalesce("label", "member").alias("component_id"))
    whole = sketched.select("doc_id", "text_id", "n_shingles", "key", "key2").join(of_class, ["key", "key2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return whole.select("doc_id", "text_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_near_copies(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the rows that :func:`near_duplicates` does not keep; all columns as they were.

    Rows are told by id and text: of rows that share an id, only the text that has a copy elsewhere goes. Of rows with the same id and
    text one stays; rows without an id all stay.
    """
    marked = cut(_marked(docs, words, percent).groupBy("doc_id", "text_id").agg(F.min("kept").alias("kept"), F.count(F.lit(1)).alias("n")).where("doc_id is not null and (not kept or n > 1)"))
    keys = [F.col(f"_m.{c}").eqNullSafe(F.col(f"_d.{c}")) for c in ("doc_id", "text_id")]
    # all columns of the caller in one, so that none can clash
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_id())
    few = F.broadcast if marked.count() <= MOST_BROADCAST else lambda x: x
    left = rows.alias("_d").join(few(marked).alias("_m"), keys, "left_anti")
    again = marked.where("kept")
    if not again.isEmpty():
        repeated = rows.alias("_d").join(few(again).alias("_m"), keys, "left_semi")
        # equal in id and text: any one of them, but the same one each time
        left = left.unionByName(repeated.groupBy("doc_id", "text_id").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row", "doc_id", "text_id"))
    return left.select("row.*")


def _others(nodes: DataFrame, sketch: DataFrame, fine: DataFrame, percent: int) -> DataFrame:
    """Similar-looking pairs between the members of large nodes outside the node's largest component and all others.

    The others are dealt to blocks and those outside to chunks; each block meets each chunk in a group of two ``SIDE`` at most, about.
    """
    outside = F.col("label") != F.col("top")
    rows = nodes.join(sketch, "member").join(fine, "member").withColumn("outside", outside)
    blocks, chunks = F.floor(F.col("size") / SIDE) + 1, F.floor((F.col("size") - F.col("most")) / SIDE) + 1
    block, chunk = F.pmod(F.xxhash64("member"), blocks), F.pmod(F.xxhash64("member", F.lit(1)), chunks)
    first = F.lit(0).cast("long")
    own = rows.select("*", block.alias("block"), F.explode(F.sequence(first, chunks - 1)).alias("chunk"), F.lit(False).alias("asks"))
    asking = rows.where("outside").select("*", F.explode(F.sequence(first, blocks - 1)).alias("block"), chunk.alias("chunk"), F.lit(True).alias("asks"))
    both = own.unionByName(asking).select("node", "block", "chunk", "member", "label", "bytes", "lowest", "outside", "asks")

    def compare(group: pa.Table) -> pa.Table:
        asks, out = group.column("asks").to_numpy(), group.column("outside").to_numpy()
        ids, label, low = group.column("member").to_numpy(), group.column("label").to_numpy(), _bytes(group.column("bytes").combine_chunks())
        lowest = [None if x is None else np.frombuffer(x, np.uint32) for x in group.column("lowest").to_pylist()]
        a, b = [ids[:0]], [ids[:0]]
        others = np.flatnonzero(~asks)
        for i in np.flatnonzero(asks):
            # two that both ask meet twice
            apart_ = others[(label[others] != label[i]) & (~out[others] | (ids[others] < ids[i]))]
            near = apart_[(low[apart_] == low[i]).mean(1) >= SHOWN]
            near = near[likely(lowest[i], [lowest[k] for k in near], percent)]
            a.append(np.minimum(ids[near], ids[i]))
            b.append(np.maximum(ids[near], ids[i]))
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return both.groupBy("node", "block", "chunk").applyInArrow(compare, "a long, b long")
