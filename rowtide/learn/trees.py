"""Trees over codes, their growth from histograms, and the Spark job that makes histograms.

A node's histogram has, for each feature and code, the sums of two statistics of its rows and their number, as whole numbers: sums are
exact, so a tree does not hang on how rows are dealt, merged or computed again. A job routes rows to nodes and adds up each task's
histograms before they travel; of two siblings only the smaller one is added up, the other is the parent's less it. Its size hangs
on features, codes and nodes alone. Of a node whose rows take no more bytes than its histogram the rows travel instead: all splits below
it then need no further job. Nodes of up to ``DEEP_ROWS`` rows are grown to their end in one task each.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, fields

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame

from rowtide.learn.binning import unpacked

#: Statistics are whole multiples of 1 / UNIT.
UNIT = 1 << 20
#: Bytes of the histograms of one job, elements counted at once, tasks whose sums the driver adds by itself.
JOB_BYTES, CHUNK, FEW_TASKS = 64 << 20, 1 << 24, 16
#: Rows that the executors' memory keeps as one element, rows of a node that one task grows to its end, and rows from which on features
#: are counted one by one.
KEPT_ROWS, DEEP_ROWS, MANY_ROWS = 1 << 16, 1 << 16, 1 << 10
SUMS = "slot int, data binary"


@dataclass
class Tree:
    """Node k goes to ``left`` if its feature's code is at most ``cut``; leaves have feature -1."""

    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self, value: float = 0.0) -> int:
        for x, v in ((self.feature, -1), (self.cut, 0), (self.left, -1), (self.right, -1), (self.value, value)):
            x.append(v)
        return len(self.feature) - 1

    def split(self, node: int, feature: int, cut: int, values: tuple[float, float] = (0.0, 0.0)) -> tuple[int, int]:
        self.feature[node], self.cut[node] = int(feature), int(cut)
        self.left[node], self.right[node] = self.add(values[0]), self.add(values[1])
        return self.left[node], self.right[node]

    def leaves(self, codes: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        """The leaf of each row of ``codes`` (rows by features; quicker if columns lie side by side), or of ``rows`` of them."""
        n = len(codes) if rows is None else len(rows)
        leaf, todo = np.zeros(n, np.int64), [(0, np.arange(n))]
        while todo:
            node, at = todo.pop()
            if self.feature[node] < 0:
                leaf[at] = node
            elif len(at):
                low = codes[:, self.feature[node]][at if rows is None else rows[at]] <= self.cut[node]
                todo += (self.left[node], at[low]), (self.right[node], at[~low])
        return leaf

    def values(self, codes: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves(codes)]


def units(x: np.ndarray) -> np.ndarray:
    return np.rint(x * UNIT)


@dataclass(frozen=True)
class Batch:
    """A batch of matrix rows as arrays."""

    ids: np.ndarray
    flags: np.ndarray
    weights: np.ndarray
    stop: np.ndarray
    margins: np.ndarray
    codes: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch, features: int) -> Batch:
        own = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "flag", "weight", "stop", "margin"))
        return cls(*own, unpacked(batch.column("bins"), features))


#: A batch to two statistics and the rows that count.
Statistics = Callable[[Batch], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _count(sums: np.ndarray, slot: np.ndarray, codes: np.ndarray, a: np.ndarray, b: np.ndarray, width: int, columns: np.ndarray | None = None, rows: np.ndarray | None = None) -> None:
    """Add rows to ``sums`` (slots, 3, features * width): all of ``codes``, or ``rows`` (rising) and ``columns`` of it."""
    own = np.arange(codes.shape[1]) if columns is None else columns
    f, slots = len(own), len(sums)
    to = sums.reshape(slots, 3, f, width)
    step, size = max(1, CHUNK // max(1, f)), slots * width
    for s in range(0, len(slot), step):
        p = slice(s, s + step)
        n, first, x, y = len(slot[p]), slot[p] * width, a[p], b[p]
        some = None if rows is None or len(rows) == len(codes) == n else rows[p]
        # whole numbers below 2**53 are exact; where there is room for it, the number of rows is added up above the second sum
        one = 2.0 ** math.ceil(math.log2(n * (float(y.max()) + 1) + 1))
        packed = y + one if float(y.min()) >= 0 and one * (n + 1) <= 2.0**53 else None
        if n < MANY_ROWS:
            # all features at once, as a call of numpy costs more than what it adds up
            at = ((slot[p, None] * f + np.arange(f)) * width + codes[p if some is None else some][:, own]).ravel()
            total = lambda z: np.bincount(at, None if z is None else np.repeat(z, f), slots * f * width).reshape(slots, f, width)  # noqa: B023, E731
            found = [total(z) for z in ((x, y, None) if packed is None else (x, packed))]
        else:
            found = [np.empty((f, size)) for _ in range(3 if packed is None else 2)]
            for k, column in enumerate(own):
                at = first + (codes[p, column] if some is None else codes[:, column].take(some))
                for sum_of, z in zip(found, (x, y, None) if packed is None else (x, packed), strict=True):
                    sum_of[k] = np.bincount(at, z, size)
            found = [z.reshape(f, slots, width).swapaxes(0, 1) for z in found]
        if packed is not None:
            number = np.floor(found[1] / one)
            found = [found[0], found[1] - number * one, number]
        for k, z in enumerate(found):
            to[:, k] += z.astype(np.int64)


def histograms(
    rows: DataFrame, features: int, columns: np.ndarray, width: int, statistics: Statistics, routes: list[tuple[Tree, dict[int, int]]], slots: int, also: Callable[[Batch], np.ndarray] | None = None, tasks: int = 1
) -> tuple[np.ndarray, np.ndarray | None]:
    """(slots, 3, len(columns), width) sums over ``rows``, and the sum of ``also`` (whole numbers of one shape) over all rows.

    ``routes``: trees, and the slot of each of their leaves that is wanted; ``tasks``: about as many as read ``rows``.
    """
    ways = [(tree, np.array([of.get(k, -1) for k in range(len(tree.feature))])) for tree, of in routes]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, more = np.zeros((slots, 3, len(columns) * width), np.int64), None
        for raw in batches:
            if not raw.num_rows:
                continue
            batch = Batch.of(raw, features)
            a, b, counts = statistics(batch)
            if also is not None:
                more = also(batch) if more is None else more + also(batch)
            for tree, slot_of in ways:
                slot = np.where(counts, slot_of[tree.leaves(batch.codes)], -1)
                some = np.flatnonzero(slot >= 0)
                _count(sums, slot[some], np.asfortranarray(batch.codes[some][:, columns]), a[some], b[some], width)
        yield _packed({**{k: s for k, s in enumerate(sums) if s[2].any()}, **({} if more is None else {-1: more})})

    out, more = np.zeros((slots, 3, len(columns) * width), np.int64), None
    parts = rows.mapInArrow(part, SUMS)
    if tasks > FEW_TASKS:
        parts = parts.repartition("slot").mapInArrow(_added, SUMS)
    for r in parts.collect():  # sums of a bounded number of nodes
        data = np.frombuffer(r.data, np.int64)
        if r.slot < 0:
            more = data.copy() if more is None else more + data
        else:
            out[r.slot] += data.reshape(3, -1)
    return out.reshape(slots, 3, len(columns), width), more


#: Rows of a node as they travel: codes of the chosen columns, and the two statistics.
Few = tuple[np.ndarray, np.ndarray, np.ndarray]


def few_rows(columns: int, width: int) -> int:
    """So many rows of a node take no more bytes than its histogram."""
    return columns * width * 24 // (columns + 16)


#: Rows in the executors' memory: the batch, its codes column by column, which rows count, their two statistics, places and values.
Kept = tuple[Batch, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def batches_of(rows: DataFrame, features: int) -> RDD:
    """The rows as batches of about ``KEPT_ROWS``, their codes column by column, read from the shared folder."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as out:
                    out.write_batch(batch)
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["data"])

    def read(elements: Iterator[bytes]) -> Iterator[Batch]:
        held: list[Batch] = []
        for data in elements:
            held.append(Batch.of(pa.ipc.open_stream(data).read_next_batch(), features))
            if sum(len(b.ids) for b in held) >= KEPT_ROWS:
                yield _one(held)
                held = []
        if held:
            yield _one(held)

    return rows.mapInArrow(write, "data binary").rdd.map(lambda r: bytes(r.data)).mapPartitions(read)


def _one(parts: list[Batch]) -> Batch:
    whole = {f.name: np.concatenate([getattr(b, f.name) for b in parts]) for f in fields(Batch)}
    return Batch(**{**whole, "codes": np.asfortranarray(whole["codes"])})


def kept_statistics(batches: RDD, statistics: Statistics, also: Callable[[Batch], np.ndarray]) -> RDD:
    """Batches with the rows that count and two statistics of each, and ``also`` as the places and values that are not 0: kept in the
    executors' memory (or on their disks), so that the jobs of a round make them once."""

    def of(batch: Batch) -> Kept:
        a, b, counts = statistics(batch)
        more = also(batch)
        at = np.flatnonzero(more)
        return batch, np.flatnonzero(counts), a[counts], b[counts], at, more[at]

    return batches.map(of).persist(StorageLevel.MEMORY_AND_DISK)


@dataclass(frozen=True)
class Deep:
    """Nodes that are to be grown to their end, with their rows' numbers; for how many more splits there is room, and the least gain
    that can be among those; the rule and the rate."""

    nodes: dict[int, int]
    most: int
    least: float
    rule: Rule
    rate: float

    def places(self, tasks: int) -> dict[int, int]:
        """A task for each node, the largest first to the one that has least to do."""
        load, out = [0] * tasks, {}
        for node in sorted(self.nodes, key=lambda k: -self.nodes[k]):
            out[node] = min(range(tasks), key=load.__getitem__)
            load[out[node]] += self.nodes[node]
        return out


@dataclass
class Grown:
    """A node with its value, its best split (gain, column, cut) if it has one, and, where it was grown, its children."""

    value: float
    split: tuple[float, int, int] | None
    children: tuple[Grown, Grown] | None = None


def grown(rows: Few, shape: tuple[int, ...], most: int, least: float, rule: Rule, rate: float) -> Grown:
    """A node grown best-first: the first ``most`` splits and those of equal gain, if they gain ``least``."""
    codes, a, b = rows
    codes = np.asfortranarray(codes)

    def counted(at: np.ndarray) -> np.ndarray:
        sums = np.zeros((1, 3, shape[1] * shape[2]), np.int64)
        if len(at):
            _count(sums, np.zeros(len(at), np.int64), codes, a[at], b[at], shape[2], None, at)
        return sums.reshape(shape)

    def made(at: np.ndarray, sums: np.ndarray) -> Grown:
        node = Grown(_value(sums, rule, rate), rule.best(sums))
        if node.split is not None:
            heapq.heappush(queue, (-node.split[0], len(held)))
            held.append((node, at, sums))
        return node

    queue: list[tuple[float, int]] = []
    held: list[tuple[Grown, np.ndarray, np.ndarray] | None] = []
    every = np.arange(len(codes))
    root = made(every, counted(every))
    last = math.inf
    while queue and -queue[0][0] >= least and (most > 0 or -queue[0][0] >= last):
        gain, k = heapq.heappop(queue)
        (node, at, sums), held[k] = held[k], None
        most, last = most - 1, -gain
        low = codes[:, node.split[1]][at] <= node.split[2]
        left, right = at[low], at[~low]
        part = counted(left if len(left) <= len(right) else right)
        first, second = (part, sums - part) if len(left) <= len(right) else (sums - part, part)
        node.children = made(left, first), made(right, second)
    return root


def kept_histograms(
    kept: RDD, columns: np.ndarray, width: int, tree: Tree, wanted: dict[int, int], slots: int, whole: list[int], judged: int = 0, deep: Deep | None = None
) -> tuple[np.ndarray, dict[int, Few], np.ndarray, dict[int, Grown]]:
    """Sums of the leaves ``wanted`` as :func:`histograms` has them, the rows of the leaves ``whole``, the sum of ``also`` over
    all rows, of length ``judged``, and what grows below the leaves ``deep``."""
    slot_of = np.array([wanted.get(k, -1) for k in range(len(tree.feature))])
    apart = {**dict.fromkeys(whole, "rows"), **dict.fromkeys(deep.nodes if deep else (), "deep")}

    def part(elements: Iterator[Kept]) -> Iterator[tuple[tuple[str, int], tuple[np.ndarray, ...]]]:
        sums, more, found = np.zeros((slots if wanted else 0, 3, len(columns) * width), np.int64), np.zeros(judged, np.int64), {k: [] for k in apart}
        for batch, counts, a, b, at, n in elements:
            leaf = tree.leaves(batch.codes, counts)
            slot = slot_of[leaf]
            some = np.flatnonzero(slot >= 0)
            if len(some):
                _count(sums, slot[some], batch.codes, a[some], b[some], width, columns, counts[some])
            for k in apart:
                own = np.flatnonzero(leaf == k)
                found[k].append((batch.codes[counts[own]][:, columns], a[own], b[own]))
            if judged:
                more[at] += n
        yield from ((("sums", k), (s,)) for k, s in enumerate(sums) if s[2].any())
        yield from (((apart[k], k), _joined(x)) for k, x in found.items() if x)
        if judged:
            places = np.flatnonzero(more)
            yield ("more", 0), (places, more[places])

    def settled(elements: Iterator[tuple[tuple[str, int], tuple[np.ndarray, ...]]]) -> Iterator[tuple[tuple[str, int], tuple]]:
        held: dict[tuple[str, int], list] = {}
        for key, x in elements:
            held.setdefault(key, []).append(x)
        while held:
            (kind, k), x = held.popitem()
            if kind == "deep":
                yield (kind, k), grown(_joined(x), (3, len(columns), width), deep.most, deep.least, deep.rule, deep.rate)
            else:
                yield (kind, k), (sum(y[0] for y in x),) if kind == "sums" else _joined(x)

    parts, tasks = kept.mapPartitions(part), kept.getNumPartitions()
    if deep or tasks > FEW_TASKS:
        places = deep.places(tasks) if deep else {}
        parts = parts.partitionBy(tasks, lambda key: places[key[1]] if key[0] == "deep" else key[1]).mapPartitions(settled)
    out, more, rows, below = np.zeros((slots, 3, len(columns) * width), np.int64), np.zeros(judged, np.int64), {k: [] for k in whole}, {}
    for (kind, k), x in parts.collect():  # sums of a bounded number of nodes, rows that take no more, and splits
        if kind == "rows":
            rows[k].append(x)
        elif kind == "deep":
            below[k] = x
        elif kind == "sums":
            out[k] += x[0].reshape(3, -1)
        else:
            np.add.at(more, x[0], x[1])
    return out.reshape(slots, 3, len(columns), width), {k: _joined(x) for k, x in rows.items()}, more, below


def _joined(parts: list[Few]) -> Few:
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _packed(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["slot", "data"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for slot, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            x = np.frombuffer(data, np.int64)
            held[slot] = held[slot] + x if slot in held else x
    yield _packed(held)


def most_slots(columns: int, width: int) -> int:
    return max(1, JOB_BYTES // max(1, columns * width * 24))


@dataclass(frozen=True)
class Rule:
    """What a split must satisfy and what it is worth: Newton steps with L1 and L2 on the leaf values."""

    least_rows: int
    l1: float = 0.0
    l2: float = 0.0
    least_hessian: float = 1e-3

    def value(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        kept = np.sign(g) * np.maximum(np.abs(g) - self.l1, 0)
        return -kept / np.maximum(h + self.l2, 1e-300)

    def worth(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        kept = np.maximum(np.abs(g) - self.l1, 0)
        return kept * kept / np.maximum(h + self.l2, 1e-300)

    def best(self, sums: np.ndarray) -> tuple[float, int, int] | None:
        """(gain, column, cut) of the best split of a node's histogram; the first of equals."""
        left = np.cumsum(sums, axis=2)
        whole = left[:, :1, -1:]
        left = left[:, :, :-1]
        right = whole - left
        g, h = left[0] / UNIT, left[1] / UNIT
        gr, hr = right[0] / UNIT, right[1] / UNIT
        gain = self.worth(g, h) + self.worth(gr, hr) - self.worth(whole[0, 0, 0] / UNIT, whole[1, 0, 0] / UNIT)
        fits = (left[2] >= self.least_rows) & (right[2] >= self.least_rows) & (np.minimum(h, hr) >= self.least_hessian)
        gain = np.where(fits, gain, -np.inf)
        if not gain.size:
            return None
        k = int(gain.argmax())
        f, c = divmod(k, gain.shape[1])
        return (float(gain[f, c]), f, c) if gain[f, c] > 1e-12 else None


def _value(sums: np.ndarray, rule: Rule, rate: float) -> float:
    g, h = sums[0, 0].sum() / UNIT, sums[1, 0].sum() / UNIT
    return rate * float(rule.value(g, h))


#: A tree, slots of leaves, their number, leaves whose rows are wanted, and leaves to be grown, to sums, rows and what was grown.
Fetch = Callable[[Tree, dict[int, int], int, list[int], Deep | None], tuple[np.ndarray, dict[int, Few], dict[int, Grown]]]


def leaf_wise(root: np.ndarray, fetch: Fetch, columns: np.ndarray, rule: Rule, most_leaves: int, rate: float, slots: int, few: int) -> Tree:
    """A tree grown best-first to ``most_leaves``, from the root's histogram.

    The queue is replayed on the driver: when its best leaf has no children yet, one job makes those of all leaves that wait, so a tree
    takes about as many jobs as it has levels of large nodes, and is the tree that splitting one leaf at a time gives. ``fetch`` also
    takes a list of leaves of ``few`` rows at most and returns their rows beside the sums, and waiting leaves of ``DEEP_ROWS`` at most,
    which it grows so far as the queue can ask for them; what lies below both needs no job. Such leaves wait until one of them is the best.
    """
    tree, queue = Tree(), []
    own: dict[int, Few] = {}
    ready: dict[int, Grown] = {}
    held: dict[int, np.ndarray] = {}
    splits: dict[int, tuple[float, int, int]] = {}

    def wait(node: int) -> None:
        if node in splits:
            heapq.heappush(queue, (-splits[node][0], node))

    def known(node: int, sums: np.ndarray) -> None:
        tree.value[node] = _value(sums, rule, rate)
        if (found := rule.best(sums)) is not None:
            held[node], splits[node] = sums, found

    def given(node: int, found: Grown) -> None:
        tree.value[node] = found.value
        if found.split is not None:
            ready[node], splits[node] = found, found.split

    def expand(nodes: list[int], below: list[int]) -> None:
        wanted, whole, pairs = {}, [], []
        for node in nodes:
            _, f, c = splits[node]
            left, right = tree.split(node, columns[f], c)
            if node in ready:
                for child, found in zip((left, right), ready.pop(node).children, strict=True):
                    given(child, found)
                continue
            n = held[node][2, f]
            of_left, of_right = int(n[: c + 1].sum()), int(n[c + 1 :].sum())
            small, large = (left, right) if of_left <= of_right else (right, left)
            pairs.append((node, small, large))
            if node in own:
                codes, a, b = own.pop(node)
                to = codes[:, f] <= c
                own[left], own[right] = (codes[to], a[to], b[to]), (codes[~to], a[~to], b[~to])
                continue
            whole += [k for k, rows in ((left, of_left), (right, of_right)) if rows <= few]
            if min(of_left, of_right) > few:
                wanted[small] = len(wanted)
        if wanted or whole or below:
            # with so many splits at hand as there is room for, none that gains less is ever made
            room, gains = most_leaves - 1 - len(accepted), sorted((-gain for gain, _ in queue), reverse=True)
            deep = Deep({k: rows_of(k) for k in below}, room, gains[room - 1] if len(gains) >= room else 0.0, rule, rate)
            sums, found, made = fetch(tree, wanted, len(wanted), whole, deep if below else None)
            own.update(found)
            ready.update(made)
        for node, small, large in pairs:
            part = sums[wanted[small]] if small in wanted else _sums(own[small], root.shape)
            known(small, part)
            known(large, held.pop(node) - part)

    def rows_of(node: int) -> int:
        return int(held[node][2, 0].sum())

    known(tree.add(), root)
    wait(0)
    accepted: list[int] = []
    while queue and len(accepted) + 1 < most_leaves:
        best = queue[0][1]
        while tree.feature[best] < 0:
            at_hand = lambda node: node in own or node in ready
            if at_hand(best):
                expand([best], [])
                continue
            waiting = [node for _, node in sorted(queue) if tree.feature[node] < 0 and not at_hand(node)][: min(slots, most_leaves - 1 - len(accepted))]
            deep = [node for node in waiting if rows_of(node) <= DEEP_ROWS]
            expand([node for node in waiting if node not in deep], deep if best in deep else [])
        heapq.heappop(queue)
        accepted.append(best)
        wait(tree.left[best])
        wait(tree.right[best])
    return _pruned(tree, set(accepted))


def _sums(rows: Few, shape: tuple[int, ...]) -> np.ndarray:
    """The histogram of a node's rows."""
    codes, a, b = rows
    sums = np.zeros((1, 3, shape[1] * shape[2]), np.int64)
    if len(codes):
        _count(sums, np.zeros(len(codes), np.int64), np.asfortranarray(codes), a, b, shape[2])
    return sums.reshape(shape)


def _pruned(tree: Tree, kept: set[int]) -> Tree:
    """The tree with the splits of ``kept`` only, its nodes numbered by depth from left to right."""
    out = Tree()
    todo = [(0, out.add(tree.value[0]))]
    for old, new in todo:
        if old in kept:
            a, b = tree.left[old], tree.right[old]
            todo += zip((a, b), out.split(new, tree.feature[old], tree.cut[old], (tree.value[a], tree.value[b])), strict=True)
    return out
