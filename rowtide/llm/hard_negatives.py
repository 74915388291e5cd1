"""Hard negatives by branch-and-bound over ball trees.

Every block of rows has a forest: a ball tree for each label. A node holds its rows' centre c and radius r, so the inner product of
an anchor q with each of its rows lies within q.c - |q| r and q.c + |q| r. Anchors of a block descend together; one leaves a node
that lies outside its score window altogether, or strictly beneath the least score that it has kept so far. Leaves are multiplied
out on whole numbers. The forests are built once, written (vectors as the smallest whole numbers that hold them), and meet every
block of anchors twice: for positives in the trees of the anchor's label, then for negatives in the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowtide.llm.tiles import blocks, dealt, each, matrix
from rowtide.sources.shared import cut

#: Rows and anchors of a block, rows of a leaf at most, anchors that descend together.
ROW_BLOCK, ANCHOR_BLOCK, LEAF, ANCHORS = 32_768, 4096, 64, 512
QUANTUM = 256
NODE = np.dtype([("label", "i8"), ("start", "i8"), ("end", "i8"), ("left", "i8"), ("right", "i8"), ("radius", "f8")])
FOREST = "length int, r long, kind string, vectors binary, rows binary, ids binary, nodes binary, centres binary"
FOUND = "anchor_row long, slot int, vec_id long, score long"


class Forest:
    """Ball trees over the rows of a block, one for each label; rows lie so that a node's are consecutive."""

    def __init__(self, vectors: np.ndarray, rows: np.ndarray, ids: np.ndarray, nodes: np.ndarray, centres: np.ndarray):
        self.vectors, self.rows, self.ids, self.nodes, self.centres = vectors, rows, ids, nodes, centres
        inner = np.concatenate((nodes["left"], nodes["right"]))
        self.roots = np.setdiff1d(np.arange(len(nodes)), inner[inner >= 0])

    @classmethod
    def of(cls, x: np.ndarray, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> Forest:
        order = np.lexsort((ids, labels))
        x, rows, ids, labels = x[order], rows[order], ids[order], labels[order]
        at = np.arange(len(x))
        nodes, centres = [], []
        todo = [(int(s), int(e), -1, 0) for s, e in zip(*_spans(labels), strict=True)]
        while todo:
            start, end, parent, side = todo.pop()
            own = at[start:end]
            centre = x[own].mean(0)
            far = np.sqrt(((x[own] - centre) ** 2).sum(1))
            me = len(nodes)
            nodes.append([labels[start], start, end, -1, -1, far.max() * (1 + 1e-12)])
            centres.append(centre)
            if parent >= 0:
                nodes[parent][3 + side] = me
            if end - start > LEAF and far.max() > 0:
                a = x[own[far.argmax()]]
                b = x[own[((x[own] - a) ** 2).sum(1).argmax()]]
                own = own[np.argsort(x[own] @ (b - a), kind="stable")]
                at[start:end] = own
                half = (start + end) // 2
                todo += [(half, end, me, 1), (start, half, me, 0)]
        return cls(x[at], rows[at], ids[at], np.array([tuple(n) for n in nodes], NODE), np.array(centres).reshape(len(nodes), -1))

    def descend(self, anchors: np.ndarray, roots: list[tuple[int, np.ndarray]], seek) -> None:
        """Walk from ``roots`` (node, anchors that start there) with all anchors at once; ``seek`` bounds and collects."""
        norms = np.sqrt((anchors**2).sum(1))
        todo = list(roots)
        while todo:
            node, who = todo.pop()
            nd, centre = self.nodes[node], self.centres[node]
            middle, reach = anchors[who] @ centre, norms[who] * nd["radius"]
            # room for rounding, so that a bound is never too tight
            reach += 1e-12 * (len(centre) + 8) * norms[who] * (np.sqrt((centre**2).sum()) + nd["radius"])
            who = who[seek.alive(who, middle - reach, middle + reach)]
            if not len(who):
                continue
            if nd["left"] < 0:
                s = slice(nd["start"], nd["end"])
                for t in range(s.start, s.stop, 4096):  # a node of equal vectors may be large
                    p = slice(t, min(s.stop, t + 4096))
                    seek.offer(who, anchors[who] @ self.vectors[p].T, self.rows[p], self.ids[p])
            else:
                near = sorted((nd["left"], nd["right"]), key=lambda c: float((anchors[who] @ self.centres[c]).mean()))
                todo += [(c, who) for c in near]  # the likelier one is popped first


def _spans(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(keys)) + 1
    return np.concatenate(([0], edges))[: len(keys) and None], np.concatenate((edges, [len(keys)]))


class Best:
    """The ``k`` best rows of every anchor and slot so far, within the slot's window of scores; ties to smaller ids."""

    def __init__(self, k: int, own: np.ndarray, low: np.ndarray, high: np.ndarray, ratio: tuple[int, int]):
        """``own``: the anchors' rows; ``low``, ``high``: anchors by slots; scores s with low * ratio[0] <= s * 100 <= high * ratio[1]."""
        self.k, self.own, self.low, self.high = k, own, low * ratio[0], high * ratio[1]
        self.scores = np.full((*low.shape, k), -np.inf)
        self.ids = np.full((*low.shape, k), np.iinfo(np.int64).max)

    def alive(self, who: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        least = self.scores[who, :, -1]
        return ((high[:, None] >= least) & (100 * high[:, None] >= self.low[who] - 1) & (100 * low[:, None] <= self.high[who] + 1)).any(1)

    def offer(self, who: np.ndarray, scores: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> None:
        scores = np.where(self.own[who][:, None] == rows[None, :], -np.inf, scores)
        for j in range(self.low.shape[1]):
            fits = (100 * scores >= self.low[who, j, None]) & (100 * scores <= self.high[who, j, None]) & (scores >= self.scores[who, j, -1:])
            some = np.flatnonzero(fits.any(1))
            if not len(some):
                continue
            w = who[some]
            s = np.concatenate((self.scores[w, j], np.where(fits[some], scores[some], -np.inf)), 1)
            i = np.concatenate((self.ids[w, j], np.broadcast_to(ids, (len(some), len(ids)))), 1)
            order = np.lexsort((i, -s), axis=-1)[:, : self.k]
            self.scores[w, j], self.ids[w, j] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)

    def table(self) -> pa.Table:
        a, j, p = np.nonzero(np.isfinite(self.scores))
        return pa.table({"anchor_row": self.own[a], "slot": pa.array(j, pa.int32()), "vec_id": self.ids[a, j, p], "score": self.scores[a, j, p].astype(np.int64)})


def _smallest(x: np.ndarray) -> str:
    return next(k for k in ("int8", "int16", "int32", "int64") if np.abs(x).max(initial=0) <= np.iinfo(k).max)


def _plant(data: pa.Table) -> pa.Table:
    x = matrix(data.column("x"))
    f = Forest.of(x, *(data.column(c).to_numpy() for c in ("row", "vec_id", "label")))
    kind = _smallest(x)
    parts = (f.vectors.astype(kind), f.rows, f.ids, f.nodes, f.centres)
    columns = {"length": pa.array([x.shape[1]], pa.int32()), "r": data.column("r").slice(0, 1), "kind": [kind], **{n: [v.tobytes()] for n, v in zip(("vectors", "rows", "ids", "nodes", "centres"), parts, strict=True)}}
    return pa.table(columns)


def _grown(row: dict) -> Forest:
    d = row["length"]
    nodes = np.frombuffer(row["nodes"], NODE)
    vectors = np.frombuffer(row["vectors"], row["kind"]).astype(np.float64)
    rows, ids = (np.frombuffer(row[c], np.int64) for c in ("rows", "ids"))
    return Forest(vectors.reshape(len(rows), d), rows, ids, nodes, np.frombuffer(row["centres"]).reshape(len(nodes), d))


def _seek(k: int, same_label: bool, ratio: tuple[int, int]):
    """Searches of a block of anchors in a block's forest."""

    def search(forests: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if forests.num_rows and asked.num_rows:
            forest = _grown(forests.slice(0, 1).to_pylist()[0])
            every, own, labels = matrix(asked.column("x")), asked.column("row").to_numpy(), asked.column("label").to_numpy()
            low, high = matrix(asked.column("low")), matrix(asked.column("high"))
            if every.shape[1] * np.abs(every).max(initial=0) * np.abs(forest.vectors).max(initial=0) >= 2.0**46:
                raise ValueError("inner products are beyond what doubles add up exactly")
            for s in range(0, len(every), ANCHORS):
                part = slice(s, s + ANCHORS)
                seek = Best(k, own[part], low[part], high[part], ratio)
                kinds = forest.nodes["label"][forest.roots]
                starts = [(int(root), np.flatnonzero((labels[part] == kind) == same_label)) for root, kind in zip(forest.roots, kinds, strict=True)]
                forest.descend(every[part], [x for x in starts if len(x[1])], seek)
                out.append(seek.table())
        return pa.concat_tables(out) if out else Best(k, np.zeros(0, np.int64), np.zeros((0, 1)), np.zeros((0, 1)), ratio).table()

    return search


def _best(found: DataFrame, k: int, names: tuple[str, str, str]) -> DataFrame:
    """(anchor_row, slot, rank, id, score) of the ``k`` best of each anchor and slot over all blocks."""
    order = Window.partitionBy("anchor_row", "slot").orderBy(F.desc("score"), "vec_id")
    placed = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return placed.select("anchor_row", "slot", F.col("rank").alias(names[0]), F.col("vec_id").alias(names[1]), F.col("score").alias(names[2]))


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 5, window: tuple[int, int] = (80, 100)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components x become floor(256 * x); a score is the inner product with the anchor. Positives are the anchor's ``positives`` best
    other rows of its label; for each, the ``negatives`` best rows of other labels with window[0] * positive_score <= 100 *
    negative_score <= window[1] * positive_score; ties go to smaller ids. A positive without negatives gives no row, nor does a
    negative positive_score (its window is empty).

    Null ids, labels and vectors and vectors with null or non-finite components take no part; vectors meet those of their length
    only. Rows that share an id are rows of their own. An empty table gives no rows. Scores must stay below 2**46 / 100.
    """
    v = F.col("embedding")
    good = F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(v, lambda c: F.floor(c.cast("double") * QUANTUM).cast("double"))
    taken = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), v.alias("embedding"), F.coalesce(is_anchor, F.lit(False)).alias("asks"), good.alias("good"))
    rows = cut(taken.where("good and label is not null").select("vec_id", "label", "asks", whole.alias("embedding")).withColumn("row", F.monotonically_increasing_id()))
    n = blocks(rows, ROW_BLOCK, ANCHOR_BLOCK, 1024)
    length = F.size("embedding").alias("length")
    planted = rows.select(length, dealt("row", n.rows, 1).alias("r"), "row", "vec_id", "label", F.col("embedding").alias("x"))
    forests = cut(planted.groupBy("length", "r").applyInArrow(_plant, FOREST)).withColumn("q", each(n.queries))
    anchors = rows.where("asks").select(length, dealt("row", n.queries, 7).alias("q"), "row", "label", F.col("embedding").alias("x"))
    keys = ("length", "r", "q")

    def meet(asked: DataFrame, k: int, same: bool, ratio: tuple[int, int]) -> DataFrame:
        asked = asked.withColumn("r", each(n.rows))
        return forests.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_seek(k, same, ratio), FOUND)

    whole_line = anchors.withColumn("low", F.array(F.lit(float("-inf")))).withColumn("high", F.array(F.lit(float("inf"))))
    found = cut(_best(meet(whole_line, positives, True, (1, 1)), positives, ("place", "positive_id", "positive_score")))
    # an anchor's positives as slots, in order; empty slots have an empty window
    slots = found.groupBy("anchor_row").agg(F.array_sort(F.collect_list(F.struct("place", F.col("positive_score").cast("double").alias("s")))).alias("p"))
    at = [F.get(F.col("p.s"), F.lit(i)) for i in range(positives)]
    low, high = (F.array(*(F.coalesce(x, F.lit(empty)) for x in at)) for empty in (float("inf"), float("-inf")))
    asked = anchors.join(slots, anchors.row == slots.anchor_row).select(*anchors.columns, low.alias("low"), high.alias("high"))
    mined = _best(meet(asked, negatives, False, window), negatives, ("rank", "negative_id", "negative_score"))
    ids = rows.where("asks").select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id"))
    paired = mined.join(found.select("anchor_row", (F.col("place") - 1).alias("slot"), "positive_id", "positive_score"), ["anchor_row", "slot"]).join(ids, "anchor_row")
    return paired.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
