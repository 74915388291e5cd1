"""Exact top-k inner products over a bit-sliced index.

A block of rows is held as bitmaps: for each attribute, one for each binary digit of its quantised value (less the block's
minimum). A query's score is the sum over attributes and set digits t of |q| of slices shifted by t, complemented where q is
negative, plus a constant. Slices of one weight are added with carry-save full adders on whole bitmaps; then rows are selected
from the most significant slice of the sums downward. Rows that tie at the boundary are told apart exactly, by id; the scores of
the selected rows are read from the slices of the sums. The index of a row block is built once, written, and then meets every
query block: it takes about a bit for each binary digit, so no vectors are shipped to queries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowtide.llm.tiles import FOUND, blocks, dealt, each, found, matrix, merged, taking_part
from rowtide.sources.shared import cut

ROW_BLOCK, QUERY_BLOCK = 32_768, 4096
#: Components times this, rounded down, are the attributes.
QUANTUM = 256
INDEX = "length int, r long, rows binary, ids binary, low binary, digits binary, slices binary"


class BitSlicedIndex:
    def __init__(self, rows: int, low: np.ndarray, digits: np.ndarray, slices: np.ndarray):
        """``slices``: bitmaps of 64-bit words, attribute by attribute, the least significant digit first."""
        self.rows, self.low, self.slices = rows, low, slices
        self.digits = digits.astype(int).tolist()
        self.first = np.concatenate(([0], np.cumsum(digits))).astype(int)
        valid = np.zeros(slices.shape[1] * 8, np.uint8)
        ones = np.packbits(np.ones(rows, np.uint8), bitorder="little")
        valid[: len(ones)] = ones
        self.valid = valid.view("<u8")
        self.all = np.concatenate((slices, ~slices))

    @classmethod
    def of(cls, values: np.ndarray) -> BitSlicedIndex:
        """Index of int64 ``values``, rows by attributes."""
        n, attributes = values.shape
        low = values.min(0)
        shifted = values - low
        digits = np.array([int(x).bit_length() for x in shifted.max(0)], np.int64)
        slices = np.zeros((int(digits.sum()), -(-n // 64) * 8), np.uint8)
        at = 0
        for j in range(attributes):
            for b in range(digits[j]):
                bits = np.packbits(shifted[:, j] >> b & 1, bitorder="little")
                slices[at, : len(bits)] = bits
                at += 1
        return cls(n, low, digits, slices.view("<u8"))

    def sums(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices, least significant first, of the score less a constant that is the same for all rows."""
        at: dict[int, list[int]] = {}
        for j in np.flatnonzero(query):
            q = int(query[j])
            flip = len(self.slices) if q < 0 else 0
            for t in range(abs(q).bit_length()):
                if abs(q) >> t & 1:
                    for b in range(self.digits[j]):
                        at.setdefault(t + b, []).append(flip + self.first[j] + b)
        out, carried, w = [], [], 0
        last = max(at, default=-1)
        while w <= last or carried:
            stack = [self.all[at[w]]] if w in at else []
            level = np.concatenate([*stack, *carried]) if stack or carried else np.zeros((0, len(self.valid)), "<u8")
            carried = []
            while len(level) > 1:
                m = len(level) // 3
                if m:
                    x, y, z = level[:m], level[m : 2 * m], level[2 * m : 3 * m]
                    odd = x ^ y
                    carried.append(x & y | odd & z)
                    level = np.concatenate((odd ^ z, level[3 * m :]))
                else:
                    carried.append((level[0] & level[1])[None])
                    level = (level[0] ^ level[1])[None]
            out.append(level[0] if len(level) else np.zeros(len(self.valid), "<u8"))
            w += 1
        return out

    def top(self, query: np.ndarray, k: int, left_out: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and scores of the rows with the ``k`` largest scores (all, if fewer); ties to the smaller row number."""
        maybe = self.valid.copy()
        if left_out is not None:
            maybe[left_out >> 6] &= ~np.uint64(1 << (left_out & 63))
        sure = np.zeros_like(maybe)
        sums = self.sums(query)
        for s in reversed(sums):
            both = sure | (maybe & s)
            n = int(np.bitwise_count(both).sum())
            if n > k:
                maybe &= s
            else:
                sure = both
                maybe &= ~s
                if n == k:
                    break
        chosen = self._numbers(sure)
        if len(chosen) < k:
            chosen = np.concatenate((chosen, self._numbers(maybe)[: k - len(chosen)]))
        return chosen, self._scores(sums, query, chosen)

    def _scores(self, sums: list[np.ndarray], query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The sums' digits and the constant, modulo 2**64: scores fit a long."""
        total = np.zeros(len(rows), np.uint64)
        for w, s in enumerate(sums[:64]):
            total += (s[rows >> 6] >> (rows & 63).astype(np.uint64) & np.uint64(1)) << np.uint64(w)
        constant = sum(int(q) * int(low) + (int(q) * ((1 << d) - 1) if q < 0 else 0) for q, low, d in zip(query, self.low, self.digits, strict=True))
        return (total + np.uint64(constant % (1 << 64))).view(np.int64)

    @staticmethod
    def _numbers(bitmap: np.ndarray) -> np.ndarray:
        words = np.flatnonzero(bitmap)
        bits = np.unpackbits(bitmap[words].view(np.uint8).reshape(len(words), 8), axis=1, bitorder="little")
        i, b = np.nonzero(bits)
        return words[i] * 64 + b


def build(data: pa.Table) -> pa.Table:
    """The index of a row block in one row; rows in the order of their ids, so that ties go to smaller ones."""
    data = data.sort_by([("vec_id", "ascending"), ("row", "ascending")])
    index = BitSlicedIndex.of(matrix(data.column("values"), np.int64))
    raw = {"rows": data.column("row").to_numpy(), "ids": data.column("vec_id").to_numpy(), "low": index.low, "digits": index.digits, "slices": index.slices}
    return pa.table({"length": data.column("length")[:1], "r": data.column("r")[:1], **{n: pa.array([np.asarray(x, "<u8" if n == "slices" else "<i8").tobytes()], pa.binary()) for n, x in raw.items()}})


def highest(k: int):
    def search(block: pa.Table, asked: pa.Table) -> pa.Table:
        parts = []
        if block.num_rows and asked.num_rows:
            rows, ids, low, digits, slices = (np.frombuffer(block.column(n)[0].as_py(), "<u8" if n == "slices" else "<i8") for n in ("rows", "ids", "low", "digits", "slices"))
            index = BitSlicedIndex(len(rows), low, digits, slices.reshape(int(digits.sum()), -(-len(rows) // 64)))
            by = np.argsort(rows)
            asking, queries = asked.column("row").to_numpy(), asked.column("vec_id").to_numpy()
            own = by[np.minimum(np.searchsorted(rows[by], asking), len(rows) - 1)]
            for q, question in enumerate(matrix(asked.column("values"), np.int64)):
                chosen, score = index.top(question, k, int(own[q]) if rows[own[q]] == asking[q] else None)
                parts.append((np.full(len(chosen), asking[q]), np.full(len(chosen), queries[q]), ids[chosen], score))
        return found("long", parts)

    return search


def top_products(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` other rows with the highest integer inner products, ties to the smaller id.

    Attributes are floor(256 * component). Null ids, null vectors, vectors with null or non-finite components and those whose
    products with their like might not fit a long (components of ten million, about) take no part. Rows that share an id are rows
    of their own, as queries and as candidates of each other; vectors meet those of their length only, vectors without
    components score 0. An empty table gives no row.
    """
    largest = F.aggregate("embedding", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x.cast("double"))))
    fits = F.size("embedding") * F.pow(QUANTUM * largest + 1, 2) < F.lit(float(1 << 63))
    rows = taking_part(vectors, is_query, fits)
    n = blocks(rows, ROW_BLOCK, QUERY_BLOCK, ROW_BLOCK)
    values = F.transform("embedding", lambda x: F.floor(QUANTUM * x.cast("double"))).alias("values")
    of = F.size("embedding").alias("length")
    keys = ("length", "r")
    index = cut(rows.select(of, dealt("row", n.rows, 1).alias("r"), "row", "vec_id", values).groupBy(*keys).applyInArrow(build, INDEX))
    asked = rows.where("asks").select(of, each(n.rows).alias("r"), dealt("row", n.queries, 7).alias("q"), "row", "vec_id", values)
    data = index.withColumn("q", each(n.queries))
    pairs = data.groupBy(*keys, "q").cogroup(asked.groupBy(*keys, "q")).applyInArrow(highest(k), FOUND.format(kind="long"))
    return merged(pairs, k, "long", smallest=False)
