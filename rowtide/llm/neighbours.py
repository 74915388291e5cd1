"""Approximate nearest neighbours by block matrix join: int8 products with error bounds, survivors recomputed in double.

In a tile, every vector is quantised to int8 with a scale of its own. The products of the int8 matrices are whole numbers (taken
in float32, or float64 for long vectors, where they stay exact) and give each squared distance up to a bound from the
quantisation residuals' norms. Pairs whose lower bound exceeds the query's k-th smallest upper bound cannot be among
its k nearest; the rest are recomputed on the original vectors and merged by heaps. So nothing is lost: recall is 1. Where a
bound is not finite (very large components), the pair is recomputed too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowtide.llm.tiles import FOUND, blocks, dealt, each, found, matrix, merged, taking_part

ROW_BLOCK, QUERY_BLOCK = 4096, 16_384
#: Queries multiplied at once within a tile, and pairs recomputed at once.
QUERIES, PAIRS = 512, 1 << 16


def _quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scales, squared norms, norms, norms of what is lost; a row is divided by a power of two first."""
    power = np.frexp(np.abs(x).max(1, initial=0))[1]
    y = np.ldexp(x, -power[:, None])  # within -1..1
    q = np.rint(127 * y).astype(np.int8)
    norm, lost = np.linalg.norm(y, axis=1), np.linalg.norm(y - q / 127, axis=1)
    with np.errstate(over="ignore"):
        return q, np.ldexp(1 / 127, power), np.ldexp(norm * norm, 2 * power), np.ldexp(norm, power), np.ldexp(lost, power)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows, added up component by component in double; scaled where squares leave its range."""
    total = np.zeros(len(a))
    with np.errstate(over="ignore", invalid="ignore"):
        for j in range(a.shape[1]):
            d = a[:, j] - b[:, j]
            total += d * d
        out = np.sqrt(total)
        for i in np.flatnonzero(~(total < 1e290) | (total < 1e-270)):
            d = a[i] / 4 - b[i] / 4
            m = np.abs(d).max(initial=0)
            out[i] = 4 * (m * np.sqrt(((d / m) ** 2).sum())) if m > 0 else 0.0
    return out


def _few_of_equals(x: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Rows without those that have ``most`` equal vectors with smaller ids before them."""
    if not x.shape[1]:
        return np.arange(len(x))
    raw = np.ascontiguousarray(x + 0.0).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel()
    _, kind = np.unique(raw, return_inverse=True)
    order = np.lexsort((ids, kind))
    place = np.arange(len(x)) - np.searchsorted(kind[order], kind[order])
    return np.sort(order[place < most])


def nearest(k: int):
    def search(data: pa.Table, asked: pa.Table) -> pa.Table:
        if not data.num_rows or not asked.num_rows:
            return found("double", [])
        x, ids, rows = matrix(data.column("embedding")), data.column("vec_id").to_numpy(), data.column("row").to_numpy()
        some = _few_of_equals(x, ids, k + 1)  # the k + 1 first of equal vectors: one may be the query's own
        x, ids, rows = x[some], ids[some], rows[some]
        every, queries, own_rows = matrix(asked.column("embedding")), asked.column("vec_id").to_numpy(), asked.column("row").to_numpy()
        exact = np.float32 if x.shape[1] * 127 * 127 < 1 << 24 else np.float64
        qx, sx, xx, nx, ex = _quantised(x)
        across = qx.astype(exact).T
        parts = []
        for s in range(0, len(every), QUERIES):
            y, own = every[s : s + QUERIES], own_rows[s : s + QUERIES, None] == rows[None, :]
            qy, sy, yy, ny, ey = _quantised(y)
            with np.errstate(over="ignore", invalid="ignore"):
                about = (qy.astype(exact) @ across).astype(np.float64) * np.outer(-2 * sy, sx)
                both = yy[:, None] + xx[None, :]
                about += both
                bound = 2 * (np.outer(ny + ey, ex) + np.outer(ey, nx)) + 1e-13 * (x.shape[1] + 8) * both  # the last: rounding
                low, high = about - bound, about + bound
            high[own | ~np.isfinite(high)] = np.inf
            kth = np.partition(high, k - 1, axis=1)[:, k - 1] if len(ids) > k else np.full(len(y), np.inf)
            i, j = np.nonzero(~(low > kth[:, None]) & ~own)
            score = np.concatenate([distances(x[j[a : a + PAIRS]], y[i[a : a + PAIRS]]) for a in range(0, len(i), PAIRS)]) if len(i) else np.zeros(0)
            order = np.lexsort((ids[j], score, i))
            i, j, score = i[order], j[order], score[order]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < k
            i, j = i[keep], j[keep]
            parts.append((own_rows[s + i], queries[s + i], ids[j], score[keep]))
        return found("double", parts)

    return search


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest other rows of each query row, ties to the smaller id.

    Null ids, null vectors, vectors of zeros and vectors with null or non-finite components take no part. Rows that share an id
    are rows of their own, as queries and as candidates of each other; vectors meet those of their length only. Fewer candidates
    than ``k`` are all returned; an empty table gives no row. Distances beyond the range of doubles are infinite.
    """
    rows = taking_part(vectors, is_query, F.exists("embedding", lambda x: x != 0))
    n = blocks(rows, ROW_BLOCK, QUERY_BLOCK, 1024)
    of = F.size("embedding").alias("length")
    data = rows.select(of, dealt("row", n.rows, 1).alias("r"), each(n.queries).alias("q"), "row", "vec_id", "embedding")
    asked = rows.where("asks").select(of, each(n.rows).alias("r"), dealt("row", n.queries, 7).alias("q"), "row", "vec_id", "embedding")
    keys = ("length", "r", "q")
    pairs = data.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(nearest(k), FOUND.format(kind="double"))
    return merged(pairs, k, "double", smallest=True)
