"""Embedding whitening from a compensated covariance.

Vectors become whole numbers, whose sums are exact. Each task centres its rows and adds their outer products up in double-double:
a number is the unevaluated sum of a high and a low double, and products and sums go through error-free transformations. Tasks
hand on both parts, which are merged in two levels by slices of the matrix; the driver gets one matrix, whose size hangs on the
dimensions alone. Its eigenvectors come from the symmetric tridiagonal divide-and-conquer solver of the linear algebra library
(Householder reduction, then Cuppen's method), and one step of iterative refinement with the matrix in extended precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowtide.llm.tiles import matrix

#: Entries times SCALE, rounded down, plus SHIFT are the whole numbers; entries beyond MOST are held to it.
SCALE, SHIFT, MOST = 1024, 100_000, 1 << 40
#: Numbers of a slice that travels, and of an array that is summed at once; lanes of the first merge.
SLICE, CHUNK, LANES = 4096, 1 << 19, 32
#: Components whose eigenvalue is not above this share of the greatest have no variance and are left out.
LEAST_SHARE = 1e-13
SPLIT = 134_217_729.0  # 2**27 + 1


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b and what rounding lost of it."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def two_product(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a * b and what rounding lost of it."""
    p = a * b
    x, y = SPLIT * a, SPLIT * b
    ah, bh = x - (x - a), y - (y - b)
    al, bl = a - ah, b - bh
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def add(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Sum of two double-doubles (high, low)."""
    s, e = two_sum(a[0], b[0])
    t, f = two_sum(a[1], b[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def total(x: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Sum of double-doubles along the first axis, by halves."""
    hi, lo = x
    while len(hi) > 1:
        half = len(hi) // 2
        s = add((hi[:half], lo[:half]), (hi[half : 2 * half], lo[half : 2 * half]))
        hi, lo = (np.concatenate((part, rest[2 * half :])) for part, rest in zip(s, (hi, lo), strict=True))
    return hi[0], lo[0]


def outer(x: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Products of all pairs of columns (the upper triangle) of double-double rows."""
    i, j = np.triu_indices(x[0].shape[1])
    a, b = (x[0][:, i], x[1][:, i]), (x[0][:, j], x[1][:, j])
    p, e = two_product(a[0], b[0])
    return two_sum(p, e + (a[0] * b[1] + a[1] * b[0]))


class Centre(NamedTuple):
    """Means as double-doubles; rows are centred on them."""

    high: np.ndarray
    low: np.ndarray

    @classmethod
    def of(cls, sums: list[int], n: int) -> Centre:
        exact = [Fraction(s, n) for s in sums]
        high = np.array([float(x) for x in exact])
        return cls(high, np.array([float(x - Fraction(h)) for x, h in zip(exact, high.tolist(), strict=True)]))

    def rows(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s, e = two_sum(x, np.broadcast_to(-self.high, x.shape))
        return two_sum(s, e - self.low)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, tuple] = {}
    for batch in batches:
        for k, hi, lo in zip(batch.column("slice").to_pylist(), batch.column("high").to_pylist(), batch.column("low").to_pylist(), strict=True):
            x = np.frombuffer(hi), np.frombuffer(lo)
            held[k] = add(held[k], x) if k in held else x
    yield _slices(held, 0)


def _slices(held: dict[int, tuple], lane: int) -> pa.RecordBatch:
    keys = sorted(held)
    columns = [pa.array(keys, pa.int32()), pa.array([lane] * len(keys), pa.int32()), *(pa.array([held[k][i].tobytes() for k in keys], pa.binary()) for i in (0, 1))]
    return pa.RecordBatch.from_arrays(columns, ["slice", "lane", "high", "low"])


def compensated_sum(rows: DataFrame, terms: Callable[[np.ndarray], tuple], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Double-double sum of ``terms`` (rows of ``x`` to rows of ``size`` double-doubles) over all rows; zeros for none."""
    step = max(1, CHUNK // max(1, size))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = None
        for batch in batches:
            x = matrix(batch.column("x"))
            for s in range(0, len(x), step):
                one = total(terms(x[s : s + step]))
                held = one if held is None else add(held, one)
        if held is not None:
            cuts = range(0, size, SLICE)
            yield _slices({k: (held[0][c : c + SLICE], held[1][c : c + SLICE]) for k, c in enumerate(cuts)}, TaskContext.get().partitionId() % LANES)

    schema = "slice int, lane int, high binary, low binary"
    parts = rows.select("x").mapInArrow(part, schema).repartition("slice", "lane").mapInArrow(_fold, schema)
    high, low = np.zeros(size), np.zeros(size)
    for r in parts.repartition("slice").mapInArrow(_fold, schema).collect():  # the sum itself, in slices
        at = slice(r.slice * SLICE, r.slice * SLICE + SLICE)
        high[at], low[at] = np.frombuffer(r.high), np.frombuffer(r.low)
    return high, low


def _square(upper: np.ndarray, d: int) -> np.ndarray:
    out = np.zeros((d, d), upper.dtype)
    i, j = np.triu_indices(d)
    out[i, j] = out[j, i] = upper
    return out


def covariance(rows: DataFrame, centre: Centre, n: int, project: Callable[[np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """Covariance (divisor ``n``) of ``x``, or of its projection, in extended precision; rows are centred before they are multiplied."""
    d = len(centre.high)
    high, low = compensated_sum(rows, lambda x: outer(centre.rows(project(x) if project else x)), d * (d + 1) // 2)
    return _square((high.astype(np.longdouble) + low) / n, d)


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, signs set by the entry of greatest size.

    A step of refinement in extended precision (residuals of orthogonality and of the eigenvalue equation) follows the solver, except
    between eigenvalues that are too close for it to tell apart.
    """
    _, x = np.linalg.eigh(v.astype(np.float64))
    x = x[:, ::-1].astype(np.longdouble)
    r = np.eye(len(v), dtype=np.longdouble) - x.T @ x
    s = x.T @ v @ x
    r, s = (r + r.T) / 2, (s + s.T) / 2  # rounding would be divided by small gaps
    values = np.diag(s) / (1 - np.diag(r))
    gap = values[None, :] - values[:, None]
    near = np.abs(gap) <= 1e-10 * max(np.abs(values).max(initial=0), np.longdouble(1e-300))
    step = np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, 1, gap))
    x = x + x @ step
    x = x / np.sqrt((x * x).sum(0))
    order = np.argsort(-values, kind="stable")
    values, x = values[order], x[:, order]
    x = x * np.sign(x[np.abs(x).argmax(0), np.arange(len(v))])
    return values.astype(np.float64), x.astype(np.float64)


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """``row`` (all columns) and ``x``: the vector as whole numbers, of the rows that take part (see :func:`whiten`)."""
    v = F.col("row.embedding")
    good = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(v, lambda c: (F.floor(F.greatest(F.least(c.cast("double") * SCALE, F.lit(float(MOST))), F.lit(-float(MOST)))) + SHIFT).cast("long"))
    rows = vectors.select(F.struct("*").alias("row")).where(good).select("row", whole.alias("x"))
    usual = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()  # one row for each length
    return rows.where(F.size("x") == (usual.d if usual else 0))


def _sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and exact sums of ``x``."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = None, 0
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("x"), np.int64)
                one = x.sum(0).tolist()  # a batch of 2**22 rows at most: no overflow
                held, n = one if held is None else [a + b for a, b in zip(held, one, strict=True)], n + len(x)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(held))], pa.int32()), pa.array([n, *held], pa.decimal128(28, 0))], ["at", "s"])

    found = {r.at: int(r.s) for r in rows.select("x").mapInArrow(part, "at int, s decimal(28,0)").groupBy("at").agg(F.sum("s").alias("s")).collect()}  # one row for each dimension
    n = found.pop(-1, 0)
    return n, [found[k] for k in sorted(found)]


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum of (n * x - S)**2 for each row, exactly; None beyond a long."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if most * most * max(1, x.shape[1]) < 1 << 63:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(1).tolist()
    far = np.abs(n * x.astype(float) - np.array(sums, float)).max(initial=0)
    if most < 1 << 62 and far * far * max(1, x.shape[1]) < 2.0**62:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(1).tolist()
    exact = [sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [e if e < 1 << 63 else None for e in exact]


OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = 8) -> DataFrame:
    """A row for each vector and component: ``vec_id``, component (from 1, by falling eigenvalue), n, deviation, whitened, explained,
    identity_error.

    The fit covers all vectors that take part. Null vectors and vectors with null or non-finite entries take no part, nor do vectors
    of another length than the commonest (the longest of those). Rows without an id take part, repeated rows each. Entries beyond
    2**40 / 1024 are held to that; a deviation beyond a long is null. Components without variance (equal vectors, fewer dimensions)
    are left out, so a table of equal vectors, and an empty one, gives no rows. Whitened values have the covariance I over the fit:
    ``identity_error`` is the largest entry of the difference.
    """
    rows = whole_numbers(vectors)
    spark = vectors.sparkSession
    n, sums = _sums(rows)
    kind = dict(vectors.dtypes)["vec_id"]
    if not n or not sums:
        return spark.createDataFrame([], f"vec_id {kind}, {OUT}")
    centre = Centre.of(sums, n)
    v = covariance(rows, centre, n)
    values, axes = eigen(v)
    k = min(components, int((values > LEAST_SHARE * max(values[0], 0)).sum())) if values[0] > 0 else 0
    if not k:
        return spark.createDataFrame([], f"vec_id {kind}, {OUT}")
    share = (values[:k] / float(np.trace(v))).tolist()
    weights = axes[:, :k] / np.sqrt(values[:k])

    def project(x: np.ndarray) -> np.ndarray:
        c = centre.rows(x)
        return c[0] @ weights + c[1] @ weights

    high, low = compensated_sum(rows, lambda x: (w := project(x), np.zeros_like(w)), k)
    means = Centre((high + low) / n, np.zeros(k))
    error = float(np.abs(covariance(rows, means, n, project) - np.eye(k)).max())

    def rows_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("x"), np.int64)
            m, away = len(x), deviations(x, n, sums)
            columns = [
                batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array([n] * (m * k), pa.int64()),
                pa.array([a for a in away for _ in range(k)], pa.int64()), pa.array(project(x.astype(float)).ravel()), pa.array(share * m), pa.array([error] * (m * k)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select(F.col("row.vec_id").alias("vec_id"), "x").mapInArrow(rows_out, f"vec_id {kind}, {OUT}")
