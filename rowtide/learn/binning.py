"""A matrix of one-byte codes: quantile edges of hundreds of columns in one pass, then packed rows that every round reads.

A feature's edges are distinct quantiles of its values; a value's code is 1 and the number of edges below it, 0 for null and NaN. A
row of the matrix has its codes as one binary value, so it takes a byte for each feature, and 25 bytes of id, flag, weight, margin and
part, before compression.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowtide.sources.shared import new_folder

#: Rank error of a sketched quantile is a row in so many; below so many rows, sketches are exact; from there on, they are made exact.
ACCURACY = 10_000
#: Bytes of codes that a file of the matrix holds about.
FILE_BYTES = 32 << 20
#: A file for each of the session's tasks at a time, if it has so many rows.
FILE_ROWS = 1 << 13
ROWS = "id long, flag int, weight double, stop boolean, margin double, bins binary"


def bin_edges(table: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """Upper ends of each feature's bins but the last: the distinct ``i / bins`` quantiles (the smallest value with so large a share
    at or below it), so there are ``bins`` bins at most. All features are sketched in one aggregation, partial before its shuffle."""
    # each quantile between two others so near that the exact one lies between them, and few rows do
    at = ", ".join(f"{i / bins + off:.12f}D" if off else f"{i / bins}D" for i in range(1, bins) for off in (-2 / ACCURACY, 0, 2 / ACCURACY))
    # NaN is a missing value, and would be the greatest of all
    sketches = [F.expr(f"percentile_approx(CASE WHEN NOT isnan(`{c}`) THEN CAST(`{c}` AS DOUBLE) END, array({at}), {ACCURACY}) AS `e{k}`") for k, c in enumerate(features)]
    greatest = (F.expr(f"max(CASE WHEN NOT isnan(`{c}`) THEN CAST(`{c}` AS DOUBLE) END) AS `m{k}`") for k, c in enumerate(features))
    found = table.agg(*sketches, *greatest, F.count(F.lit(1)).alias("rows")).first()
    exact = found["rows"] < ACCURACY
    near = [np.unique(np.array((found[f"e{k}"] or [])[1::3] if exact else found[f"e{k}"] or [], float) + 0.0) for k in range(len(features))]
    if not exact:
        near = _exact(table, features, bins, near)
    # nothing lies above the greatest value
    return [edges[edges < found[f"m{k}"]] if len(edges) else edges for k, edges in enumerate(near)]


def _exact(table: DataFrame, features: list[str], bins: int, near: list[np.ndarray]) -> list[np.ndarray]:
    """The quantiles themselves, from sketched ones.

    The sketched values divide each feature into gaps. A first pass counts the rows in each gap and at each sketched value, so that the
    driver knows in which a quantile lies, and how many rows lie below. Only those quantiles that are no sketched value need a
    second pass: the values of their gaps, a few ten-thousandths of the rows, are counted, a group for each gap.
    """
    names = [f"f{k}" for k in range(len(features))]
    own = table.select(*(F.col(f"`{c}`").cast("double").alias(f) for c, f in zip(features, names, strict=True)))

    def places(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Values, and the place of each: 2 j for the gap below sketched value j, 2 j + 1 for that value."""
        x = np.asarray(batch.column(k).to_numpy(zero_copy_only=False), float)
        x = x[~np.isnan(x)] + 0.0
        return x, np.searchsorted(near[k], x, "left") + np.searchsorted(near[k], x, "right")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(2 * len(e) + 1, np.int64) for e in near]
        for batch in batches:
            for k in range(len(near)):
                sums[k] += np.bincount(places(batch, k)[1], minlength=len(sums[k]))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums)), pa.int32()), pa.array([s.tolist() for s in sums], pa.list_(pa.int64()))], ["k", "n"])

    counted = own.mapInArrow(count, "k int, n array<long>").select("k", F.posexplode("n").alias("place", "n")).groupBy("k", "place").agg(F.sum("n").alias("n"))
    sizes = [np.zeros(2 * len(e) + 1, np.int64) for e in near]
    for r in counted.collect():  # places of all features
        sizes[r.k][r.place] = r.n
    out: list[set[float]] = [set() for _ in near]
    wanted: list[tuple[int, int, int]] = []  # feature, gap, rank within the gap
    for k, n in enumerate(sizes):
        upto, rows = np.cumsum(n), int(n.sum())
        for i in range(1, bins) if rows else ():
            rank = max(1, -(-rows * i // bins))
            place = int(np.searchsorted(upto, rank, "left"))
            if place % 2:
                out[k].add(float(near[k][place // 2]))
            else:
                wanted.append((k, place, rank - int(upto[place - 1] if place else 0)))
    if wanted:
        gaps: dict[int, list[int]] = {}
        for k, place, _ in wanted:
            gaps.setdefault(k, []).append(place)

        def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k, of in gaps.items():
                    x, at = places(batch, k)
                    kept = np.isin(at, of)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(int(kept.sum()), k), pa.int32()), pa.array(at[kept], pa.int32()), pa.array(x[kept])], ["k", "place", "x"])

        values = own.mapInArrow(inside, "k int, place int, x double").groupBy("k", "place", "x").agg(F.count(F.lit(1)).alias("n"))
        order = Window.partitionBy("k", "place").orderBy("x")
        last = values.withColumn("upto", F.sum("n").over(order))
        ranks = F.broadcast(table.sparkSession.createDataFrame(sorted(set(wanted)), "k int, place int, rank long"))  # one row for each quantile
        for r in last.join(ranks, ["k", "place"]).where("rank <= upto AND rank > upto - n").collect():
            out[r.k].add(r.x)
    return [np.array(sorted(e)) for e in out]


def codes_of(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    code = np.searchsorted(edges, values, "left") + 1
    code[np.isnan(values)] = 0
    return code.astype(np.uint8)


def column_codes(batch: pa.RecordBatch, features: list[str], edges: list[np.ndarray]) -> np.ndarray:
    """Codes of a batch, rows by features."""
    out = np.empty((batch.num_rows, len(features)), np.uint8)
    for k, (c, e) in enumerate(zip(features, edges, strict=True)):
        out[:, k] = codes_of(np.asarray(batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False), float), e)
    return out


def packed(codes: np.ndarray) -> pa.Array:
    m, f = codes.shape
    return pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer(np.arange(0, (m + 1) * f, f, dtype=np.int32) if f else np.zeros(m + 1, np.int32)), pa.py_buffer(np.ascontiguousarray(codes))])


def unpacked(column: pa.Array, features: int) -> np.ndarray:
    if not features or not len(column):
        return np.zeros((len(column), features), np.uint8)
    _, offsets, data = column.buffers()
    first = int(np.frombuffer(offsets, np.int32)[column.offset])
    return np.frombuffer(data, np.uint8)[first : first + len(column) * features].reshape(len(column), features)


@dataclass(frozen=True)
class Matrix:
    rows: DataFrame
    folder: str
    features: list[str]
    edges: list[np.ndarray]
    files: int

    @property
    def codes(self) -> int:
        """Codes are below this."""
        return max((len(e) for e in self.edges), default=0) + 2

    @classmethod
    def write(cls, table: DataFrame, features: list[str], bins: int) -> Matrix:
        """Bin ``table`` (id, flag, weight, maybe is_validation, and ``features``) into files of about ``FILE_BYTES``.

        ``bins``: 254 at most. Rows that stop boosting (is_validation) do not shape the bins. Rows of one id may repeat.
        """
        if not 2 <= bins <= 254:
            raise ValueError("a code is one byte: 2 to 254 bins")
        stop = F.coalesce(F.col("is_validation"), F.lit(False)) if "is_validation" in table.columns else F.lit(False)
        edges = bin_edges(table.where(~stop), features, bins)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kept = [batch.column(c) for c in ("id", "flag", "weight", "stop")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(np.zeros(batch.num_rows)), packed(column_codes(batch, features, edges))], ROWS.replace(",", "").split()[::2])

        spark, folder = table.sparkSession, new_folder(table.sparkSession, "matrix")
        own = [F.col(f"`{c}`").cast("double").alias(f"f{k}") for k, c in enumerate(features)]
        names = [f"f{k}" for k in range(len(features))]
        columns, features = features, names
        made = table.select(F.col("id").cast("long").alias("id"), F.col("flag").cast("int").alias("flag"), F.col("weight").cast("double").alias("weight"), stop.alias("stop"), *own).mapInArrow(pack, ROWS)
        rows = table.count()
        files = max(1, math.ceil(rows * max(1, len(features)) / FILE_BYTES), min(spark.sparkContext.defaultParallelism, rows // FILE_ROWS))
        made.repartition(files, "id").write.option("compression", "zstd").parquet(folder)
        return cls(spark.read.schema(ROWS).parquet(folder), folder, columns, edges, files)
