"""Query sets against all rows in blocks: every (row block, query block) tile is one group of bounded size."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowtide.sources.shared import cut

#: Tiles that a small table is cut into at least, so that all executors have some.
LEAST_TILES = 48
#: Bytes of the vectors of a block at most, as doubles.
BLOCK_BYTES = 16 << 20


class Blocks(NamedTuple):
    rows: int
    queries: int


def taking_part(vectors: DataFrame, is_query: Column, extra: Column | None = None) -> DataFrame:
    """(row, vec_id, embedding, asks) of the rows that take part, numbered and cut: without null ids, vectors that are null or
    hold null or non-finite components, and those for which ``extra`` does not hold. Every row counts, repeated or not."""
    v = F.col("embedding")
    good = F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = good if extra is None else good & extra
    kind = dict(vectors.dtypes)["embedding"]
    # floats stay floats where rows are shipped
    own = v if kind in ("array<float>", "array<double>") else v.cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), own.alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("asks"), good.alias("_good"))
    return cut(rows.where("_good").drop("_good").withColumn("row", F.monotonically_increasing_id()))


def blocks(rows: DataFrame, row_block: int, query_block: int, least_rows: int) -> Blocks:
    """Numbers of blocks of at most about so many rows and queries, and of ``BLOCK_BYTES``. Small tables are cut finer: rows down
    to ``least_rows``, the rest by queries."""
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("q"), F.max(F.size("embedding")).alias("d")).first()
    most = max(1, BLOCK_BYTES // (8 * max(1, size.d or 1)))
    by_row, by_query = math.ceil(size.n / min(row_block, most)), max(1, math.ceil(size.q / min(query_block, most)))
    by_row = max(1, by_row, min(math.ceil(LEAST_TILES / by_query), size.n // least_rows))
    return Blocks(by_row, max(by_query, min(size.q // 32, math.ceil(LEAST_TILES / by_row))))


def each(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def dealt(column: str, n: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(column, F.lit(seed)), F.lit(n))


def matrix(column: pa.ChunkedArray, kind: type = np.float64) -> np.ndarray:
    """Vectors of one length as the rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), kind).reshape(len(column), -1)


FOUND = "query_row long, query_id long, vec_id long, score {kind}"


def found(kind: str, parts: list[tuple[np.ndarray, ...]]) -> pa.Table:
    """The found pairs of a tile as a table: (query_row, query_id, vec_id, score) arrays."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64() if kind == "double" else pa.int64())
    columns = zip(*parts, strict=True) if parts else ([], [], [], [])
    return pa.table([pa.array(np.concatenate(list(c)) if parts else [], t) for c, t in zip(columns, kinds, strict=True)], names=["query_row", "query_id", "vec_id", "score"])


def merged(pairs: DataFrame, k: int, kind: str, smallest: bool) -> DataFrame:
    """The ``k`` best of each query row over all tiles, from a heap per query row: query_id, rank, vec_id, score; ties to smaller ids."""
    sign = 1 if smallest else -1

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[tuple[int, int], list] = {}
        for batch in batches:
            for query_row, query, row, score in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                heap = heaps.setdefault((query_row, query), [])
                item = (-sign * score, -row)
                if len(heap) < k:
                    heapq.heappush(heap, item)
                elif item > heap[0]:
                    heapq.heapreplace(heap, item)
        out: dict[str, list] = {"query_id": [], "rank": [], "vec_id": [], "score": []}
        for (_, query), heap in heaps.items():
            for rank, (score, row) in enumerate(sorted(heap, reverse=True), 1):
                for name, value in zip(out, (query, rank, -row, -sign * score), strict=True):
                    out[name].append(value)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64() if kind == "double" else pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))

    return pairs.select("query_row", "query_id", "vec_id", "score").repartition("query_row").mapInArrow(merge, f"query_id long, rank int, vec_id long, score {kind}")
