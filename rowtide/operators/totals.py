"""Distributed ranks and running totals: no window over a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowtide.functions.scalar import sample_key
from rowtide.sources.shared import cut


def running_totals(df: DataFrame, order: list[Column], values: dict[str, str]) -> DataFrame:
    """Add for each ``{out: column}`` the total of ``column`` over all rows before this one in ``order``.

    Rows are dealt by range of ``order``; each task adds up its own rows, and only one total per task meets in a window.
    Nulls in a value count 0. Rows that tie in ``order`` stand in any order. An empty table stays empty.
    """
    dealt = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    over = {out: F.coalesce(F.col(c), F.lit(0)) for out, c in values.items()}
    totals = dealt.groupBy("_part").agg(*(F.sum(v).alias(f"_t_{out}") for out, v in over.items()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_part", *(F.coalesce(F.sum(f"_t_{out}").over(before), F.lit(0)).alias(f"_b_{out}") for out in over))
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # one row per shuffle partition: its size is bounded by the session's partition count
    joined = dealt.join(F.broadcast(totals), "_part")
    return joined.withColumns({out: F.col(f"_b_{out}") + F.coalesce(F.sum(v).over(within), F.lit(0)) for out, v in over.items()}).drop("_part", *(f"_b_{out}" for out in over))


def seeded_rank(df: DataFrame, by: str, seed: int, key: str = "id") -> DataFrame:
    """Add ``rank``: place (from 1) within ``by`` in the order of the seeded hash of ``key``.

    A class can be most of the table, so ranks are built from 4096 cells of the hash: rows of the cells before, which are added up
    before the shuffle, and the place within the cell.
    """
    hashed = df.withColumn("_key", sample_key(F.col(key), seed)).withColumn("_cell", F.substring("_key", 1, 3))
    before = Window.partitionBy(by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = hashed.groupBy(by, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    cells = cells.select(F.col(by).alias("_by"), F.col("_cell").alias("_c"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(by, "_cell").orderBy("_key", key)
    placed = hashed.join(cells, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_cell") == F.col("_c")))
    return placed.withColumn("rank", F.col("_before") + F.row_number().over(within)).drop("_key", "_cell", "_by", "_c", "_before")
