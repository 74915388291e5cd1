"""Joins on keys that may be very common: the facts of the commonest keys are broadcast, so no task gets all rows of one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key of more rows than this, and than one in MOST_COMMON of all rows, is common: there are MOST_COMMON such keys at most.
COMMON_ROWS, MOST_COMMON = 2048, 100_000


def common(counts: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """The common keys of ``counts`` (``key``, rows ``n``), of ``total`` rows in all; few enough to broadcast."""
    return counts.where(F.col(n) > max(COMMON_ROWS, total // MOST_COMMON)).select(key)


def join_by(rows: DataFrame, key: str, facts: DataFrame, at: str, often: DataFrame) -> DataFrame:
    """``rows`` with the other columns of ``facts`` where ``key`` is its ``at`` (one row each); rows without facts go.

    ``often``: the common keys, in a column ``at``. Their rows stay where they are for the broadcast facts; only the others are dealt
    by key. ``rows`` is read twice then; without common keys it is one join.
    """
    names = [F.col(f"f.{c}") for c in facts.columns if c != at]
    same = F.col(f"r.{key}") == F.col(f"f.{at}")
    if often.isEmpty():
        return rows.alias("r").join(facts.alias("f"), same).select("r.*", *names)
    few = F.broadcast(facts.join(F.broadcast(often), at, "left_semi"))
    rest = rows.join(F.broadcast(often.withColumnRenamed(at, "_often")), F.col(key) == F.col("_often"), "left_anti")
    return rows.alias("r").join(few.alias("f"), same).select("r.*", *names).unionByName(rest.alias("r").join(facts.alias("f"), same).select("r.*", *names))
