"""Deterministic stratified samples and splits: sizes and strata are exact, membership depends on ids and the seed only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowtide.operators.totals import running_totals, seeded_rank


def class_sizes(target: DataFrame) -> tuple[int, int]:
    """Rows of flag 1 and of flag 0."""
    n = target.agg(F.count_if(F.col("flag") == 1).alias("one"), F.count_if(F.col("flag") == 0).alias("zero")).first()
    return n.one, n.zero


def _take(target: DataFrame, ones: int, zeros: int, seed: int) -> DataFrame:
    quota = F.when(F.col("flag") == 1, ones).otherwise(zeros)
    return seeded_rank(target, "flag", seed).where(F.col("rank") <= quota).drop("rank")


def sample_rows(target: DataFrame, most: int, seed: int) -> DataFrame:
    """All positives and negatives up to ``most`` rows; if the positives alone are more, half of the rows positive."""
    one, zero = class_sizes(target)
    if one + zero <= most:
        return target
    ones = one if one <= most else most // 2
    return _take(target, ones, min(zero, most - ones), seed)


def sample_negatives(target: DataFrame, ratio: int, seed: int) -> DataFrame:
    """All positives and at most ``ratio`` negatives for each."""
    one, zero = class_sizes(target)
    return _take(target, one, min(zero, ratio * one), seed)


def quotas(ones: int, zeros: int, size: int) -> tuple[int, int]:
    """``size`` shared among the classes in proportion, by largest remainder (ties to flag 0)."""
    total = ones + zeros
    size = min(size, total)
    one, zero = (size * n // total for n in (ones, zeros)) if total else (0, 0)
    if one + zero < size:
        more_one = size * ones % total > size * zeros % total
        one, zero = one + more_one, zero + (not more_one)
    return one, zero


def split(target: DataFrame, validation: int, seed: int) -> DataFrame:
    """``target`` with ``part``: "val" for exactly ``validation`` rows, stratified by flag, "train" for the others."""
    one, zero = quotas(*class_sizes(target), validation)
    quota = F.when(F.col("flag") == 1, one).otherwise(zero)
    return seeded_rank(target, "flag", seed).withColumn("part", F.when(F.col("rank") <= quota, "val").otherwise("train")).drop("rank")


def training_sample(target: DataFrame, validation: int, most: int, seed: int) -> DataFrame:
    """(id, flag, part): the validation rows of :func:`split`, and of the others all positives with negatives up to ``most`` rows."""
    parts = split(target, validation, seed)
    pool = parts.where("part = 'train'")
    train = sample_rows(pool.select("id", "flag"), most, seed).withColumn("part", F.lit("train"))
    return parts.where("part = 'val'").select("id", "flag", "part").unionByName(train.select("id", "flag", "part"))


def id_tail(target: DataFrame, share: float = 0.82, most: int | None = None, seed: int = 555) -> DataFrame:
    """Rows whose id lies above the exact ``share`` quantile (interpolated) of ids; of them ``most`` by seeded hash."""
    ids = target.where("id is not null").select("id", F.lit(1).alias("_one"))
    place = share * (ids.count() - 1)
    low, part = math.floor(place), place - math.floor(place)
    # the two ids that the quantile lies between, by their places in the distributed order of ids
    near = running_totals(ids, [F.col("id")], {"_at": "_one"}).where(F.col("_at").isin(low, low + 1))
    cutoff = near.agg(F.sum(F.col("id") * F.when(F.col("_at") == low, 1 - part).otherwise(part)).alias("cutoff"))
    tail = target.crossJoin(F.broadcast(cutoff)).where(F.col("id") > F.col("cutoff")).drop("cutoff")  # one row
    if most is None:
        return tail
    return seeded_rank(tail.withColumn("_all", F.lit(0)), "_all", seed).where(F.col("rank") <= most).drop("rank", "_all")


def semi_sample(features: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``features`` whose id is in ``ids``; which side is small enough to broadcast is found at run time."""
    return features.join(ids.select("id"), "id", "left_semi")


def join_families(families: dict[str, DataFrame]) -> DataFrame:
    """Inner join by id; columns of all but the first family get its name as a prefix (``extra__``)."""
    out: DataFrame | None = None
    for name, table in families.items():
        own = table if out is None else table.withColumnsRenamed({c: f"{name}__{c}" for c in table.columns if c != "id"})
        out = own if out is None else out.join(own, "id")
    if out is None:
        raise ValueError("no family")
    return out
