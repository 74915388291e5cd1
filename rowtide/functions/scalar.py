"""Scalar expressions; all stay in generated JVM code."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-8


def clip(x: Column, lo, hi) -> Column:
    """``x`` within [lo, hi]; null stays null (least and greatest alone would pass over it)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def safe_number(x: Column) -> Column:
    """NaN, infinite and null become 0."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where it has no value."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def logit(p: Column) -> Column:
    q = clip(p, EPSILON, 1 - EPSILON)
    return F.ln(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def calibrate(score: Column, prior: Column) -> Column:
    """Move a balanced score to the odds of ``prior``."""
    s, odds = clip(score, EPSILON, 1 - EPSILON), prior / (1 - prior)
    return s * odds / (1 - s + s * odds)


def class_weight(flag: Column, prior: Column, multiplier: float = 1.0) -> Column:
    """Weight that balances the classes; ``multiplier`` scales the positive one."""
    return F.when(flag == 1, F.lit(0.5) / prior * F.lit(multiplier)).otherwise(F.lit(0.5) / (1 - prior))


def positive_weight(positives: Column, negatives: Column, most: float = 24.0, multiplier: float | None = None) -> Column:
    """Negatives for each positive, at most ``most``; with a multiplier, scaled and 1 at least."""
    balance = negatives.cast("double") / F.greatest(positives, F.lit(1))
    return F.least(balance, F.lit(most)) if multiplier is None else F.greatest(F.lit(1.0), F.least(balance * multiplier, F.lit(most)))


def cross_code(left: Column, right: Column) -> Column:
    """left * 10 + right as an int: small integer types would overflow."""
    return left.cast("int") * 10 + right.cast("int")


def count_of(columns: list[str], test) -> Column:
    """Number of the row's ``columns`` that pass ``test``; a null result does not pass."""
    return reduce(add, (F.when(test(F.col(c)), 1).otherwise(0) for c in columns))


def row_mean(columns: list[str]) -> Column:
    """Mean of the row's non-null values; null if there are none."""
    total = reduce(add, (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns))
    return F.try_divide(total, count_of(columns, lambda c: c.isNotNull()))


def row_max(columns: list[str]) -> Column:
    return F.greatest(*columns)


def sample_key(key: Column, seed: int) -> Column:
    """Seeded order of ids, the same on every engine and partitioning."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))
