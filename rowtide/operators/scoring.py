"""Univariate scores of features, and selection by score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowtide.functions import scalar, vocab

FLOOR = 1e-12


def attach_target(features: DataFrame, target: DataFrame, required: bool = True) -> DataFrame:
    """``features`` with ``flag``. With ``required``, running it fails on an entity without a label."""
    joined = features.join(target.select("id", "flag"), "id", "left")
    if not required:
        return joined
    missing = F.raise_error(F.concat(F.lit("target is missing for id "), F.col("id").cast("string"))).cast("int")
    return joined.withColumn("flag", F.coalesce("flag", missing))


def unique_target(target: DataFrame) -> DataFrame:
    """``target`` as it is; running it fails if an id stands there twice."""
    twice = F.raise_error(F.concat(F.lit("target repeats id "), F.col("id").cast("string"))).cast("int")
    one = target.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.first("flag").alias("flag"))
    return one.select("id", F.when(F.col("n") == 1, F.col("flag")).otherwise(twice).alias("flag"))


def effect_sizes(labelled: DataFrame, population: bool = False, family: str | None = None) -> DataFrame:
    """(feature, score): |mean of flag 1 - mean of flag 0| / standard deviation, 0 where that has no value.

    The sample deviation, or, with ``population``, that of the population with its variance floored. Features are exploded
    and added up before the shuffle, so that hundreds of columns cost one aggregation by place.
    """
    features = [c for c in labelled.columns if c not in ("id", "flag")]
    # one array exploded by place: unpivot compiles a projection for each feature, and in every task anew beyond a hundred
    values = ", ".join(f"CAST(`{c}` AS DOUBLE)" for c in features)
    parts = labelled.selectExpr("flag", f"posexplode(array({values})) AS (k, x)").groupBy("k").agg(
        F.avg(F.when(F.col("flag") == 1, F.col("x"))).alias("one"), F.avg(F.when(F.col("flag") == 0, F.col("x"))).alias("zero"),
        F.stddev_samp("x").alias("sample"), F.var_pop("x").alias("variance"),
    )
    spread = F.sqrt(F.greatest(F.col("variance"), F.lit(FLOOR))) if population else F.col("sample")
    score = scalar.safe_number(F.try_divide(F.abs(F.col("one") - F.col("zero")), spread))
    out = parts.select(F.element_at(F.array(*map(F.lit, features)), F.col("k") + 1).alias("feature"), score.alias("score"))
    return out if family is None else out.select(F.lit(family).alias("family"), "feature", "score")


def ranked(scores: DataFrame, by: str | None = None) -> DataFrame:
    """``scores`` with ``place`` from 1 (within ``by``), ties by name. One row per feature: a few thousand."""
    order = (Window.partitionBy(by) if by else Window.partitionBy(F.lit(0))).orderBy(F.desc("score"), "feature")
    return scores.withColumn("place", F.row_number().over(order))


def top_features(scores: DataFrame, n: int, keep: tuple[str, ...] = vocab.MUST_KEEP) -> DataFrame:
    """The ``n`` best features and those that must be kept."""
    return ranked(scores).where((F.col("place") <= n) | F.col("feature").isin(*keep))


def top_by_family(scores: DataFrame, n: dict[str, int], keep: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """The n best of each family, and what must be kept of it."""
    quota = F.coalesce(*(F.when(F.col("family") == f, k) for f, k in n.items()), F.lit(0))
    kept = F.lit(False)
    for family, names in (keep or {"basic": vocab.MUST_KEEP}).items():
        kept = kept | ((F.col("family") == family) & F.col("feature").isin(*names))
    return ranked(scores, "family").where((F.col("place") <= quota) | kept)


def missing_columns(needed: DataFrame, there: DataFrame) -> list[str]:
    """Columns of ``needed`` that ``there`` lacks, by name."""
    return sorted(set(needed.columns) - set(there.columns))
