"""ROC-AUC, blends in log-odds space, weight grids and calibrated, checked predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowtide.functions import scalar
from rowtide.operators.totals import running_totals


def roc_auc(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``auc`` (of each group in ``by``) of ``score`` against ``flag``, ties counted half; null without both classes.

    Equal scores are added up first; the totals before each score come from a distributed running total over all groups, less what
    stands before the group.
    """
    by = by or []
    levels = scored.groupBy(*by, "score").agg(F.count_if(F.col("flag") == 1).alias("ones"), F.count_if(F.col("flag") == 0).alias("zeros"))
    placed = running_totals(levels, [*map(F.col, by), F.col("score")], {"before": "zeros"})
    parts = placed.groupBy(*by).agg(
        F.min("before").alias("start"), F.sum("ones").alias("n_one"), F.sum("zeros").alias("n_zero"),
        F.sum(F.col("ones") * (F.col("before") + F.col("zeros") / 2)).alias("wins"),
    )
    auc = F.try_divide(F.col("wins") - F.col("start") * F.col("n_one"), F.col("n_one").cast("double") * F.col("n_zero"))
    return parts.select(*by, auc.alias("auc"))


def blend(predictions: list[str], weights: list[Column]) -> Column:
    """Weighted sum of log-odds."""
    out = F.lit(0.0)
    for p, w in zip(predictions, weights, strict=True):
        out = out + w * scalar.logit(F.col(p))
    return out


def pair_grid(steps: int = 21) -> list[tuple[float, ...]]:
    return [(i / (steps - 1), 1 - i / (steps - 1)) for i in range(steps)]


def triple_grid(steps: int = 11) -> list[tuple[float, ...]]:
    """w1 in equal steps, w2 in equal steps of what w1 leaves, w3 the rest."""
    out = []
    for i in range(steps):
        w1 = i / (steps - 1)
        for j in range(steps):
            w2 = (1 - w1) * j / (steps - 1)
            out.append((w1, w2, 1 - w1 - w2))
    return out


def weight_aucs(validated: DataFrame, predictions: list[str], grid: list[tuple[float, ...]]) -> DataFrame:
    """(n, w1.., auc) for each point of the weight grid; scores are rounded to 12 digits so that ties do not hang on the last bit."""
    names = [f"w{k + 1}" for k in range(len(predictions))]
    points = F.array(*(F.struct(F.lit(n).alias("n"), *(F.lit(float(w)).alias(c) for c, w in zip(names, ws, strict=True))) for n, ws in enumerate(grid)))
    spread = validated.select("flag", *predictions, F.explode(points).alias("p")).select("flag", *predictions, "p.*")
    scored = spread.withColumn("score", F.round(blend(predictions, [F.col(c) for c in names]), 12))
    return roc_auc(scored.select("n", *names, "flag", "score"), ["n", *names])


def best_weights(validated: DataFrame, predictions: list[str], grid: list[tuple[float, ...]]) -> DataFrame:
    """The first grid point of the highest AUC, in one row."""
    return weight_aucs(validated, predictions, grid).orderBy(F.desc("auc"), "n").limit(1)


def calibrated(predicted: DataFrame, predictions: list[str], weights: list[float], prior: Column) -> DataFrame:
    """(id, flag): blended in log-odds, back to probability, moved to the prior."""
    score = scalar.sigmoid(blend(predictions, [F.lit(float(w)) for w in weights]))
    return predicted.select("id", scalar.calibrate(score, prior).alias("flag"))


def submission(sample: DataFrame, predicted: DataFrame) -> DataFrame:
    """Predictions in the order of ``sample`` (id, ord): (ord, id, flag), flag null where there is no prediction."""
    return sample.select("ord", "id").join(predicted.select("id", "flag"), "id", "left").select("ord", "id", "flag")


def checked(sample: DataFrame, submitted: DataFrame) -> DataFrame:
    """One row: what is wrong with a submission (ord, id, flag) against its sample (ord, id), and a summary of its values."""
    both = sample.select("ord", F.col("id").alias("want")).join(submitted.select("ord", "id", "flag"), "ord", "full")
    return both.agg(
        F.count("id").alias("rows"), F.count_if(F.col("want").isNull() | F.col("id").isNull()).alias("unmatched"), F.count_if(F.col("want") != F.col("id")).alias("out_of_order"),
        F.count_if(F.col("id").isNotNull() & F.col("flag").isNull()).alias("nulls"), F.count_if(~F.col("flag").between(0, 1)).alias("out_of_range"),
        F.min("flag").alias("min"), F.max("flag").alias("max"), F.avg("flag").alias("mean"),
    )


def require(report: DataFrame) -> dict:
    """The one row of :func:`checked` as a dict; raises if anything is wrong."""
    row = report.first().asDict()
    wrong = {k: row[k] for k in ("unmatched", "out_of_order", "nulls", "out_of_range") if row[k]}
    if wrong:
        raise ValueError(f"bad submission: {wrong}")
    return row
