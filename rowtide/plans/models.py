"""Candidate models, their validation and final fit: leaf-wise boosting and randomised trees over a binned matrix, and Spark's
logistic regression."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtide.functions import scalar
from rowtide.learn.binning import Matrix
from rowtide.learn.boosting import Boosting, boost
from rowtide.learn.descent import LinearModel, stochastic_descent
from rowtide.learn.forest import RandomisedTrees, randomised_trees
from rowtide.learn.trees import Rule
from rowtide.operators import ensemble, sampling
from rowtide.sources.shared import cut, remove


@dataclass(frozen=True)
class Boosted:
    """A boosted candidate. ``most_weight`` and ``multiplier`` give the positive class's weight, or class weights if None; ``goss``:
    shares of the greatest gradients and of the others that a round takes; ``patience``: rounds without a better AUC (or, with
    ``by_auc`` off, loss) of the validation rows that end the boosting."""

    name: str
    rate: float
    rounds: int
    leaves: int
    least_rows: int
    columns: float = 1.0
    rows: float = 1.0
    bins: int = 127
    most_weight: float | None = None
    multiplier: float | None = None
    l1: float = 0.0
    l2: float = 0.0
    goss: tuple[float, float] | None = None
    patience: int = 180
    by_auc: bool = True

    def scaled(self, rounds: int | None = None, depth: int | None = None) -> Boosted:
        return replace(self, rounds=rounds or self.rounds, leaves=2**depth if depth else self.leaves)

    def fit(self, matrix: Matrix, seed: int) -> Boosting:
        rule = Rule(self.least_rows, self.l1, self.l2)
        return boost(matrix, rule, self.rate, self.rounds, self.leaves, self.columns, self.rows, self.goss, self.patience, self.by_auc, seed)


def _by_loss(name: str, rate: float, rounds: int, leaves: int, least_rows: int, l2: float, patience: int, bins: int = 128, multiplier: float | None = None) -> Boosted:
    return Boosted(name, rate, rounds, leaves, least_rows, bins=bins, multiplier=multiplier, l2=l2, patience=patience, by_auc=False)


# The candidates' parameters.
CONFIGS = {
    c.name: c
    for c in (
        Boosted("gbdt_balanced", 0.030, 3200, 96, 90, 0.82, 0.84, 127, 24.0, l1=0.02, l2=1.2),
        Boosted("gbdt_rankish", 0.038, 2600, 64, 140, 0.76, 0.78, 127, 13.0, 0.45, l2=2.2),
        Boosted("goss", 0.035, 3000, 80, 120, 0.80, 1.0, 127, 13.0, 0.55, l2=2.8, goss=(0.24, 0.12)),
        Boosted("rankish_deeper_seed", 0.034, 3000, 80, 115, 0.80, 0.80, 127, 13.0, 0.45, l2=3.0),
        _by_loss("hgb_baseline", 0.055, 230, 31, 80, 0.05, 18, bins=64),
        _by_loss("hgb_wide_leaf63", 0.042, 360, 63, 55, 0.015, 22, multiplier=0.95),
        _by_loss("hgb_regular_leaf31", 0.050, 310, 31, 90, 0.08, 20, multiplier=1.0),
        _by_loss("seq_hgb_leaf63", 0.042, 300, 63, 55, 0.025, 24, multiplier=0.95),
        _by_loss("seq_hgb_leaf31", 0.052, 240, 31, 90, 0.09, 22, multiplier=1.0),
    )
}
MODEL_SETS = {
    "all": ("gbdt_balanced", "gbdt_rankish"),
    "balanced": ("gbdt_balanced",),
    "rankish": ("gbdt_rankish",),
    "goss": ("goss",),
    "rankish_ensemble": ("gbdt_rankish", "rankish_deeper_seed"),
}


@dataclass(frozen=True)
class Logistic:
    """Standardised elastic-net logistic regression with balanced classes."""

    name: str = "logistic_baseline"
    most_weight: float | None = None
    multiplier: float | None = None

    def stages(self, seed: int) -> list:
        return [StandardScaler(inputCol="raw", outputCol="features", withMean=True), LogisticRegression(labelCol="flag", weightCol="weight", regParam=2e-5, elasticNetParam=0.08)]


@dataclass(frozen=True)
class Stochastic:
    """The same model by mini-batch stochastic descent."""

    alpha: float = 2e-5
    l1_ratio: float = 0.08
    epochs: int = 18
    tolerance: float = 1e-4
    batches: int = 16
    name: str = "sgd_baseline"
    most_weight: float | None = None
    multiplier: float | None = None

    def fit(self, rows: DataFrame, features: list[str], seed: int) -> LinearModel:
        return stochastic_descent(rows, features, self.alpha, self.l1_ratio, self.epochs, seed, self.batches, tolerance=self.tolerance)


@dataclass(frozen=True)
class Forest:
    """Extremely randomised trees over the first ``first`` features; ``depth``: None for as deep as they grow."""

    trees: int = 260
    columns: float = 0.55
    least_rows: int = 25
    first: int = 420
    depth: int | None = None
    bins: int = 254
    name: str = "extra_trees"
    most_weight: float | None = None
    multiplier: float | None = None

    def scaled(self, trees: int | None = None, depth: int | None = None) -> Forest:
        return replace(self, trees=trees or self.trees, depth=depth or self.depth)

    def fit(self, matrix: Matrix, seed: int) -> RandomisedTrees:
        return randomised_trees(matrix, self.trees, self.columns, self.least_rows, seed, most_depth=self.depth)


LOGISTIC = Logistic()
STOCHASTIC = Stochastic()
FOREST = Forest()


def weighted(train: DataFrame, config) -> DataFrame:
    """``train`` with ``weight``, by the class sizes of its own rows."""
    one, zero = sampling.class_sizes(train)
    if config.most_weight is not None:
        w = F.when(F.col("flag") == 1, scalar.positive_weight(F.lit(one), F.lit(zero), config.most_weight, config.multiplier)).otherwise(1.0)
    else:
        w = scalar.class_weight(F.col("flag"), F.lit(one / max(1, one + zero)), config.multiplier or 1.0)
    return train.withColumn("weight", w)


Model = Boosting | RandomisedTrees | LinearModel | PipelineModel


def fit(train: DataFrame, features: list[str], config, seed: int) -> Model:
    """Fit on rows with ``id``, ``flag`` (and ``is_validation``, which stops boosting early; other models leave those rows out)."""
    rows = weighted(train, config)
    if isinstance(config, Logistic | Stochastic):
        rows = rows.where(~F.col("is_validation")) if "is_validation" in train.columns else rows
        if isinstance(config, Stochastic):
            return config.fit(rows, features, seed)
        return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="keep"), *config.stages(seed)]).fit(rows)
    matrix = Matrix.write(rows, features[: config.first] if isinstance(config, Forest) else features, config.bins)
    try:
        return config.fit(matrix, seed)
    finally:
        remove(train.sparkSession, matrix.folder)


def predict(model: Model, table: DataFrame, name: str = "p") -> DataFrame:
    """``table`` with the probability of flag 1 as ``name``."""
    if not isinstance(model, PipelineModel):
        return model.predict(table, name)
    made = ("raw", "features", "rawPrediction", "probability", "prediction")
    return model.transform(table).withColumn(name, vector_to_array("probability")[1]).drop(*made)


def validate(spark: SparkSession, labelled: DataFrame, config, seed: int, share: float = 0.2, least: float = 0.8) -> DataFrame:
    """One row: model, validation rows, its AUC on them, rounds, whether the AUC reaches ``least``."""
    features = [c for c in labelled.columns if c not in ("id", "flag")]
    parts = cut(sampling.split(labelled, int(sum(sampling.class_sizes(labelled)) * share), seed).withColumn("is_validation", F.col("part") == "val"))
    model = fit(parts, features, config, seed)
    scored = predict(model, parts.where("is_validation").drop("weight"), "score")
    auc = ensemble.roc_auc(scored.select("flag", "score"))
    return auc.crossJoin(F.broadcast(scored.agg(F.count(F.lit(1)).alias("rows")))).select(F.lit(config.name).alias("model"), "rows", F.round("auc", 6).alias("auc"), F.lit(getattr(model, "rounds", None)).cast("int").alias("rounds"), (F.col("auc") >= least).alias("valid"))
