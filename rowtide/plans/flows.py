"""Flows of the earlier models: a sample with validation rows, candidates, their blend, the last fits and the predictions.

A flow stops its boosting early by a share of its training rows; validation rows only measure and weigh the candidates.
Splits, samples and tails are made of ids and flags; the features are joined to them once.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowtide.operators import ensemble, sampling, scoring
from rowtide.plans import models
from rowtide.sources.shared import cut


@dataclass(frozen=True)
class Member:
    """A model of a flow. ``most``: rows of its last fit (None: the model as it was validated predicts); ``negatives``: for each
    positive, in the first and the last fit (None: all); ``last``: the candidate of the last fit, if it is another one."""

    config: models.Boosted | models.Forest | models.Logistic
    seed: int
    last_seed: int = 0
    sample_seed: int = 0
    most: int | None = None
    least_rounds: int = 1
    negatives: tuple[int, int] | None = None
    last: models.Forest | None = None


@dataclass(frozen=True)
class Flow:
    """``pool``: rows that the validation rows are split from; ``train``: most training rows; ``tail``: most rows of the id tail;
    ``refit_tail``: the tail is judged by a model of the other ids, with so many rows, not by the candidates; ``to_prior``:
    predictions are blended in log-odds and moved to the prior."""

    name: str
    seed: int
    validation: int
    members: tuple[Member, ...]
    pool: int | None = None
    train: int | None = None
    tail: int | None = None
    tail_seed: int = 0
    refit_tail: tuple[int, int] | None = None
    steps: int = 21
    to_prior: bool = True

    def scaled(self, rounds: int | None, depth: int | None, validation: int | None) -> Flow:
        """The flow with other rounds (trees of a forest), depth and validation rows."""

        def less(m: Member) -> Member:
            if isinstance(m.config, models.Boosted):
                return replace(m, config=m.config.scaled(rounds, depth), least_rounds=min(m.least_rounds, rounds or m.least_rounds))
            if isinstance(m.config, models.Forest):
                return replace(m, config=m.config.scaled(rounds, depth), last=m.last and m.last.scaled(rounds, depth))
            return m

        return replace(self, members=tuple(map(less, self.members)), validation=validation or self.validation)


# Sample sizes, seeds and candidates of the flows.
BASELINE = Flow("baseline", 24, 180_000, (Member(models.LOGISTIC, 24),), pool=850_000)
FIRST = Flow(
    "first", 42, 300_000, (Member(models.CONFIGS["hgb_baseline"], 42, 42, 77, 1_600_000, 80),),
    pool=1_200_000, tail=300_000, tail_seed=12, refit_tail=(850_000, 11), to_prior=False,
)
IMPROVED = Flow(
    "improved", 91, 320_000,
    (
        Member(models.CONFIGS["hgb_wide_leaf63"], 91, 191, 191, 1_550_000, 120),
        Member(models.CONFIGS["hgb_regular_leaf31"], 92, 192, 192, 1_500_000, 120),
        Member(models.FOREST, 123, 321, 321, negatives=(12, 14), last=models.Forest(340)),
    ),
    pool=1_300_000, tail=320_000, tail_seed=555,
)
SEQUENCE = Flow("sequence", 807, 240_000, (Member(models.CONFIGS["seq_hgb_leaf63"], 807), Member(models.CONFIGS["seq_hgb_leaf31"], 808)), train=720_000, steps=41)
FIRST_FEATURES, IMPROVED_FEATURES, SEQUENCE_FEATURES = 360, 720, {"basic": 210, "extra": 110, "seq": 190}
TAIL_FROM, STOP_SHARE = 0.82, 0.08


def _parts(flow: Flow, target: DataFrame) -> DataFrame:
    """(id, flag, part): val, stop (which ends boosting) and train."""
    pool = sampling.sample_rows(target.select("id", "flag"), flow.pool, flow.seed) if flow.pool else target
    parts = cut(sampling.training_sample(pool, flow.validation, flow.train or flow.pool, flow.seed))
    train = parts.where("part = 'train'").select("id", "flag")
    stop = sampling.split(train, int(sum(sampling.class_sizes(train)) * STOP_SHARE), flow.seed)
    return cut(parts.where("part = 'val'").unionByName(stop.withColumn("part", F.when(F.col("part") == "val", "stop").otherwise("train"))))


def _auc(scored: DataFrame, score) -> float | None:
    return ensemble.roc_auc(scored.select("flag", score.alias("score"))).first().auc


def _fit(member: Member, rows: DataFrame, names: list[str]) -> models.Model:
    """A fit that stops early, on rows with ``part``."""
    if member.negatives:
        rows = sampling.semi_sample(rows, sampling.sample_negatives(rows.select("id", "flag"), member.negatives[0], member.seed))
    # other models learn from the rows too that boosting stops by
    stops = (F.col("part") == "stop") if isinstance(member.config, models.Boosted) else F.lit(False)
    return models.fit(rows.select("id", "flag", stops.alias("is_validation"), *names), names, member.config, member.seed)


def _rounds(model: models.Model, member: Member) -> int:
    return max(member.least_rounds, model.rounds)


def _last(member: Member, model: models.Model, labelled: DataFrame, names: list[str]) -> models.Model:
    """The fit that predicts: on as many rounds as the first one kept, over a sample of all labelled rows."""
    ids = labelled.select("id", "flag")
    if member.negatives:
        chosen, config = sampling.sample_negatives(ids, member.negatives[1], member.sample_seed), member.last or member.config
    elif member.most:
        chosen, config = sampling.sample_rows(ids, member.most, member.sample_seed), member.config.scaled(_rounds(model, member))
    else:
        return model
    return models.fit(sampling.semi_sample(labelled, chosen).select("id", "flag", *names), names, config, member.last_seed)


def _tail_auc(flow: Flow, labelled: DataFrame, names: list[str], fitted: list[models.Model], weights: list[float]) -> float | None:
    """ROC-AUC on the greatest ids; None if they are of one class."""
    ids = labelled.select("id", "flag")
    tail = cut(sampling.semi_sample(labelled, sampling.id_tail(ids, TAIL_FROM, flow.tail, flow.tail_seed)))
    if flow.refit_tail:
        most, seed = flow.refit_tail
        early = sampling.sample_rows(ids.join(sampling.id_tail(ids, TAIL_FROM), "id", "left_anti"), most, seed)
        stop = sampling.split(early, int(sum(sampling.class_sizes(early)) * STOP_SHARE), seed)
        member = replace(flow.members[0], seed=seed)
        member = replace(member, config=member.config.scaled(_rounds(fitted[0], member)))
        rows = labelled.join(stop.select("id", F.when(F.col("part") == "val", "stop").otherwise("train").alias("part")), "id")
        fitted, weights = [_fit(member, rows, names)], [1.0]
    columns = [f"p{k + 1}" for k in range(len(fitted))]
    for c, model in zip(columns, fitted, strict=True):
        tail = models.predict(model, tail, c)
    return _auc(tail, ensemble.blend(columns, [F.lit(float(w)) for w in weights]))


def weigh(valid: DataFrame, columns: list[str], steps: int) -> tuple[list[float], float | None]:
    """Weights of the best blend of one to three predictions, and its AUC."""
    if len(columns) == 1:
        return [1.0], _auc(valid, F.col(columns[0]))
    found = ensemble.best_weights(valid, columns, ensemble.pair_grid(steps) if len(columns) == 2 else ensemble.triple_grid()).first()
    return [found[f"w{k + 1}"] for k in range(len(columns))], found.auc


def run(flow: Flow, matrix: dict[str, DataFrame], target: DataFrame) -> tuple[DataFrame | None, dict]:
    """(id, flag) of the test entities and the report, from ``matrix`` ("train", "test": id and features) and (id, flag).

    Without "test", there are no predictions and no last fits. Models that the blend does not weigh are not fitted again. Running
    it fails on a training entity without a label.
    """
    names = [c for c in matrix["train"].columns if c != "id"]
    labelled = cut(scoring.attach_target(matrix["train"], target))
    rows = cut(labelled.join(_parts(flow, labelled.select("id", "flag") if flow.pool else target).select("id", "part"), "id"))
    train, valid = rows.where("part <> 'val'"), rows.where("part = 'val'")
    columns, fitted = [f"p{k + 1}" for k in range(len(flow.members))], []
    for c, member in zip(columns, flow.members, strict=True):
        fitted.append(_fit(member, train, names))
        valid = models.predict(fitted[-1], valid, c)
    valid = cut(valid.select("flag", *columns))
    weights, auc = weigh(valid, columns, flow.steps)
    sizes = {r.part: r["count"] for r in rows.groupBy("part").count().collect()}  # three parts
    report = {
        "aucs": {m.config.name: _auc(valid, F.col(c)) for c, m in zip(columns, flow.members, strict=True)}, "auc": auc, "weights": weights,
        "features": len(names), "validation_rows": sizes.get("val", 0), "train_rows": sizes.get("train", 0) + sizes.get("stop", 0),
        "tail_auc": _tail_auc(flow, labelled, names, fitted, weights) if flow.tail else None,
    }
    if "test" not in matrix:
        return None, report
    used = [(c, m, f, w) for c, m, f, w in zip(columns, flow.members, fitted, weights, strict=True) if w > 0]
    scored = matrix["test"]
    for c, member, model, _ in used:
        scored = models.predict(_last(member, model, labelled, names), scored, c)
    if not flow.to_prior:
        return scored.select("id", F.col(used[0][0]).alias("flag")), report
    prior = target.agg(F.avg("flag").alias("prior")).first().prior
    return ensemble.calibrated(scored.select("id", *(u[0] for u in used)), [u[0] for u in used], [u[3] for u in used], F.lit(prior)), report
