"""Command line: build feature families, score and select features, train, predict and check a submission.

``python -m rowtide.cli STEP``; inputs and results lie in DATA_DIR, WORK_DIR and OUTPUT_DIR (any URI that Spark reads).
``build`` writes the families of the training and test histories; ``first``, ``improved`` and ``sequence`` train those models and
``fit`` the final one: features are scored and selected, entities sampled, models trained, blended and calibrated, and a checked
submission and a report written (below OUTPUT_DIR, in a folder of the step's name; those of ``fit`` in OUTPUT_DIR itself).
``all`` runs first, improved, the sequence and distribution families, and fit.
"""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtide.functions import scalar
from rowtide.operators import ensemble, sampling, scoring
from rowtide.plans import flows, models
from rowtide.plans.families import best, build, matrices, scores
from rowtide.sources import tables
from rowtide.sources.shared import cut

# Flags and their defaults, and what the step "all" gives to "fit".
ALL_FIT = ["--basic-features", "260", "--extra-features", "240", "--seq-features", "180", "--dist-features", "220", "--max-train", "720000", "--val-size", "240000", "--seed", "807", "--model-set", "rankish", "--pos-scale-mult", "0.45"]


def arguments(args: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="rowtide", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    steps = p.add_subparsers(dest="step", required=True)
    step = {name: steps.add_parser(name) for name in ("build", "first", "improved", "sequence", "fit", "all")}
    step["first"].add_argument("--force-features", action="store_true", help="build the basic family anew")
    step["first"].add_argument("--skip-baseline", action="store_true", help="without the linear baseline")
    step["improved"].add_argument("--force-extra", action="store_true", help="build the extra family anew")
    step["improved"].add_argument("--top-n", type=int, default=flows.IMPROVED_FEATURES)
    step["improved"].add_argument("--skip-extra-trees", action="store_true", help="without the forest")
    for name in ("build", "fit"):
        q = step[name]
        q.add_argument("--force", action="store_true", help="build tables and scores anew")
        q.add_argument("--basic-features", type=int, default=260)
        q.add_argument("--extra-features", type=int, default=300)
        q.add_argument("--seq-features", type=int, default=240)
        q.add_argument("--dist-features", type=int, default=0)
    q = step["fit"]
    q.add_argument("--force-rescore", action="store_true", help="score features anew")
    q.add_argument("--max-train", type=int, default=950_000)
    q.add_argument("--val-size", type=int, default=260_000)
    q.add_argument("--seed", type=int, default=1701)
    q.add_argument("--model-set", choices=sorted(models.MODEL_SETS), default="all")
    q.add_argument("--pos-scale-mult", type=float, default=0.45)
    for name in ("first", "improved", "sequence", "all"):
        step[name].add_argument("--val-size", type=int, help="validation rows, instead of the step's own")
    for name in ("first", "improved", "sequence", "fit", "all"):
        step[name].add_argument("--rounds", type=int, help="boosting rounds (or trees), instead of the candidates' own")
        step[name].add_argument("--depth", type=int, help="tree depth, instead of the candidates' own")
    return p.parse_args(args)


def wanted(args: argparse.Namespace) -> dict[str, int]:
    """Features to select from each family; families of none are not used."""
    all_ = {"basic": args.basic_features, "extra": args.extra_features, "seq": args.seq_features, "dist": args.dist_features}
    return {k: n for k, n in all_.items() if n > 0}


def labels(spark: SparkSession, where: tables.Folders) -> DataFrame:
    return scoring.unique_target(tables.read_target(spark, f"{where.data}/train_target.csv"))


def deliver(spark: SparkSession, where: tables.Folders, folder: str, predicted: DataFrame, report: dict, seven_digits: bool = True) -> dict:
    """Write the submission in the sample's order, and the report, to ``folder``; fails if an entity of the sample has no valid
    prediction."""
    sample = cut(tables.read_sample(spark, f"{where.data}/sample_submission.csv"))
    submitted = cut(ensemble.submission(sample, predicted))
    report = report | {"submission": ensemble.require(ensemble.checked(sample, submitted))}
    tables.write_submission(submitted, f"{folder}/submission", seven_digits)
    tables.write_report(spark, report, f"{folder}/report")
    return report


def first(spark: SparkSession, where: tables.Folders, args: argparse.Namespace) -> dict:
    """The first model: basic features, a boosted model and a linear baseline; predictions are not moved to the prior."""
    target = labels(spark, where)
    built = build(spark, where, ["basic"], args.force_features)
    chosen = best(scores(spark, where, "scores_first", built, target, ["basic"], population=False), {"basic": flows.FIRST_FEATURES})
    matrix = matrices(built, chosen)
    report = {}
    if not args.skip_baseline:
        report["baseline"] = flows.run(flows.BASELINE.scaled(None, None, args.val_size), {"train": matrix["train"]}, target)[1]
    predicted, own = flows.run(flows.FIRST.scaled(args.rounds, args.depth, args.val_size), matrix, target)
    return deliver(spark, where, f"{where.output}/first", predicted, report | own | {"chosen": chosen}, seven_digits=False)


def improved(spark: SparkSession, where: tables.Folders, args: argparse.Namespace) -> dict:
    """The improved model: the best of basic and extra features together, two boosted models and a forest."""
    target = labels(spark, where)
    built = build(spark, where, ["basic", "extra"], ["extra"] if args.force_extra else [])
    scored = scores(spark, where, "scores_improved", built, target, ["basic", "extra"])
    chosen = best(scored, {"basic": 0, "extra": 0}, joint=args.top_n)
    flow = flows.IMPROVED.scaled(args.rounds, args.depth, args.val_size)
    if args.skip_extra_trees:
        flow = replace(flow, members=flow.members[:2])
    predicted, report = flows.run(flow, matrices(built, chosen), target)
    return deliver(spark, where, f"{where.output}/improved", predicted, report | {"chosen": {f: len(x) for f, x in chosen.items()}})


def sequence(spark: SparkSession, where: tables.Folders, args: argparse.Namespace) -> dict:
    """The sequence model: the best features of three families, two boosted models that predict as they were validated."""
    target, quota = labels(spark, where), flows.SEQUENCE_FEATURES
    built = build(spark, where, quota)
    chosen = best(scores(spark, where, "scores_sequence", built, target, quota), quota)
    predicted, report = flows.run(flows.SEQUENCE.scaled(args.rounds, args.depth, args.val_size), matrices(built, chosen), target)
    return deliver(spark, where, f"{where.output}/sequence", predicted, report | {"chosen": {f: len(x) for f, x in chosen.items()}})


def fit(spark: SparkSession, where: tables.Folders, args: argparse.Namespace) -> dict:
    """Train the model set, write the submission and the report; the report."""
    families = wanted(args)
    built = build(spark, where, families, args.force)
    target = labels(spark, where)
    chosen = best(scores(spark, where, "scores", built, target, families, force=args.force or args.force_rescore), families)
    matrix = matrices(built, chosen)
    ids = cut(sampling.training_sample(target, args.val_size, args.max_train, args.seed))
    names = [c for c in matrix["train"].columns if c != "id"]
    rows = cut(matrix["train"].join(ids, "id").withColumn("is_validation", F.col("part") == "val"))
    columns, fitted, aucs, valid = [], [], {}, rows.where("is_validation").select("id", "flag", *names)
    for k, name in enumerate(models.MODEL_SETS[args.model_set]):
        config = models.CONFIGS[name].scaled(args.rounds, args.depth)
        if config.multiplier is not None and name == "gbdt_rankish":
            config = replace(config, multiplier=args.pos_scale_mult)
        model = models.fit(rows.select("id", "flag", "is_validation", *names), names, config, args.seed)
        columns.append(f"p{k + 1}")
        valid = models.predict(model, valid, columns[-1])
        # the last fit takes the validation rows too, and as many rounds as the first one kept
        fitted.append(models.fit(rows.select("id", "flag", *names), names, config.scaled(max(1, model.rounds)), args.seed + 100))
    valid = cut(valid.select("flag", *columns))
    for c, name in zip(columns, models.MODEL_SETS[args.model_set], strict=True):
        aucs[name] = ensemble.roc_auc(valid.select("flag", F.col(c).alias("score"))).first().auc
    weights, aucs["blend"] = flows.weigh(valid, columns, 41)
    scored = matrix["test"]
    for c, model in zip(columns, fitted, strict=True):
        scored = models.predict(model, scored, c)
    prior = target.agg(F.avg("flag").alias("prior")).first().prior
    predicted = scored.select("id", *columns).transform(lambda df: ensemble.calibrated(df, columns, weights, F.lit(prior)))
    report = {"model_set": args.model_set, "auc": aucs, "weights": weights, "prior": prior, "features": {f: len(x) for f, x in chosen.items()}}
    return deliver(spark, where, where.output, predicted, report)


def every(spark: SparkSession, where: tables.Folders, args: argparse.Namespace) -> dict:
    """All steps that lead to the final submission; its report."""
    own = [x for name in ("rounds", "depth", "val_size") if (v := getattr(args, name)) for x in (f"--{name.replace('_', '-')}", str(v))]
    first(spark, where, arguments(["first", "--skip-baseline", *own]))
    improved(spark, where, arguments(["improved", "--skip-extra-trees", *own]))
    build(spark, where, ["seq", "dist"])
    return fit(spark, where, arguments(["fit", *ALL_FIT, *own]))


def main(argv: list[str] | None = None) -> None:
    args = arguments(argv)
    spark, where = SparkSession.builder.appName("rowtide").getOrCreate(), tables.Folders.from_environment()
    if args.step == "build":
        build(spark, where, wanted(args), args.force)
    else:
        {"first": first, "improved": improved, "sequence": sequence, "fit": fit, "all": every}[args.step](spark, where, args)


if __name__ == "__main__":
    main()
