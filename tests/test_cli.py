"""The command line from histories to checked submissions."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from rowtide import cli
from rowtide.functions import vocab
from rowtide.operators import features, sampling
from rowtide.plans import families, flows
from rowtide.sources import adapter, tables


@pytest.fixture(scope="module")
def where(spark, tmp_path_factory):
    """Histories, labels and a sample in descending order of ids; every third id has flag 1."""
    d, at = "/root/testdata/sf0.001", tmp_path_factory.mktemp("flows")
    history = adapter.history(spark, d)
    for part in ("train", "test"):
        history.write.parquet(f"{at}/data/{part}_data.parquet")
    known = history.select("id").distinct()
    known.select("id", (F.col("id") % 3 == 0).cast("int").alias("flag")).coalesce(1).write.option("header", True).csv(f"{at}/data/train_target.csv")
    known.select("id", F.lit(0.0).alias("flag")).orderBy(F.desc("id")).coalesce(1).write.option("header", True).csv(f"{at}/data/sample_submission.csv")
    return tables.Folders(f"{at}/data", f"{at}/work", f"{at}/out")


@pytest.fixture(autouse=True)
def small_families(monkeypatch, request):
    """A few features of each family: one test builds the whole ones."""
    if "whole" in request.node.name:
        return
    few = ["pre_util", "pre_loans530"]
    small = {
        "basic": lambda h: features.by_entity(h, [*features.column_stats(few), F.count(F.lit(1)).cast("double").alias("loan_count")]).withColumn("id_norm", features.id_norm()),
        "extra": lambda h: features.recent_stats(h, few, (2, 3)),
        "seq": lambda h: features.sequence(h, few, 3),
    }
    monkeypatch.setattr(features, "FAMILIES", small)


def submitted(folder: str) -> list[list[str]]:
    import pathlib

    (written,) = (pathlib.Path(folder) / "submission").glob("part-*.csv")
    lines = [x.split(",") for x in written.read_text().splitlines()]
    assert lines[0] == ["id", "flag"]
    assert [int(x[0]) for x in lines[1:]] == sorted((int(x[0]) for x in lines[1:]), reverse=True)
    assert json.loads(next((pathlib.Path(folder) / "report").glob("part-*")).read_text())["submission"]["rows"] == len(lines) - 1
    return lines[1:]


def test_final_model(spark, where):
    args = cli.arguments("fit --basic-features 4 --extra-features 0 --seq-features 0 --max-train 100 --val-size 30 --model-set balanced --rounds 2 --depth 2".split())
    assert cli.wanted(args) == {"basic": 4}
    report = cli.fit(spark, where, args)
    assert 0 <= report["auc"]["gbdt_balanced"] <= 1
    assert report["weights"] == [1.0]
    assert all(len(x[1].split(".")[1]) == 7 for x in submitted(where.output))


def test_whole_families_are_built(spark, where, tmp_path):
    """All four real families from plain Parquet histories, by the command line's builder; every plan is made within seconds."""
    import time

    at = tables.Folders(where.data, f"{tmp_path}/work", f"{tmp_path}/out")
    history = tables.read_history(spark, f"{where.data}/train_data.parquet")
    for name, make in features.FAMILIES.items():
        began = time.time()
        make(history)._jdf.queryExecution().executedPlan()
        assert time.time() - began < 25, name
    args = cli.arguments("build --dist-features 1".split())
    built = families.build(spark, at, cli.wanted(args), args.force)
    n = history.select("id").distinct().count()
    for (family, part), df in built.items():
        assert (part, df.count()) == (part, n)
        assert len(df.columns) - 1 == {"basic": 469, "extra": 1066, "seq": 843, "dist": 1998}[family]
    assert built["extra", "train"].where("xrecent2_pre_util_max > xrecent10_pre_util_max OR xloan_count_check = 0").count() == 0


def test_first_model(spark, where, monkeypatch):
    monkeypatch.setattr(flows, "FIRST_FEATURES", 5)
    report = cli.first(spark, where, cli.arguments("first --rounds 2 --depth 2 --val-size 30".split()))
    assert report["features"] == len(report["chosen"]["basic"])
    assert 5 <= report["features"] <= 5 + len(vocab.MUST_KEEP)
    assert set(vocab.MUST_KEEP) <= set(report["chosen"]["basic"])
    assert 0 <= report["baseline"]["auc"] <= 1
    assert 0 <= report["tail_auc"] <= 1
    assert report["validation_rows"] == 30
    # raw predictions: balanced classes put their mean near a half, not at the share of flag 1
    values = [float(x[1]) for x in submitted(f"{where.output}/first")]
    assert 0.4 < sum(values) / len(values) < 0.6


def test_improved_model(spark, where):
    args = cli.arguments("improved --top-n 6 --rounds 2 --depth 2 --val-size 30".split())
    report = cli.improved(spark, where, args)
    assert set(report["aucs"]) == {"hgb_wide_leaf63", "hgb_regular_leaf31", "extra_trees"}
    assert abs(sum(report["weights"]) - 1) < 1e-9
    assert report["auc"] >= max(report["aucs"].values()) - 1e-9
    assert 6 <= sum(report["chosen"].values()) <= 6 + len(vocab.MUST_KEEP)
    assert submitted(f"{where.output}/improved")


def test_sequence_model(spark, where, monkeypatch):
    monkeypatch.setattr(flows, "SEQUENCE_FEATURES", {"basic": 3, "seq": 3})
    report = cli.sequence(spark, where, cli.arguments("sequence --rounds 2 --depth 2 --val-size 30".split()))
    assert set(report["aucs"]) == {"seq_hgb_leaf63", "seq_hgb_leaf31"}
    assert report["chosen"]["seq"] == 3
    assert submitted(f"{where.output}/sequence")


def test_a_flow_finds_a_planted_signal(spark):
    made = spark.range(600).select("id", F.expr("int(hash(id) % 2 = 0)").alias("x"), F.expr("hash(id, 7) % 10").alias("noise"))
    target = made.select("id", F.col("x").alias("flag"))
    flow = flows.SEQUENCE.scaled(2, 2, 100)
    predicted, report = flows.run(flow, {"train": made, "test": made}, target)
    assert report["auc"] == 1
    right = predicted.join(target.withColumnRenamed("flag", "y"), "id").agg(F.min(F.when(F.col("y") == 1, F.col("flag"))).alias("low"), F.max(F.when(F.col("y") == 0, F.col("flag"))).alias("high")).first()
    assert right.low > right.high
    assert report["validation_rows"] == 100
    assert report["train_rows"] == 500


def test_joint_selection_keeps_what_must_stay(spark):
    scored = spark.createDataFrame([("basic", "a", 0.5), ("basic", "id_norm", 0.0), ("extra", "b", 0.9), ("extra", "c", 0.7), ("basic", "loan_count", 0.1), ("extra", "id_norm", 0.0)], "family string, feature string, score double")
    assert families.best(scored, {"basic": 0, "extra": 0}, joint=3) == {"basic": ["a", "loan_count", "id_norm"], "extra": ["b", "c"]}
    assert families.best(scored, {"basic": 1, "extra": 1}) == {"basic": ["a", "loan_count", "id_norm"], "extra": ["b"]}


def test_changed_histories_are_built_again(spark, tmp_path):
    rows = adapter.history(spark, "/root/testdata/sf0.001")
    at = tables.Folders(f"{tmp_path}/data", f"{tmp_path}/work", f"{tmp_path}/out")
    for part in ("train", "test"):
        rows.where("id < 20").write.parquet(f"{tmp_path}/data/{part}_data.parquet")
    before = families.build(spark, at, ["basic"])["basic", "train"].count()
    rows.where("id < 40").write.mode("overwrite").parquet(f"{tmp_path}/data/train_data.parquet")
    assert families.build(spark, at, ["basic"])["basic", "train"].count() > before


def test_step_all_runs_every_step(spark, where, monkeypatch):
    ran = []
    for name in ("first", "improved", "fit"):
        monkeypatch.setattr(cli, name, lambda spark, where, args, name=name: ran.append((name, args)))
    monkeypatch.setattr(cli, "build", lambda spark, where, families: ran.append(("build", families)))
    cli.every(spark, where, cli.arguments("all --rounds 3".split()))
    assert [x[0] for x in ran] == ["first", "improved", "build", "fit"]
    assert ran[0][1].skip_baseline
    assert ran[1][1].skip_extra_trees
    assert ran[2][1] == ["seq", "dist"]
    assert (ran[3][1].model_set, ran[3][1].dist_features, ran[3][1].rounds) == ("rankish", 220, 3)


def test_folders_come_from_the_environment(monkeypatch):
    monkeypatch.setenv("DATA_DIR", "/a")
    monkeypatch.delenv("WORK_DIR", raising=False)
    monkeypatch.setenv("OUTPUT_DIR", "/c")
    assert tables.Folders.from_environment() == tables.Folders("/a", "work", "/c")


@pytest.mark.parametrize("ids", [[], [5], [1, 2], [1, 1, 1, 9], [None, 3, 4, 8, 20, 21]])
def test_id_tail_lies_above_the_exact_quantile(spark, ids):
    table = spark.createDataFrame([(i, 0) for i in ids], "id long, flag int")
    cutoff = table.agg(F.percentile("id", F.lit(0.82))).first()[0]
    assert sorted(r.id for r in sampling.id_tail(table).collect()) == sorted(i for i in ids if i is not None and i > cutoff)
