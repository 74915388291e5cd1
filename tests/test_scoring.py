"""Scores, samples, ensembles, checked output, readers and writers."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from rowtide.functions import scalar
from rowtide.operators import ensemble, sampling, scoring
from rowtide.plans import models
from rowtide.sources import tables
from rowtide.streaming import running


def target(spark, ones, zeros):
    return spark.createDataFrame([(i, 1) for i in range(ones)] + [(1000 + i, 0) for i in range(zeros)], "id long, flag int")


def sizes(df):
    return {r.flag: r["count"] for r in df.groupBy("flag").count().collect()}


def test_effect_sizes(spark):
    df = spark.createDataFrame([(1, 1, 3.0, 5.0), (2, 1, 5.0, 5.0), (3, 0, 1.0, 5.0), (4, 0, 1.0, 5.0)], "id long, flag int, a double, constant double")
    got = {r.feature: r.score for r in scoring.effect_sizes(df).collect()}
    assert got == {"a": pytest.approx(3 / math.sqrt(11 / 3)), "constant": 0}
    assert {r.feature: r.score for r in scoring.effect_sizes(df, True).collect()}["a"] == pytest.approx(3 / math.sqrt(11 / 4))


def test_missing_and_repeated_labels_fail(spark):
    known = spark.createDataFrame([(1, 1)], "id long, flag int")
    with pytest.raises(Exception, match="target is missing"):
        scoring.attach_target(spark.createDataFrame([(1,), (2,)], "id long"), known).collect()
    with pytest.raises(Exception, match="target repeats"):
        scoring.unique_target(known.union(known)).collect()


def test_top_features_keep_what_must_stay(spark):
    scores = spark.createDataFrame([(f"f{i}", float(i)) for i in range(6)] + [("tie", 5.0), ("id_norm", 0.0)], "feature string, score double")
    assert [r.feature for r in scoring.top_features(scores, 2).orderBy("place").collect()] == ["f5", "tie", "id_norm"]


def test_splits_are_stratified_and_repeatable(spark):
    t = target(spark, 40, 160)
    parts = sampling.split(t, 51, 7)
    assert sizes(parts.where("part = 'val'")) == {1: 10, 0: 41}
    again = sampling.split(t.repartition(9), 51, 7)
    assert {r.id for r in parts.where("part = 'val'").collect()} == {r.id for r in again.where("part = 'val'").collect()}


@pytest.mark.parametrize(("ones", "zeros", "most", "want"), [(10, 50, 30, {1: 10, 0: 20}), (40, 50, 30, {1: 15, 0: 15}), (5, 5, 30, {1: 5, 0: 5}), (0, 9, 4, {0: 4})])
def test_bounded_samples(spark, ones, zeros, most, want):
    assert sizes(sampling.sample_rows(target(spark, ones, zeros), most, 1)) == want


def test_negatives_and_tail(spark):
    t = target(spark, 10, 100)
    assert sizes(sampling.sample_negatives(t, 3, 1)) == {1: 10, 0: 30}
    tail = sampling.id_tail(t, 0.5)
    assert {r.id for r in tail.collect()} == set(range(1045, 1100))


def test_auc_with_ties_and_one_class(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "flag int, score double")
    assert ensemble.roc_auc(df).first().auc == pytest.approx(0.875)
    assert ensemble.roc_auc(df.where("flag = 1")).first().auc is None


def test_auc_is_the_library_s(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    df = spark.range(500).select((F.col("id") * 37 % 5 < 2).cast("int").alias("flag"), (F.col("id") * 91 % 101 / 101.0).alias("score"))
    want = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="flag").evaluate(df.withColumn("flag", F.col("flag").cast("double")))
    assert ensemble.roc_auc(df).first().auc == pytest.approx(want, abs=1e-9)


def test_best_weights_take_the_first_of_equals(spark):
    df = spark.createDataFrame([(1, 0.9, 0.9), (0, 0.1, 0.1)], "flag int, p1 double, p2 double")
    best = ensemble.best_weights(df, ["p1", "p2"], ensemble.pair_grid(5)).first()
    assert (best.n, best.auc) == (0, 1.0)


def test_scalars(spark):
    row = spark.range(1).select(
        scalar.logit(F.lit(0.0)).alias("low"), scalar.sigmoid(scalar.logit(F.lit(0.3))).alias("back"), scalar.calibrate(F.lit(0.5), F.lit(0.1)).alias("prior"), scalar.clip(F.lit(None).cast("int"), 0, 9).alias("none"),
        scalar.safe_number(F.lit(float("nan"))).alias("nan"), scalar.safe_number(F.lit(float("inf"))).alias("inf"), scalar.positive_weight(F.lit(0), F.lit(90)).alias("most"), scalar.cross_code(F.lit(19).cast("byte"), F.lit(6).cast("byte")).alias("code"),
    ).first()
    assert row.low == pytest.approx(math.log(1e-8 / (1 - 1e-8)))
    assert (row.back, row.prior) == (pytest.approx(0.3), pytest.approx(0.1))
    assert (row.none, row.nan, row.inf, row.most, row.code) == (None, 0, 0, 24, 196)


def test_submission_checks(spark):
    sample = spark.createDataFrame([(0, 5), (1, 3), (2, 9)], "ord long, id long")
    good = ensemble.submission(sample, spark.createDataFrame([(3, 0.1), (5, 0.2), (9, 1.0)], "id long, flag double"))
    assert ensemble.require(ensemble.checked(sample, good))["rows"] == 3
    bad = ensemble.submission(sample, spark.createDataFrame([(3, 0.1), (9, 1.5)], "id long, flag double"))
    with pytest.raises(ValueError, match="nulls.*out_of_range"):
        ensemble.require(ensemble.checked(sample, bad))


def test_tables_are_built_once(spark, tmp_path):
    built = []

    def build(n):
        def make():
            built.append(n)
            return spark.range(n)

        return make

    path = str(tmp_path / "t")
    assert tables.build_table(spark, path, "a", build(3)).count() == 3
    assert tables.build_table(spark, path, "a", build(4)).count() == 3
    assert tables.build_table(spark, path, "b", build(5)).count() == 5
    assert tables.build_table(spark, path, "b", build(6), force=True).count() == 6
    assert built == [3, 5, 6]


def test_sample_order_and_submission_file(spark, tmp_path):
    (tmp_path / "sample.csv").write_text("id,flag\n9,0\n3,0\n5,0\n")
    sample = tables.read_sample(spark, str(tmp_path / "sample.csv"))
    assert [(r.ord, r.id) for r in sample.orderBy("ord").collect()] == [(1, 9), (2, 3), (3, 5)]
    tables.write_submission(ensemble.submission(sample, spark.createDataFrame([(3, 0.25), (5, 1 / 3), (9, 1.0)], "id long, flag double")), str(tmp_path / "out"))
    (written,) = (tmp_path / "out").glob("part-*.csv")
    assert written.read_text() == "id,flag\n9,1.0000000\n3,0.2500000\n5,0.3333333\n"


def test_family_join_and_missing_columns(spark):
    a, b = spark.createDataFrame([(1, 2)], "id long, x int"), spark.createDataFrame([(1, 3), (2, 4)], "id long, x int")
    assert [r.asDict() for r in sampling.join_families({"basic": a, "extra": b}).collect()] == [{"id": 1, "x": 2, "extra__x": 3}]
    assert list(scoring.missing_columns(b, b.drop("x"))) == ["x"]


def test_model_parameters():
    assert set(models.MODEL_SETS) == {"all", "balanced", "rankish", "goss", "rankish_ensemble"}
    assert {n for names in models.MODEL_SETS.values() for n in names} <= set(models.CONFIGS)


def test_streamed_counts(spark):
    got = {r.id: r.n for r in running.event_counts(spark, "/root/testdata/sf0.001").collect()}
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert got == {r.user_id: r["count"] for r in events.groupBy("user_id").count().collect()}
