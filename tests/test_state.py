"""A state kept up by batches gives the families and scores of the whole history, where it lies."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from rowtide.functions import vocab
from rowtide.operators import features, scoring, state
from rowtide.sources import adapter

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def history(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("history"))
    h = adapter.history(spark, SMALL)
    # nulls in some columns, codes out of the vocabulary, an entity with one row, rows without an id
    odd = h.withColumn("pre_util", F.when(F.col("rn") % 7 != 0, F.col("pre_util"))).withColumn("enc_paym_3", F.when(F.col("rn") % 5 != 0, F.col("enc_paym_3")))
    odd = odd.withColumn("pre_loans5", F.when(F.col("rn") % 11 == 0, F.lit(400)).otherwise(F.col("pre_loans5"))).where("id <> 7 or rn = 2")
    odd.unionByName(odd.limit(5).withColumn("id", F.lit(None).cast("long"))).write.parquet(at + "/h")
    return spark.read.parquet(at + "/h")


@pytest.fixture(scope="module")
def kept(spark, history, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("state"))
    s = state.FeatureState(spark, folder, 3)
    for k in (1, 0):  # batches that interleave, in any order
        assert s.add(f"part {k}", history.where(f"rn % 2 = {k}"))
    return s


def rows_of(df):
    return {r.id: r.asDict() for r in df.collect()}


@pytest.mark.parametrize("name", list(features.FAMILIES))
def test_families_are_those_of_the_whole_history(history, kept, name):
    want_table, got_table = features.FAMILIES[name](history), kept.family(name)
    assert got_table.columns == want_table.columns
    want, got = rows_of(want_table), rows_of(got_table)
    assert set(got) == set(want)
    for i, row in want.items():
        wrong = {c: (x, got[i][c]) for c, x in row.items() if not math.isclose(x, got[i][c], rel_tol=1e-9, abs_tol=1e-7)}
        assert not wrong, (i, wrong)


@pytest.mark.parametrize(("name", "population"), [("basic", True), ("basic", False), ("extra", True), ("seq", True), ("dist", True)])
def test_scores_are_those_of_the_wide_table(spark, history, kept, name, population):
    target = adapter.target(spark, SMALL)
    wide = scoring.effect_sizes(scoring.attach_target(kept.family(name), target), population)
    want = {r.feature: r.score for r in wide.collect()}
    got = {r.feature: r.score for r in kept.scores(name, target, population).collect()}
    assert set(got) == set(want)
    wrong = {f: (x, got[f]) for f, x in want.items() if not math.isclose(x, got[f], rel_tol=1e-7, abs_tol=1e-7)}
    assert not wrong


def test_scores_need_every_label(spark, kept):
    with pytest.raises(Exception, match="target is missing"):
        kept.scores("basic", adapter.target(spark, SMALL).where("id > 20")).collect()


def test_nothing_moves_once_the_state_lies_by_id(spark, kept):
    from rowtide.operators import sampling

    families = {f: kept.family(f, c) for f, c in {"basic": ["loan_count", "pre_util_mean"], "extra": ["xrecent3_pre_util_mean"], "seq": ["seq0_pre_util"], "dist": ["dlast_pre_util_3"]}.items()}
    merged = state.merge_totals(*[kept._tables[0]] * 2), state.merge_tails(*[kept._tables[1]] * 2)
    with_hints = sampling.join_families({k: f.hint("merge") for k, f in families.items()})
    for df in (*families.values(), *merged, with_hints):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_a_batch_counts_once_and_another_session_goes_on(spark, history, kept):
    again = state.FeatureState(spark, kept.folder)
    assert (again.buckets, again.batches) == (3, ["part 1", "part 0"])
    assert not again.add("part 0", history)
    assert rows_of(again.family("basic", ["loan_count"])) == rows_of(kept.family("basic", ["loan_count"]))
    assert "Exchange" not in again.family("dist", ["dlast_pre_util_3"])._jdf.queryExecution().executedPlan().toString()


def test_a_broken_merge_leaves_the_state_as_it_was(spark, history, tmp_path):
    s = state.FeatureState(spark, str(tmp_path), 2)
    s.add("a", history.where("rn < 5"))
    bad = history.withColumn("rn", F.when(F.col("id") > 3, F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("rn")))
    with pytest.raises(Exception, match="lost"):
        s.add("b", bad)
    again = state.FeatureState(spark, str(tmp_path))
    assert again.batches == s.batches == ["a"]
    assert rows_of(again.family("basic", ["loan_count"])) == rows_of(features.entity_counts(history.where("rn < 5")))


def test_empty_batches_and_an_empty_state(spark, history, tmp_path):
    s = state.FeatureState(spark, str(tmp_path), 2)
    with pytest.raises(ValueError, match="empty"):
        s.rows()
    s.add("nothing", history.limit(0))
    assert s.family("extra", ["xloan_count_check"]).collect() == []
    s.add("some", history.where("id = 3"))
    s.add("nothing again", history.limit(0))
    assert rows_of(s.family("seq")) == rows_of(features.sequence(history.where("id = 3")))


def test_tails_are_bounded(spark, history, kept):
    assert kept._tables[1].agg(F.max(F.size("tail"))).first()[0] == vocab.SEQUENCE_ROWS


@pytest.mark.parametrize("name", ["extra", "dist"])
def test_wide_families_are_made_of_packed_states(kept, name):
    made = kept.family(name, digits=6)
    by_sql = kept.family(name, made.columns[1:])
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (made, by_sql)]
    assert ["MapInArrow" in p for p in plans] == [True, False]
    want, got = rows_of(by_sql), rows_of(made)
    assert set(got) == set(want)
    for i, row in want.items():
        wrong = {c: (x, got[i][c]) for c, x in row.items() if abs(x - got[i][c]) > 5.0001e-7 or round(got[i][c], 6) != got[i][c]}
        assert not wrong, (i, wrong)


def test_a_batch_is_stored_as_one_value_of_each_entity(kept):
    assert kept._states().dtypes == [("id", "bigint"), ("state", "binary")]
    assert kept._states().selectExpr("max(length(state))").first()[0] < state._ROW.itemsize / 4


def test_rows_of_one_rn_lie_alike_whatever_the_order_of_batches(spark, history, tmp_path):
    tied = history.where("id < 6").withColumn("rn", F.expr("CAST(rn / 9 AS BIGINT)"))
    parts = [tied.where("pre_pterm % 2 = 0"), tied.where("pre_pterm % 2 <> 0"), history.where("id = 1").limit(2)]
    found = []
    for order in ((0, 1, 2), (2, 1, 0)):
        s = state.FeatureState(spark, str(tmp_path / str(order[0])), 2)
        for k in order:
            s.add(str(k), parts[k].repartition(3))
        assert s.rows().schema["tail"].dataType.elementType["rn"].dataType.simpleString() == "bigint"
        found.append({i: (r["n"], [x.rn for x in r["tail"]]) for i, r in rows_of(s.rows()).items()})
    assert found[0] == found[1]
