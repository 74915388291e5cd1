"""Feature families on small histories: nulls, short histories, unknown codes, widths."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rowtide.functions import vocab
from rowtide.operators import features

COLUMNS = "id long, rn int, pre_util int, enc_loans_credit_status int, enc_loans_credit_type int, extra_column string"
ROWS = [
    (1, 1, 3, 2, 7, "a"),  # one row only
    (2, 1, 5, 1, 0, "a"), (2, 2, None, None, 1, "a"),  # null in the latest row
    (3, 1, 400, 99, 1, None), (3, 2, -7, 6, None, None), (3, 3, 19, 0, 7, None),  # unknown codes, values out of range
    (4, 1, None, None, None, "a"), (4, 2, None, None, None, "a"),
    (None, 1, 1, 1, 1, "a"),
]


@pytest.fixture(scope="module")
def history(spark):
    return spark.createDataFrame(ROWS, COLUMNS)


def by_id(df):
    return {r.id: r.asDict() for r in df.collect()}


def test_statistics_skip_nulls(history):
    got = by_id(features.by_entity(history, features.column_stats(["pre_util"])))
    assert set(got) == {1, 2, 3, 4}
    assert got[1] == {"id": 1, "pre_util_mean": 3, "pre_util_max": 3, "pre_util_std": 0, "pre_util_last": 3}
    assert got[2]["pre_util_last"] == 5  # the latest that is not null
    assert all(v == 0 for k, v in got[4].items() if k != "id")


def test_bucket_counts_leave_out_unknown_codes(history):
    buckets = {"enc_loans_credit_status": range(7)}
    got = by_id(features.by_entity(history, [*features.counts(buckets, "cnt"), *features.counts(buckets, "share", features.ROWS)]))
    assert sum(v for k, v in got[3].items() if k.startswith("cnt")) == 2
    assert sum(v for k, v in got[3].items() if k.startswith("share")) == pytest.approx(2 / 3)  # the unknown code counts below the line
    assert got[2]["cnt_enc_loans_credit_status_1"] == 1
    assert sum(v for k, v in got[4].items() if k.startswith("cnt")) == 0


def test_tall_counts_are_the_wide_ones(history):
    buckets = {"enc_loans_credit_status": range(7), "pre_util": range(20)}
    wide = by_id(features.by_entity(history, features.counts(buckets, "cnt")))
    tall = {(r.id, f"cnt_{r['column']}_{r.bucket}"): r.n for r in features.tall_counts(history, buckets).collect()}
    assert tall == {(i, k): v for i, r in wide.items() for k, v in r.items() if k != "id" and v}


def test_sequence_positions_and_changes(history):
    got = by_id(features.sequence(history, ["pre_util", "enc_loans_credit_status"], 3))
    assert [got[1][f"seq{p}_pre_util"] for p in range(3)] == [3, 255, 255]
    assert got[1]["seq_delta0_1_util"] == 0  # 3 - 255 + 128, clipped
    assert got[2]["seq0_pre_util"] == 255  # null
    assert [got[3][f"seq{p}_pre_util"] for p in range(3)] == [19, 0, 255]  # -7 and 400, clipped
    assert got[3]["seq_delta0_1_util"] == 147


def test_sequence_leaves_out_what_is_older(spark):
    rows = [(7, n, n, 0, 0, "") for n in range(1, 16)]
    got = features.sequence(spark.createDataFrame(rows, COLUMNS), ["pre_util"]).first()
    assert [got[f"seq{p}_pre_util"] for p in range(14)] == list(range(15, 1, -1))


def test_recent_shares_and_last_codes(history):
    latest = features.latest(history, 7)
    got = by_id(latest.groupBy("id").agg(*features.recent_shares(["enc_loans_credit_status"], (3,)), *features.last_one_hot({"enc_loans_credit_status": range(7)})))
    assert got[2]["dr3prop_enc_loans_credit_status_1"] == 0.5  # two rows, not three
    assert sum(v for k, v in got[2].items() if k.startswith("dlast")) == 0  # the very last row has no code
    assert got[3]["dlast_enc_loans_credit_status_0"] == 1


def test_recent_statistics(history):
    got = by_id(features.recent_stats(history, ["pre_util"], (2,)))
    assert (got[3]["xrecent2_pre_util_mean"], got[3]["xrecent2_pre_util_max"], got[3]["xrecent2_pre_util_min"]) == (6, 19, -7)
    assert got[2]["xrecent2_pre_util_mean"] == 5


def test_payments_with_nulls(spark):
    names = ["id", "rn", *vocab.PAYMENTS]
    df = spark.createDataFrame([(1, 1, None, 1, *[0] * 23), (2, 1, *[None] * 25)], ", ".join(f"{c} int" for c in names))
    got = by_id(features.by_entity(df, [*features.payment_counts(), *features.payment_summary()]))
    assert got[1]["paym_nonzero_count"] == 2  # a null is not zero
    assert got[1]["paym_status_0_count"] == 23
    assert got[1]["paym_mean_all"] == pytest.approx(1 / 24)
    assert (got[2]["paym_nonzero_count"], got[2]["paym_mean_all"], got[2]["paym_max_all"]) == (25, 0, 0)


def test_widths_of_the_families(spark):
    from rowtide.sources import adapter

    h = adapter.history(spark, "/root/testdata/sf0.001")
    assert {k: len(f(h).columns) - 1 for k, f in features.FAMILIES.items()} == {"basic": 469, "extra": 1066, "seq": 843, "dist": 1998}


def test_empty_history(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert features.by_entity(empty, features.column_stats(["pre_util"])).collect() == []
    assert features.sequence(empty, ["pre_util"], 3).collect() == []
    assert features.tall_counts(empty, {"pre_util": range(3)}).collect() == []


def test_aggregations_in_parts_are_the_whole_one(spark, history):
    columns = features.column_stats(["pre_util", "enc_loans_credit_status", "enc_loans_credit_type"])
    whole, parts = features.by_entity(history, columns), features.by_entity(history, columns, 5)
    assert parts.columns == whole.columns
    assert by_id(parts) == by_id(whole)
    plan = parts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [id") == 3


def test_effect_sizes_compile_one_projection(spark):
    from rowtide.operators import scoring

    names = [f"x{k}" for k in range(150)]
    rows = spark.createDataFrame([(k, k % 2, *[float(k * j % 7) for j in range(150)]) for k in range(20)], ["id", "flag", *names])
    scores = scoring.effect_sizes(rows)
    assert "Expand" not in scores._jdf.queryExecution().executedPlan().toString()
    assert {r.feature for r in scores.collect()} == set(names)
