"""The history of the order tables: its rows, and how they travel."""

from __future__ import annotations

import pytest

from rowtide.operators import features
from rowtide.sources import adapter

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("make", [adapter.history, adapter.kept_history])
def test_rows_are_those_of_the_sql(spark, make):
    want = spark.sql(adapter.HISTORY_SQL, lineitem=spark.read.parquet(f"{SMALL}/lineitem.parquet"), orders=spark.read.parquet(f"{SMALL}/orders.parquet"))
    got = make(spark, SMALL)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_rows_travel_narrow_and_once(spark):
    for df in (features.by_entity(adapter.history(spark, SMALL), features.counts({"pre_util": range(20)}, "cnt")), features.tall_counts(adapter.history(spark, SMALL), {"pre_util": range(20)})):
        by_id = [line for line in plan(df).splitlines() if "Exchange hashpartitioning(id" in line or "Exchange hashpartitioning(o_custkey" in line]
        assert len(by_id) == 1
        assert "REPARTITION_BY_NUM" in by_id[0]


def test_a_kept_history_lies_by_id(spark):
    df = features.by_entity(adapter.kept_history(spark, SMALL), features.column_stats(["pre_util"]))
    assert "Exchange" not in plan(df)
