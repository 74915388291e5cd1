"""Tallies of entities equal plain counts, however rows are dealt and cut into batches."""

from __future__ import annotations

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowtide.functions import vocab
from rowtide.operators import features, tallies
from rowtide.sources import adapter

LAYOUT = tallies.Layout({"a": [0, 1, 3]}, ["a", "b"], [])


@pytest.fixture
def few_rows_at_once(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "3")
    yield
    spark.conf.set(key, before)


@pytest.mark.parametrize("dealt", [True, False])
def test_counts_and_moments(spark, few_rows_at_once, dealt):
    rows = [(i % 3 if i % 11 else None, i, i % 5 if i % 4 else None, i * 0.5 if i % 7 else None) for i in range(1, 40)] + [(9, 1, None, None)]
    table = spark.createDataFrame(rows, "id long, rn int, a int, b double").repartition(3, *(["id"] if dealt else ["rn"]))
    got = {r.id: r for r in tallies.by_entity(table, LAYOUT, dealt=dealt).collect()}
    assert set(got) == {0, 1, 2, 9}
    for i, r in got.items():
        own = sorted((x for x in rows if x[0] == i), key=lambda x: x[1])
        assert (r.rows, r.n) == (len(own), [sum(x[2] == v for x in own) for v in (0, 1, 3)])
        for m, place in zip(r.m, (2, 3), strict=True):
            values = [(x[1], x[place]) for x in own if x[place] is not None]
            if not values:
                assert tuple(m) == (0, None, None, None, None, None)
                continue
            plain = [v for _, v in values]
            assert (m.n, m.s, m.hi, m["at"], m["last"]) == (len(plain), sum(plain), max(plain), *values[-1])
            assert math.isclose(m.m2, statistics.pvariance(plain) * len(plain), abs_tol=1e-9)


def test_the_extra_family_is_one_tally_without_wide_aggregates(spark, few_rows_at_once):
    h = adapter.history(spark, "/root/testdata/sf0.001").where("id < 30")
    made = features.extra(h, dealt=True)
    assert "HashAggregate" not in made._jdf.queryExecution().executedPlan().toString()
    other = {r.id: r for r in features.extra(h.repartition(3)).collect()}
    for r in made.collect():
        assert all(math.isclose(x, y, abs_tol=1e-9) for x, y in zip(r, other[r.id], strict=True))
    assert len(other) == h.select("id").distinct().count()


def test_the_distribution_family_is_one_tally_and_equals_plain_counts(spark, few_rows_at_once):
    h = adapter.history(spark, "/root/testdata/sf0.001").where("id < 12 and (id <> 5 or rn < 3)")
    h = h.withColumn("pre_util", F.when(F.col("rn") % 3 != 0, F.col("pre_util")))
    made = features.distribution(h, dealt=True, digits=6, adjacent=True)
    assert "Aggregate" not in made._jdf.queryExecution().executedPlan().toString()
    rows, got = h.collect(), {r.id: r.asDict() for r in made.collect()}
    assert {i: r.asDict() for i, r in ((r.id, r) for r in features.distribution(h.repartition(3), digits=6).collect())} == got
    assert set(got) == {r.id for r in rows}
    for i, r in got.items():
        own = sorted((x for x in rows if x.id == i), key=lambda x: -x.rn)
        for c, codes in vocab.DIST_BUCKETS.items():
            for v in codes:
                n = sum(x[c] == v for x in own)
                assert (r[f"d_cnt_{c}_{v}"], r[f"dprop_{c}_{v}"], r[f"dlast_{c}_{v}"]) == (n, round(n / len(own), 6), own[0][c] == v)
                for k in vocab.DIST_RECENT_ROWS if c in vocab.DIST_RECENT else ():
                    assert r[f"dr{k}prop_{c}_{v}"] == round(sum(x[c] == v for x in own[:k]) / len(own[:k]), 6)
        for x, (left, _, right, _) in vocab.DIST_CROSSES.items():
            n = sum((y[left], y[right]) == (3, 2) for y in own)
            assert (r[f"dcross_{x}_32"], r[f"dcrossprop_{x}_32"]) == (n, round(n / len(own), 6))


def test_rounding_is_sparks(spark):
    odd = [0.0, -0.0, 1.0, -2.5e-7, 5e-7, 1.5e-6, 1 / 128, -3 / 128, 1.9140625, 2 / 3, 1e-300, 4503599627.3704965, -8589934592.1234565, 1e15 + 0.5, 1e300, float("inf")]
    odd += [k / 128 for k in range(300)] + [k * 1e-7 for k in range(300)] + np.random.default_rng(1).normal(0, 1e4, 300).tolist()
    want = [r[0] for r in spark.createDataFrame([(x,) for x in odd], "x double").selectExpr("round(x, 6)").collect()]
    assert tallies.half_up(np.array(odd), 6).tolist() == want


def test_wide_expressions_are_not_one_compiled_loop(spark):
    """A method of dozens of columns is longer than the JVM compiles."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = features.distribution(adapter.history(spark, "/root/testdata/sf0.001"), dealt=True, adjacent=True)._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    read = next(k for k, line in enumerate(plan) if "MapInArrow" in line)
    assert "Project" in plan[read + 1]
    assert "*(" not in plan[read + 1]
