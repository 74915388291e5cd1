"""What is cut in the shared folder leaves nothing behind it."""

from __future__ import annotations

import os
import time

from pyspark.sql import functions as F

from rowtide.sources.shared import cut, scratch, stored


def shuffle_files(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
    names = set()
    while files.hasNext():
        names.add(files.next().getName())
    return {n for n in names if n.startswith("shuffle_")}


def test_shuffle_files_go_when_their_table_is_cut(spark):
    counts = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    counts.collect()
    before = shuffle_files(spark)
    assert before
    kept = cut(counts)
    assert shuffle_files(spark) <= before
    assert {r["k"]: r["count"] for r in kept.collect()} == {k: 143 if k < 6 else 142 for k in range(7)}
    # what was planned before is still there, or made again
    assert counts.count() == 7


def test_stored_tables_are_read_by_few_tasks_and_go_with_their_scratch(spark, tmp_path):
    counts = spark.range(5000).repartition(97, "id").groupBy((F.col("id") % 7).alias("k")).count()
    with scratch(spark) as kept:
        before = shuffle_files(spark)
        many = stored(spark.range(5000).repartition(97, "id"))
        one, other = stored(counts), stored(counts)
        for _ in range(100):
            if shuffle_files(spark) <= before:
                break
            time.sleep(0.1)
        assert shuffle_files(spark) <= before
        # a table of 97 files, and a join with a table known to be small
        assert many.rdd.getNumPartitions() < 97
        assert "Exchange hashpartitioning" not in many.join(one, many.id == one.k)._jdf.queryExecution().executedPlan().toString()
        kept.append(one)
        gone = other.inputFiles()[0].removeprefix("file://")
    assert sum(r["count"] for r in one.collect()) == 5000
    assert not os.path.exists(gone)
