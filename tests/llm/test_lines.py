"""Line dedup against a plain loop, and its runs."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from rowtide.llm import lines

NOISE = ["", " ", "short", "x" * 9, "y" * 10, "\t Padded Line Here \r", "padded line here", "PADDED LINE HERE\x0b", "Ärger mit Umlauten", "ärger mit umlauten", " not a space here", "ten chars!"]


def plain(rows, least=10):
    """(doc_id, kept, n_lines, n_dropped) of each row."""
    key = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s.strip(" \t\n\x0b\x0c\r"))
    order = lambda d: (1 << 63) - 1 if d is None else d
    first = defaultdict(lambda: 1 << 64)
    for d, text in rows:
        for s in (text or "").split("\n"):
            if len(key(s)) >= least:
                first[key(s)] = min(first[key(s)], order(d))
    out = []
    for d, text in rows:
        every = (text or "").split("\n")
        kept = [s for s in every if len(key(s)) < least or first[key(s)] >= order(d)]
        out.append((d, "\n".join(kept), len(every), len(every) - len(kept)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.row.doc_id, r.kept, r.n_lines, r.n_dropped) for r in df.collect()), key=str)


@pytest.mark.parametrize(("batches", "fan", "seed"), [(1, 2, 1), (4, 2, 2), (7, 3, 3)])
def test_lines_against_a_plain_loop(spark, documents, batches, fan, seed):
    rng = random.Random(seed)
    pool = [*NOISE, *(f"a line of its own number {i % 60}" for i in range(200))]
    rows = [(i * 3 % 101, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))) for i in range(90)]
    rows += [(5, None), (6, ""), (7, "\n\n"), (None, "a line of its own number 1\nalone without an id"), (None, "alone without an id"), (8, "\n".join(pool * 20)), (rows[0][0], rows[0][1]), (rows[0][0], rows[0][1])]
    assert got(lines.drop_repeated_lines(documents(rows), batches=batches, fan=fan)) == plain(rows)


def test_one_line_in_every_document(spark, documents, monkeypatch):
    """The common line's facts are broadcast."""
    monkeypatch.setattr("rowtide.llm.skew.COMMON_ROWS", 50)
    rows = [(i, f"All rights are reserved.\nown text of document {i}\n  ALL RIGHTS ARE RESERVED.") for i in range(300)]
    assert got(lines.drop_repeated_lines(documents(rows))) == plain(rows)


def test_runs_hold_each_hash_once_and_are_merged(spark, tmp_path):
    runs = lines.LineRuns(spark, str(tmp_path), fan=2, buckets=3)
    schema = "doc long, text_id long, pos int, h1 long, h2 long"
    seen = 0
    for b in range(5):
        keys = [(b * 10 + i, 0, 0, h, h) for i, h in enumerate(range(b * 5, b * 5 + 10))]
        dropped = runs.add(spark.createDataFrame(keys, schema))
        assert sorted(r.doc for r in dropped.collect()) == ([] if b == 0 else [b * 10 + i for i in range(5)])
        seen += 10 if b == 0 else 5
        held = [r.h1 for name in runs.runs() for r in spark.table(name).collect()]
        assert sorted(held) == list(range(seen))
    assert {level: len(x) for level, x in runs.levels.items() if x} == {0: 1, 2: 1}
    names = runs.runs()
    runs.close()
    assert not any(spark.catalog.tableExists(x) for x in names)


def test_runs_are_joined_where_they_lie(spark, tmp_path):
    """A batch that is grouped by hash meets a run without an exchange of the run."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        runs = lines.LineRuns(spark, str(tmp_path))
        runs.add(spark.range(50).selectExpr("id as doc", "id as text_id", "0 as pos", "id as h1", "id as h2"))
        one = spark.range(90).selectExpr("id as h1", "id as h2").groupBy(*lines.HASH).count()
        plan = one.join(spark.table(runs.runs()[0]), list(lines.HASH), "left_anti")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1
        runs.close()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_empty_table(spark, documents):
    assert lines.drop_repeated_lines(documents([])).count() == 0


def test_clashing_columns_stay(spark):
    rows = spark.createDataFrame([(1, "the same line here", "a"), (2, "the same line here", "b")], "doc_id long, text string, kept string")
    rows = rows.selectExpr("*", "1 as doc", "2 as text_id", "3 as places", "4 as pos", "5 as h1", "6 as batch", "7 as `row`", "8 as n_lines")
    out = {r.row.doc_id: r for r in lines.drop_repeated_lines(rows).collect()}
    assert (out[1].kept, out[2].kept, out[2].n_dropped) == ("the same line here", "", 1)
    assert (out[2].row.kept, out[2].row.n_lines, out[2].row.row) == ("b", 8, 7)
