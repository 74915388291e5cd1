"""Every query that has SQL gives the SQL's rows; the others give rows."""

from __future__ import annotations

import math

import duckdb
import pytest

from rowtide import queries as core

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value + 0.0:.9g}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(core.ORACLE))
def test_rows_are_the_sql_s(spark, duck, name):
    df = core.QUERIES[name](spark, SMALL)
    want = duck.execute(core.ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLE)))
def test_models_validate(spark, name):
    row = core.QUERIES[name](spark, "/root/testdata/sf0.01").first()
    assert row.valid
    assert row.rows == 300


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() == 150
    assert set(core.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
