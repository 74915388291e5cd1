"""Both vector searches against brute force."""

from __future__ import annotations

import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rowtide.llm import bit_slices, neighbours, queries, tiles

SCHEMA = "vec_id long, embedding array<float>, score string, rank string"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, "s", "r") for i, v in vectors], SCHEMA)


def made(seed, n=260, d=12):
    rng = random.Random(seed)
    out = [(i * 5, [rng.gauss(0, 1) for _ in range(d)]) for i in range(n)]
    out += [(10_001 + i, [0.5] * d) for i in range(30)]  # ties
    return out + [(20_000, None), (20_100, [float("nan")] * d), (20_200, [math.inf] + [0.0] * (d - 1)), (20_300, [None, *[1.0] * (d - 1)]), (20_400, [0.0] * d), (20_500, [1.0, 2.0]), (20_600, [2.0, 1.0]), (None, [1.0] * d), (20_700, [])]


def usable(vectors, zero):
    out = []
    for i, v in vectors:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v) or not zero and not any(v):
            continue
        out.append((i, np.array(v, np.float32).astype(float)))
    return out


def nearest(vectors, every, k):
    rows, out = usable(vectors, False), []
    for n, (i, q) in enumerate(rows):
        if i % every == 0:
            near = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(v, q, strict=True))), j) for m, (j, v) in enumerate(rows) if m != n and len(v) == len(q))[:k]
            out += [(i, rank, j, round(s, 9)) for rank, (s, j) in enumerate(near, 1)]
    return sorted(out)


def highest(vectors, every, k):
    rows, out = [(i, [math.floor(256 * x) for x in v]) for i, v in usable(vectors, True)], []
    for n, (i, q) in enumerate(rows):
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(v, q, strict=True)), j) for m, (j, v) in enumerate(rows) if m != n and len(v) == len(q))[:k]
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(best, 1)]
    return sorted(out)


def test_nearest_neighbours(spark):
    vectors = made(1)
    got = neighbours.nearest_neighbours(table(spark, vectors), F.col("vec_id") % 100 == 0, 10).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got) == nearest(vectors, 100, 10)


def test_top_products(spark):
    vectors = made(2)
    got = bit_slices.top_products(table(spark, vectors), F.col("vec_id") % 50 == 0, 5).collect()
    assert sorted(tuple(r) for r in got) == highest(vectors, 50, 5)


def test_many_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "ROW_BLOCK", 40)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 8)
    monkeypatch.setattr(bit_slices, "ROW_BLOCK", 40)
    monkeypatch.setattr(bit_slices, "QUERY_BLOCK", 8)
    vectors = made(3, 200)
    near = neighbours.nearest_neighbours(table(spark, vectors), F.col("vec_id") % 20 == 0, 10).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in near) == nearest(vectors, 20, 10)
    top = bit_slices.top_products(table(spark, vectors), F.col("vec_id") % 20 == 0, 5).collect()
    assert sorted(tuple(r) for r in top) == highest(vectors, 20, 5)


def test_few_rows_and_none(spark):
    for vectors in ([(100, [1.0, 2.0]), (101, [1.0, 3.0])], [(100, [1.0, 2.0])], []):
        near = neighbours.nearest_neighbours(table(spark, vectors), F.col("vec_id") % 100 == 0, 10).collect()
        assert sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in near) == nearest(vectors, 100, 10)
        top = bit_slices.top_products(table(spark, vectors), F.col("vec_id") % 50 == 0, 5).collect()
        assert sorted(tuple(r) for r in top) == highest(vectors, 50, 5)


def test_bit_slices_select_exactly():
    rng = np.random.default_rng(5)
    for most in (300, 2_000_000_000 // 3):
        values = rng.integers(-most, most, (500, 6))
        values[100:140] = values[0]
        index = bit_slices.BitSlicedIndex.of(values)
        for _ in range(30):
            query = rng.integers(-most, most, 6)
            own = int(rng.integers(0, 500))
            scores = values @ query
            want = sorted((i for i in range(500) if i != own), key=lambda i: (-scores[i], i))[:7]
            chosen, score = index.top(query, 7, own)
            assert sorted(chosen.tolist()) == sorted(want)
            assert score.tolist() == scores[chosen].tolist()


REPEATED = [(100, [1.0, 0.0]), (100, [1.0, 0.0]), (100, [1.5, 0.5]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (2, [3.0, 0.0]), (200, [-1.0, 0.25]), (50, [0.0, 0.0]), (None, [1.0, 1.0]), (300, None), (400, [float("nan"), 1.0]), (500, [None, 1.0]), (600, [1.0])]


@pytest.mark.parametrize("name", ["op5_nearest_neighbours", "op6_top_products"])
def test_repeated_ids_and_unusable_vectors_as_in_the_sql(spark, tmp_path, name):
    table(spark, REPEATED).select("vec_id", "embedding").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = con.execute(f"SELECT query_id, rank, vec_id, round(score, 9) FROM ({queries.ORACLE[name]})").fetchall()
    got = getattr(queries, name)(spark, str(tmp_path)).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got) == sorted(want)
    assert {r.vec_id for r in got if r.query_id == 100} >= {100, 1, 2}


def test_very_large_and_very_small_components(spark):
    vectors = [(100, [1e200, 0.0]), (1, [1e200, 1e190]), (2, [-1e200, 0.0]), (3, [1.0, 0.0]), (200, [2.0, 0.0]), (4, [1e-200, 0.0]), (300, [3e-200, 0.0]), (5, [1e308, 0.0]), (6, [-1e308, 1.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest_neighbours(df, F.col("vec_id") % 100 == 0, 10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for query, v in vectors:
        if query % 100 == 0:
            want = sorted((4 * math.hypot(*(a / 4 - b / 4 for a, b in zip(v, w, strict=True))), j) for j, w in vectors if j != query)
            assert [j for j, _ in got[query]] == [j for _, j in want]
            assert [s for _, s in got[query]] == pytest.approx([s for s, _ in want])
    top = bit_slices.top_products(df, F.col("vec_id") % 50 == 0, 5).collect()
    assert {r.vec_id for r in top} == {3, 4, 200, 300}  # the others' products fit no long


def test_bounds_hold_for_vectors_of_many_sizes():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 24)) * 10.0 ** rng.integers(-6, 7, (400, 1))
    x[50:300] = x[0] * (1 + 1e-7 * rng.normal(size=(250, 24)))  # a crowd that int8 cannot tell apart
    rows = pa.table({"row": np.arange(400), "vec_id": np.arange(400), "embedding": pa.array(list(x))})
    got = neighbours.nearest(10)(rows, rows).to_pandas()
    for i in range(0, 400, 7):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        assert sorted(got[got.query_row == i].score) == pytest.approx(sorted(d)[:10], rel=1e-9)


def test_a_common_vector_is_no_burden():
    x = np.ones((3000, 4))
    x[:10] = np.arange(40).reshape(10, 4)
    rows = pa.table({"row": np.arange(3000), "vec_id": np.arange(3000), "embedding": pa.array(list(x))})
    assert len(neighbours._few_of_equals(x, np.arange(3000), 11)) == 10 + 11
    got = neighbours.nearest(10)(rows, rows.slice(2000, 5)).to_pandas()
    assert got.groupby("query_row").vec_id.apply(list).tolist() == [list(range(10, 20))] * 5


def test_small_tables_are_cut_into_many_tiles(spark):
    df = table(spark, made(4, 2000))
    n = tiles.blocks(tiles.taking_part(df, F.col("vec_id") % 5 == 0), 4096, 16_384, 512)
    assert n.rows >= 3
    assert n.rows * n.queries >= tiles.LEAST_TILES
