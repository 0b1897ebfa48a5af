import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.llm.topk_search import nra, top_k

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, every, k=5):
    use = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, v in use:
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in use if j != i and len(w) == len(v))[:k]
            out |= {(i, r, j, -s) for r, (s, j) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("seed, options", [(1, {}), (2, {"block": 64, "query_block": 3}), (3, {"block": 7})])
def test_against_brute_force(spark, seed, options):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)]  # many ties
    rows += [(2000, None), (2001, []), (2002, [1.0, None] + [0.0] * 4), (2003, [float("nan")] * 6), (2004, [float("inf")] * 6), (2010, [1.0] * 4), (2020, [2.0] * 4), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {tuple(r) for r in top_k(df, F.col("vec_id") % 10 == 0, **options).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == brute(rows, 10)


def test_fewer_candidates_than_k_and_empty(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.5, -1.0])]
    got = {tuple(r) for r in top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == {(0, 1, 1, 256 * 128 - 512 * 256)}
    assert top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") == 0).count() == 0


def test_repeated_rows_count_once_and_other_columns_do_not_matter(spark):
    df = spark.createDataFrame([(0, [1.0], 1), (1, [2.0], 2), (1, [2.0], 3)], "vec_id long, embedding array<double>, score int")
    assert [(r["vec_id"], r["score"]) for r in top_k(df, F.col("vec_id") == 0).collect()] == [(1, 256 * 512)]


def test_large_integers_are_exact():
    block = np.array([[2**40, 1], [2**40, 2], [-(2**40), 3]], np.int64)
    places, scores = nra(block, np.arange(3), np.array([[3, 1]], np.int64), np.array([99]), 2, np.array([-np.inf]))[0]
    assert dict(zip(places.tolist(), scores.tolist(), strict=True))[1] == 3 * 2**40 + 2


def test_reading_stops_early_where_one_vector_stands_out():
    rng = np.random.default_rng(1)
    block = rng.integers(-5, 5, (4000, 8))
    block[17] = 1000
    places, _ = nra(block, np.arange(4000), np.ones((1, 8), np.int64), np.array([-1]), 1, np.array([-np.inf]))[0]
    assert 17 in places and len(places) <= 4


def test_scores_beyond_64_bits_are_the_largest(spark):
    rows = [(0, [1e300, 1.0]), (1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [0.0, 2.0]), (4, [1e17, 0.0])]
    got = [(r["vec_id"], r["score"]) for r in top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(1, 2**63 - 1), (4, 2**63 - 1), (3, 512 * 256), (2, -(2**63))]


def test_reading_on_gives_the_scores(monkeypatch):
    rng = np.random.default_rng(2)
    block, queries = rng.integers(-9, 9, (500, 5)) * rng.integers(1, 200, (500, 1)), rng.integers(-9, 9, (30, 5))
    stopped = []
    found = nra(block, np.arange(500), queries, np.full(30, -1), 3, np.full(30, -np.inf), stopped)
    assert min(stopped) < 1
    for q, (places, scores) in zip(queries, found, strict=True):
        every = block @ q
        assert (every[places] == scores).all() and set(np.argsort(-every, kind="stable")[:3]) <= set(places)
