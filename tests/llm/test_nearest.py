import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nimbusops.llm import nearest


def brute(rows, k, scale=64):
    good = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in {i for i, _ in good if i % 20 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for x, v in good if x == q for i, w in good if i != q and len(w) == len(v))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def rows():
    rng = np.random.default_rng(1)
    some = [(i, rng.normal(size=6).tolist()) for i in range(300)]
    some += [(1000 + i, [0.5] * 6) for i in range(60)]  # ties beyond k
    some += [(20, [3.0] * 6), (20, [3.0] * 6), (40, [0.25, -1.0, 2.0, 0.0, 0.0, 1.0]), (7, [9.0] * 6), (7, [9.0] * 6)]  # repeated ids
    some += [(2000, None), (2020, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2040, [float("nan")] * 6), (2060, [float("inf")] + [0.0] * 5), (2080, [0.0] * 6),
             (None, [1.0] * 6), (3000, [1.0, 2.0]), (3001, [3.0, -1.0]), (3020, [1.0] * 3), (2100, [-100.0] * 6)]
    return some


@pytest.mark.parametrize("options", [{}, {"block": 50, "query_block": 4}, {"cells": 2}, {"cells": 256, "block": 7}])
def test_against_all_pairs(spark, options):
    data = rows()
    table = spark.createDataFrame([(i, v, "x") for i, v in data], "vec_id long, embedding array<double>, rank string")
    got = [tuple(r) for r in nearest.top_k(table, F.col("vec_id") % 20 == 0, k=20, **options).collect()]
    assert sorted(got) == brute(data, 20)


def test_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert nearest.top_k(spark.createDataFrame([], schema), F.col("vec_id") % 20 == 0).count() == 0
    assert nearest.top_k(spark.createDataFrame([(20, [1.0])], schema), F.col("vec_id") % 20 == 0).count() == 0
    assert [tuple(r) for r in nearest.top_k(spark.createDataFrame([(20, [1.0]), (1, [0.5])], schema), F.col("vec_id") % 20 == 0).collect()] == [
        (20, 1, 1, 64 * 32)]


def test_repeated_ids_and_clashing_names(spark):
    """Two vectors under one query id: the scores of both are ranked together, whatever the order of rows."""
    data = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [0.5, 0.25]), (2, [0.25, 0.5]), (3, [0.0, 0.0])]
    for order in (data, data[::-1]):
        table = spark.createDataFrame([(i, v, 1, 2, 3, "x", 5) for i, v in order], "vec_id long, embedding array<float>, row int, q int, b int, v string, length int")
        got = sorted(tuple(r) for r in nearest.top_k(table, F.col("vec_id") % 20 == 0).collect())
        assert got == brute(data, 20) and len(got) == 6


def test_only_candidates_are_read(spark):
    """Exact vectors that leave the table of integers are those that bounds could not rule out."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(2000, 8)).round(3)
    v[:100] *= 20
    ints = np.floor(v * 64).astype(np.int64)
    codes, edges = nearest.approximate(ints)
    ids = np.arange(2000)
    for j, best, near, most in nearest.scan(ids[:50], ints[:50], ids, codes, edges, 20):
        exact = ints @ ints[j]
        assert (np.sort(exact[ids != j])[-20:] >= np.sort(best)).all() and len(near) < 300
        assert set(np.lexsort((ids, -exact))[:21]) - {j} <= set(near.tolist()) | {j} and (most >= exact[near]).all()


def test_cells_hold_their_values():
    v = np.random.default_rng(0).integers(-50, 50, (500, 5))
    codes, edges = nearest.approximate(v, 16)
    at = np.arange(5)
    assert (edges[0][codes, at] <= v).all() and (edges[1][codes, at] >= v).all() and codes.max() < 16
