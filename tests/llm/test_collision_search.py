"""Recall against brute force, exact scores, and rows that take no part."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyscope.llm import collision_search as C


def brute(rows, asks, k):
    ok = {(i, tuple(v)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, qv in ok:
        if asks(q):
            found = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in ok if i != q and len(v) == len(qv))[:k]
            out.setdefault(q, []).extend((i, -s) for s, i in found)
    return out


def run(spark, rows, k=5, modulus=3):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, dims string").repartition(3)
    got = {}
    for r in C.nearest(df, F.col("vec_id") % modulus == 0, k).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    return got


def same(got, want):
    assert got.keys() == {q for q, v in want.items() if v}
    for q, found in got.items():
        assert [i for i, _ in found] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in found], [s for _, s in want[q]], rtol=0, atol=1e-12)


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6)]) for i in range(120)]
    rows += [(200 + i, rows[7][1]) for i in range(40)]  # copies: ties by id
    rows += [(300, None), (301, []), (302, [0.0] * 6), (303, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (306, [float("nan")] * 6), (309, [float("inf")] + [1.0] * 5)]
    rows += [(315, [1.0, 2.0]), (318, [2.0, 1.0]), (0, rows[0][1])]
    same(run(spark, rows), brute(rows, lambda i: i % 3 == 0, 5))


def test_blocks_are_merged(spark, monkeypatch):
    monkeypatch.setattr(C, "DATA_BLOCK", 30)
    monkeypatch.setattr(C, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(150)]
    same(run(spark, rows), brute(rows, lambda i: i % 3 == 0, 5))


def test_few_or_no_rows(spark):
    assert run(spark, []) == {}
    assert run(spark, [(3, [1.0, 2.0])]) == {}
    same(run(spark, [(3, [1.0, 2.0]), (4, [2.0, 2.0])]), {3: [(4, 6.0)]})


@pytest.mark.parametrize("spread", [False, True])
def test_recall_of_the_index(spread):
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((8000, 64))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    if spread:  # norms that differ, and clusters
        vectors = (vectors + 0.5 * vectors[rng.integers(0, 40, 8000)]) * rng.uniform(0.5, 1.5, (8000, 1))
    queries = vectors[:150]
    rows = C.search_block(np.arange(8000), vectors, np.arange(150), queries, 20)
    hits = 0
    scores = queries @ vectors.T
    scores[np.arange(150), np.arange(150)] = -9
    for q in range(150):
        hits += len({i for a, i, _ in rows if a == q} & set(np.argsort(-scores[q])[:20].tolist()))
    assert hits / 3000 >= 0.93
    index = C.CollisionIndex(vectors)
    sizes = [len(x) for x in index.candidates(queries[:20], 1200)]
    assert np.mean(sizes) < 0.35 * len(vectors)


def test_recall_over_the_table(spark):
    path = "/root/testdata/sf0.1"
    got = C.op1_collision_search(spark, path).collect()
    rows = spark.read.parquet(f"{path}/embeddings.parquet").collect()
    ids = np.array([r.vec_id for r in rows])
    matrix = np.array([r.embedding for r in rows], np.float64)
    by_query = {}
    for r in got:
        by_query.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = matrix @ matrix[q]
        s[q] = -np.inf
        want = ids[np.lexsort((ids, -s))[:20]]
        hits += len(by_query[ids[q]] & set(want.tolist()))
        total += 20
    assert hits / total >= 0.93
