"""Hard negatives against a plain version over all scores."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyscope.llm import hard_negatives as H

SCHEMA = "id bigint, label bigint, e array<double>"


def plain(rows, asks, k=5, m=5, window=(80, 100)):
    """Rows are (id, label, vector); the same as the operator, by brute force."""
    def usable(r):
        return r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])

    rows = sorted({(r[0], r[1], tuple(x + 0.0 for x in r[2])) for r in rows if usable(r)})
    out = []
    for a in rows:
        if not asks(a[0]):
            continue
        scored = [(-sum(int(x) * int(y) for x, y in zip(a[2], r[2], strict=True)), r[0], r[1]) for r in rows if len(r[2]) == len(a[2])]
        for p, pid, _ in sorted(s for s in scored if s[2] == a[1] and s[1] != a[0])[:k]:
            neg = sorted((s, i) for s, i, lab in scored if lab != a[1] and window[0] * -p <= 100 * -s <= window[1] * -p)[:m]
            out += [(a[0], pid, n + 1, i, -p, -s) for n, (s, i) in enumerate(neg)]
    return sorted(out)


def run(spark, rows, asks=10):
    got = H.hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("id") % asks == 0).collect()
    return sorted(tuple(r) for r in got)


@pytest.mark.parametrize("blocks", [(8192, 2048), (40, 7)])
def test_matches_brute_force_in_any_blocks(spark, monkeypatch, blocks):
    monkeypatch.setattr(H, "DATA_BLOCK", blocks[0])
    monkeypatch.setattr(H, "ANCHOR_BLOCK", blocks[1])
    rng = np.random.default_rng(blocks[0])
    centres = rng.normal(0, 40, (6, 5))
    # few directions: many ties, copies, and scores of both signs
    vectors = np.round(centres[rng.integers(0, 6, 260)] + rng.normal(0, 6, (260, 5)))
    rows = [(int(i), int(rng.integers(0, 3)), vectors[i if i % 4 else 0].tolist()) for i in range(260)]
    want = plain(rows, lambda i: i % 10 == 0)
    assert want and run(spark, rows) == want


def test_odd_rows(spark):
    rng = random.Random(1)
    rows = [(i, i % 2, [float(rng.randint(-3, 3)) for _ in range(3)]) for i in range(40)]
    rows += [(None, 1, [1.0, 1.0, 1.0]), (50, None, [1.0, 1.0, 1.0]), (51, 1, None), (52, 1, [1.0, None, 1.0]), (53, 1, [float("nan"), 1.0, 1.0])]
    rows += [(54, 1, [float("inf"), 1.0, 1.0]), (0, 0, rows[0][2]), (0, 0, [1.0, 2.0, 3.0]), (20, 1, [3.0, -0.0, 3.0]), (60, 0, [1.0, 2.0]), (61, 0, [2.0, 2.0]), (62, 1, [2.0, 1.0])]
    rows += [(70, 1, []), (71, 1, []), (72, 0, [])]
    assert run(spark, rows) == plain(rows, lambda i: i % 10 == 0)


def test_scores_beyond_doubles_are_exact(spark):
    big = float(1 << 31)
    rows = [(0, 1, [big, 1.0]), (1, 1, [big / 2, 1.0]), (2, 0, [big / 2, 0.0]), (3, 0, [big / 2, -3.0]), (4, 0, [1e30, 1.0]), (5, 1, [1e300, 1.0])]
    got = run(spark, rows)
    assert got == [(0, 1, 1, 2, (1 << 61) + 1, 1 << 61), (0, 1, 2, 3, (1 << 61) + 1, (1 << 61) - 3)]


def test_a_common_vector_and_ties(spark):
    rows = [(i, 0 if i < 300 else 1, [4.0, 4.0]) for i in range(600)] + [(1000, 0, [5.0, 4.0]), (1001, 1, [4.0, 4.0])]
    assert run(spark, rows, 100) == plain(rows, lambda i: i % 100 == 0)


def test_an_empty_table_and_clashing_names(spark):
    assert run(spark, []) == []
    rows = [(0, 1, [2.0], "x", 1), (1, 1, [2.0], "x", 1), (2, 0, [2.0], "x", 1)]
    df = spark.createDataFrame(rows, "id bigint, label bigint, e array<double>, a string, anchor int")
    assert [tuple(r) for r in H.hard_negatives(df, F.col("id") % 10 == 0).collect()] == [(0, 1, 1, 2, 4, 4)]


def test_spanning_tree_and_walk():
    v = np.random.default_rng(3).integers(-9, 9, (40, 3))
    parent, edge = H.spanning_tree(v)
    order, children = H.walk(parent)
    assert sorted(order.tolist()) == list(range(40)) and order[0] == 0 and children.sum() == 39
    place = {i: n for n, i in enumerate(order.tolist())}
    assert all(place[int(parent[i])] < place[i] and np.isclose(edge[i], np.linalg.norm(v[i] - v[parent[i]])) for i in range(1, 40))


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    scaled = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, [float(math.floor(256 * x)) for x in r.embedding]) for r in rows]
    got = sorted(tuple(r) for r in H.op12_hard_negatives(spark, sf).collect())
    assert got and got == plain(scaled, lambda i: i % 100 == 0)
