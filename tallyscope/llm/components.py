"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.llm.common import reliable

#: Links that one task handles in a round, whatever the session's partitions.
LINKS_A_TASK = 100_000
#: Links (16 bytes each) that one task unites by itself: so many are left after some rounds, or were no more at first.
LAST_LINKS = 500_000
#: Rounds after which a run gives up; each halves the depth of the trees at least.
MAX_ROUNDS = 60


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every node of the links (u, v) and the smallest node it is united with; the smaller root stays."""
    pairs = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    u, v = (np.concatenate([np.empty(0, np.int64), *x]) for x in (list(zip(*pairs, strict=True)) or [(), ()]))
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    parent = list(range(len(nodes)))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in zip(place[: len(u)].tolist(), place[len(u) :].tolist(), strict=True):
        a, b = top(a), top(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    roots = np.array([top(i) for i in range(len(nodes))], np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[roots] if len(nodes) else nodes)], names=["node", "component"])


def connected_components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest reachable node) of every node of ``links`` (a, b).

    Large star: every larger neighbour of a node moves to the node's smallest
    neighbour. Small star: every smaller neighbour does. Both are one aggregate
    (with map-side combine) and one join, which splits a hot hub. Rounds end
    when the links stay as they are, which is compared by count and hash sum.
    Each round is checkpointed in the shared folder, in as many parts as the links
    need; no links come to the driver. Once ``LAST_LINKS`` or fewer are left, one
    task unites them, which spares the driver the plans of further rounds.
    """
    edges = reliable(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    before = None
    for _ in range(MAX_ROUNDS):
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] <= LAST_LINKS:
            return reliable(edges.coalesce(1).mapInArrow(_united, "node long, component long"))
        if tuple(state) == before:
            break
        before = tuple(state)
        tasks = 1 + state[0] // LINKS_A_TASK
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(tasks)
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = reliable(large.coalesce(tasks).distinct().coalesce(tasks))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = reliable(small.unionAll(low.select("u", F.col("m").alias("v"))).coalesce(tasks).distinct().coalesce(tasks))
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    ).distinct()
