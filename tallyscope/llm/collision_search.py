"""Nearest neighbours by inner product through collision-counting hashing.

Vectors are dealt into data blocks, queries into query blocks, and every pair
of blocks is searched by itself; a query's best of all data blocks are merged
by a window, of which each task keeps the first k. Each data block builds its
own index and each block pair is one task, so an executor's loss costs one.

Inside a block, inner products become distances by one further coordinate
(sqrt(M^2 - |v|^2), M the block's largest norm, the query scaled to M). Each of
``PROJECTIONS`` random directions has one sorted array of projected vectors. A
query opens a window around its own projection in every array; vectors found
collide. Virtual rehashing widens all windows by a factor. As soon as the vectors with at least the threshold of
collisions are as many as must be verified, they are, exactly and in double
precision; a window that has grown over the whole array ends the search too.

Equal vectors of a block are one entry with its k + 1 smallest ids, which is
all that k nearest can need, so a group of copies costs its size once.

Recall against brute force: 0.95 and more at the parameters below (tests, README).

Defined cases: vectors that are null, empty, zero, or hold a null or a
non-finite number take no part, nor do rows without an id; a query meets
vectors of its own length only; a repeated row (id and vector) is one row; rows
with a query's own id are not its candidates; ties go to the smaller id; fewer
candidates than k are all returned; extra columns are passed over; an empty
table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyscope.llm.common import reliable, table

#: Sorted arrays, the share of them a vector must collide in, the first half window
#: (in units of M), the factor of a widening, and the share of a block to verify.
PROJECTIONS, THRESHOLD, HALF_WINDOW, WIDER, VERIFIED = 128, 0.62, 0.9, 1.08, 0.15
#: Fewest vectors that a query verifies in a block.
LEAST_VERIFIED = 1000
#: Rows of a data block and of a query block.
DATA_BLOCK, QUERY_BLOCK = 8192, 4096


class CollisionIndex:
    """The sorted projections of one block of distinct vectors."""

    def __init__(self, vectors: np.ndarray, seed: int = 11):
        self.vectors = vectors
        norms = np.sqrt((vectors * vectors).sum(axis=1))
        self.largest = norms.max()
        rest = np.sqrt(np.maximum(0, self.largest**2 - norms**2))
        self.directions = np.random.default_rng(seed).standard_normal((vectors.shape[1] + 1, PROJECTIONS))
        projected = np.ascontiguousarray((np.column_stack([vectors, rest]) @ self.directions).T)
        order = np.argsort(projected, axis=1)
        self.sorted = np.take_along_axis(projected, order, axis=1)
        # where each vector stands in each array: it collides if that lies in the window
        self.places = np.empty(order.shape, np.uint16 if len(vectors) <= 1 << 16 else np.uint32)
        np.put_along_axis(self.places, order, np.arange(len(vectors), dtype=self.places.dtype)[None, :], axis=1)

    def collisions(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """In how many arrays each vector stands within the window [low, high) of places."""
        kind = self.places.dtype
        first = low.astype(kind)[:, None]
        width = (high - low).clip(max=np.iinfo(kind).max).astype(kind)[:, None]
        counts = np.zeros(self.places.shape[1], np.uint8 if PROJECTIONS < 256 else np.uint32)
        for a in range(0, PROJECTIONS, 16):  # so many arrays stay in the cache
            part = slice(a, a + 16)
            # unsigned: a place before the window wraps round to a large number
            inside = (self.places[part] - first[part]) < width[part]
            counts += np.add.reduce(inside.view(np.uint8), axis=0, dtype=np.uint8)
        return counts

    def candidates(self, queries: np.ndarray, least: int) -> list[np.ndarray]:
        """For each query the vectors with enough collisions, once they are ``least`` or windows cover all."""
        n = len(self.vectors)
        if n <= least:
            return [np.arange(n)] * len(queries)
        norms = np.sqrt((queries * queries).sum(axis=1, keepdims=True))
        centres = (queries * (self.largest / norms)) @ self.directions[:-1]
        need = int(np.ceil(THRESHOLD * PROJECTIONS))
        found: list[np.ndarray] = [np.empty(0, np.int64)] * len(queries)
        asking = np.arange(len(queries))
        half = HALF_WINDOW * self.largest
        while len(asking):
            at = centres[asking]
            low = np.column_stack([np.searchsorted(s, c - half, "left") for s, c in zip(self.sorted, at.T, strict=True)])
            high = np.column_stack([np.searchsorted(s, c + half, "right") for s, c in zip(self.sorted, at.T, strict=True)])
            still = np.ones(len(asking), bool)
            for i, q in enumerate(asking.tolist()):
                enough = np.flatnonzero(self.collisions(low[i], high[i]) >= need)
                if len(enough) >= least or (high[i] - low[i]).min() == n:
                    found[q], still[i] = enough, False
            asking = asking[still]
            half *= WIDER
        return found

    def search(self, queries: np.ndarray, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Candidates of each query and their exact inner products."""
        out = []
        for a in range(0, len(queries), 256):
            part = queries[a : a + 256]
            for query, found in zip(part, self.candidates(part, least), strict=True):
                out.append((found, (self.vectors[found] * query).sum(axis=1)))
        return out


def search_block(vec_ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query, vector, score) of each query's best in one block: its k first and all ties with smaller ids."""
    order = np.argsort(vec_ids, kind="stable")
    vec_ids, vectors = vec_ids[order], vectors[order]
    distinct, entry = np.unique(vectors, axis=0, return_inverse=True)
    entry = entry.ravel()
    by_entry = np.argsort(entry, kind="stable")
    starts = np.searchsorted(entry[by_entry], np.arange(len(distinct) + 1))
    members = vec_ids[by_entry]
    index = CollisionIndex(distinct)
    least = max(LEAST_VERIFIED, 2 * k, int(np.ceil(VERIFIED * len(distinct))))
    out = []
    for query_id, (found, scores) in zip(query_ids.tolist(), index.search(queries, least), strict=True):
        if len(found) > k + 1:
            edge = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
            keep = scores >= edge
            found, scores = found[keep], scores[keep]
        rows = [(-s, int(i)) for e, s in zip(found.tolist(), scores.tolist(), strict=True) for i in members[starts[e] : min(starts[e + 1], starts[e] + k + 1)] if i != query_id]
        out += [(query_id, i, -s) for s, i in sorted(rows)[:k]]
    return out


def usable(embedding: str) -> Column:
    """Vectors that have a place: not null or empty, all finite, not all zero."""
    e = F.col(embedding)
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return e.isNotNull() & (F.size(e) > 0) & ~bad & F.exists(e, lambda x: x != 0)


def nearest(vectors: DataFrame, query_rows: Column, k: int = 20, id_col: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the k nearest of each query row."""
    base = reliable(
        vectors.select(F.col(id_col).cast("long").alias("vec"), F.col(embedding).cast("array<double>").alias("e"), query_rows.alias("asks"))
        .filter(F.col("vec").isNotNull() & usable("e"))
        .dropDuplicates(["vec", "e"])
        .withColumn("dims", F.size("e"))
    )
    n, asking = base.agg(F.count("*"), F.sum(F.col("asks").cast("long"))).first()
    data_blocks = max(1, -(-n // DATA_BLOCK))
    query_blocks = max(1, -(-(asking or 0) // QUERY_BLOCK))
    place = F.pmod(F.xxhash64("vec"), F.lit(data_blocks)).cast("int")
    turn = F.pmod(F.xxhash64("vec"), F.lit(query_blocks)).cast("int")
    data = base.select("vec", "e", "dims", place.alias("d"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("q"))
    asked = base.filter("asks").select("vec", "e", "dims", F.explode(F.sequence(F.lit(0), F.lit(data_blocks - 1))).alias("d"), turn.alias("q"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple[int, int, float]] = []
        if left.num_rows and right.num_rows:
            dims = left.column("dims")[0].as_py()

            def matrix(t: pa.Table) -> np.ndarray:
                return t.column("e").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)

            rows = search_block(left.column("vec").to_numpy(), matrix(left), right.column("vec").to_numpy(), matrix(right), k)
        cols = list(zip(*rows, strict=True)) if rows else [()] * 3
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    key = ["dims", "d", "q"]
    found = data.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_collision_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest in ``embeddings`` of every row whose vec_id is divisible by 20."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
