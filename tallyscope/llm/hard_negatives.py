"""Hard negatives by spanning-tree bounds over anchors.

Every row has a label and a vector of integers; a score is an inner product with
an anchor's vector. For each anchor the best rows of its own label are its
positives, and for each of those the best rows of other labels whose score lies
in a window below the positive's score are its hard negatives.

Anchors are dealt into blocks of near ones (by label and by a random projection)
and each block is joined by a minimum spanning tree of Euclidean distances, once.
Rows are dealt into blocks too, and every pair of blocks is one task's group. There
the tree is walked from its root. The root scores the whole block. Any other anchor
differs from its parent by a vector as long as their edge, so each row's score lies
within edge * norm of its score at the parent (bounds widen along the tree where
a score is not known exactly). Only rows whose bounds overlap what is wanted, the
best so far for positives and the window for negatives, are scored again. Bounds of
an anchor are kept until its last child is done; children with the larger subtree
come last, so at most log2 of the block's anchors are kept at once.

Rows with one label and one vector are one entry with its smallest ids, so many
copies of a vector cost as much as one. What a block finds is cut to the
contract's few before it is put out, and a window merges it by anchor.

Bounds are computed in floating point and widened by more than its error;
scores are exact: as doubles while no sum can reach 2^53, as Python integers
beyond.

Defined cases: rows without an id, a label or a vector, or with a null or
non-finite component take no part; rows equal in id, label and vector are one;
of several different rows of an id each counts by itself (each a candidate, and
an anchor if the id says so), but never as its own id's positive; a row meets
rows with vectors of its own length only; a score that is no 64-bit integer is no
match; ties go to the smaller id; fewer candidates than asked for are all
returned; extra columns are passed over; an empty table gives no row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyscope.llm.common import reliable, table
from tallyscope.operators.rowindex import with_row_index

#: Rows of a data block and anchors of a tree.
DATA_BLOCK, ANCHOR_BLOCK = 8192, 2048
#: Largest sum of products that doubles hold exactly.
EXACT = float(1 << 53)


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parent, edge length) of each vector in a minimum spanning tree; the root, the first, is its own parent."""
    v = vectors.astype(np.float64)
    n = len(v)
    parent, edge = np.zeros(n, np.int64), np.full(n, np.inf)
    outside = np.ones(n, bool)
    at, edge[0] = 0, 0.0
    for _ in range(n - 1):
        outside[at] = False
        with np.errstate(over="ignore"):
            away = np.sqrt(((v - v[at]) ** 2).sum(axis=1))
        closer = outside & (away < edge)
        parent[closer], edge[closer] = at, away[closer]
        at = int(np.argmin(np.where(outside, edge, np.inf)))
    return parent, edge


def walk(parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchors parents first, the child with the largest subtree last, and each one's number of children."""
    n = len(parent)
    children: list[list[int]] = [[] for _ in range(n)]
    for i in range(1, n):
        children[int(parent[i])].append(i)
    order, stack = [], [0]
    while stack:
        i = stack.pop()
        order.append(i)
        stack += children[i]
    size = np.ones(n, np.int64)
    for i in reversed(order):
        if i:
            size[parent[i]] += size[i]
    out, stack = [], [0]
    while stack:
        i = stack.pop()
        out.append(i)
        stack += sorted(children[i], key=lambda c: -size[c])  # the smallest is popped first
    return np.array(out), np.array([len(c) for c in children])


class Block:
    """The entries of a data block: a label, a vector and its smallest ids each."""

    def __init__(self, rows: pa.Table):
        self.labels = rows.column("label").to_numpy()
        self.vectors = matrix(rows)
        self.ids = rows.column("ids").combine_chunks()
        self.starts = self.ids.offsets.to_numpy()
        self.ids = self.ids.values.to_numpy()
        self.floats = self.vectors.astype(np.float64)
        with np.errstate(over="ignore"):
            self.norms = np.sqrt((self.floats**2).sum(axis=1))
        self.largest = float(np.abs(self.floats).max(initial=0.0))

    def scores(self, anchor: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Exact inner products of the entries ``of`` with an anchor."""
        if self.exact(anchor):
            return self.floats[of] @ anchor.astype(np.float64)
        return self.vectors[of].astype(object) @ anchor.astype(object)

    def exact(self, anchor: np.ndarray) -> bool:
        """Whether doubles hold every sum of products with an anchor."""
        return self.largest * float(np.abs(anchor.astype(np.float64)).max(initial=0.0)) * max(1, len(anchor)) < EXACT

    def rows(self, entries: np.ndarray, scores: np.ndarray, own: int | None, k: int) -> list[tuple[int, int]]:
        """(score, id) of the first k rows of some entries, best first."""
        found = [(-int(s), int(i)) for e, s in zip(entries.tolist(), scores.tolist(), strict=True) for i in self.ids[self.starts[e] : self.starts[e + 1]] if i != own]
        return [(-s, i) for s, i in sorted(found)[:k] if abs(s) < 1 << 63]


def matrix(rows: pa.Table) -> np.ndarray:
    """The vectors of some rows: integers in 64 bits, where they fit (Python's otherwise)."""
    lists = rows.column("e").combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    whole = flat.astype(np.int64) if np.abs(flat).max(initial=0.0) < 1 << 62 else np.array([int(x) for x in flat], object)
    return whole.reshape(rows.num_rows, -1)


def bounded(block: Block, anchors: pa.Table, wanted) -> list[tuple]:
    """Walk the anchors' tree over a block. ``wanted(i, low, high)`` says which entries to score
    exactly for anchor i, given bounds of its scores, and ``wanted.take(i, entries, scores)`` gives rows."""
    vectors = matrix(anchors)
    parent, edge = anchors.column("parent").to_numpy(), anchors.column("edge").to_numpy()
    order, children = walk(parent)
    kept: dict[int, list] = {}  # anchor: low, high, children to come
    out: list[tuple] = []
    everything = np.arange(len(block.labels))
    for i in order.tolist():
        if i == 0:
            low = high = _doubles(block.scores(vectors[0], everything))
            low, high = _looser(low, -1), _looser(high, 1)
            some = wanted(i, low, high)
        else:
            above = kept[int(parent[i])]
            with np.errstate(invalid="ignore", over="ignore"):
                reach = edge[i] * block.norms
                low, high = _looser(above[0] - reach, -1), _looser(above[1] + reach, 1)
            above[2] -= 1
            if not above[2]:
                del kept[int(parent[i])]
            some = wanted(i, low, high)
        scores = block.scores(vectors[i], some)
        out += wanted.take(i, some, scores)
        if children[i]:
            close = _doubles(scores)
            low[some], high[some] = _looser(close, -1), _looser(close, 1)
            kept[i] = [low, high, int(children[i])]
    return out


def _looser(x: np.ndarray, way: int) -> np.ndarray:
    """Bounds that rounding can't have passed; none where a magnitude is beyond doubles."""
    with np.errstate(invalid="ignore", over="ignore"):
        y = x + way * (np.abs(x) * 1e-9 + 1e-6)
    return np.where(np.isnan(y), way * np.inf, y)


def _doubles(scores: np.ndarray) -> np.ndarray:
    """Scores as doubles, infinite beyond them."""
    if scores.dtype != object:
        return scores
    return np.array([float(s) if abs(s) < 1 << 1023 else math.inf if s > 0 else -math.inf for s in scores])


class Positives:
    """The best rows of the anchor's own label."""

    def __init__(self, block: Block, anchors: pa.Table, k: int):
        self.block, self.k = block, k
        self.keys, self.own, self.labels = (anchors.column(c).to_numpy() for c in ("anchor", "id", "label"))
        sizes = np.diff(block.starts)
        self.only = np.where(sizes == 1, block.ids[np.minimum(block.starts[:-1], max(0, len(block.ids) - 1))], -1) if len(block.ids) else sizes
        self.single = sizes == 1

    def __call__(self, i: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        # an entry that holds nothing but the anchor's own id gives no row
        some = np.flatnonzero((self.block.labels == self.labels[i]) & ~(self.single & (self.only == self.own[i])))
        if len(some) <= self.k:
            return some
        least = np.partition(low[some], len(some) - self.k)[len(some) - self.k]
        return some[high[some] >= least]

    def take(self, i: int, entries: np.ndarray, scores: np.ndarray) -> list[tuple]:
        if len(entries) > self.k:
            edge = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            entries, scores = entries[scores >= edge], scores[scores >= edge]
        return [(int(self.keys[i]), s, row) for s, row in self.block.rows(entries, scores, int(self.own[i]), self.k)]


class Negatives:
    """For each positive of an anchor the best rows of other labels in the window below its score."""

    def __init__(self, block: Block, anchors: pa.Table, k: int, window: tuple[int, int]):
        self.block, self.k, self.window = block, k, window
        self.keys, self.labels = (anchors.column(c).to_numpy() for c in ("anchor", "label"))
        self.positives = [sorted(set(p), reverse=True) for p in anchors.column("positives").to_pylist()]

    def bounds(self, score: int) -> tuple[int, int]:
        """Least and largest integer score in the window of a positive's."""
        least, most = self.window
        return -((-least * score) // 100), (most * score) // 100

    def __call__(self, i: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        inside = np.zeros(len(low), bool)
        for score in self.positives[i]:
            least, most = self.bounds(score)
            if least <= most:
                inside |= (high >= least) & (low <= most)
        return np.flatnonzero(inside & (self.block.labels != self.labels[i]))

    def take(self, i: int, entries: np.ndarray, scores: np.ndarray) -> list[tuple]:
        order = np.argsort(-scores, kind="stable")
        entries, scores = entries[order], scores[order]
        falling = -scores
        out = []
        for positive in self.positives[i]:
            least, most = self.bounds(positive)
            a, b = int(np.searchsorted(falling, -most, "left")), int(np.searchsorted(falling, -least, "right"))
            if b - a > self.k:  # the first k entries, and those that tie with the last of them
                b = int(np.searchsorted(falling, falling[a + self.k - 1], "right"))
            out += [(int(self.keys[i]), positive, s, row) for s, row in self.block.rows(entries[a:b], scores[a:b], None, self.k)]
        return out


def _arrow(rows: list[tuple], names: list[str]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.table([pa.array(c, pa.int64()) for c in cols], names=names)


def usable(embedding: str) -> Column:
    """Vectors without a null or non-finite component."""
    bad = F.exists(F.col(embedding), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(embedding).isNotNull() & ~bad


def _entries(rows: DataFrame, k: int) -> DataFrame:
    """One row a label and vector, with its k smallest ids; a task ships k a vector at most."""
    first = Window.partitionBy("label", "e").orderBy("id")
    few = rows.select("label", "e", "id").distinct().withColumn("__n", F.row_number().over(first)).filter(F.col("__n") <= k)
    return few.groupBy("label", "e").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def _forest(anchors: DataFrame, n: int) -> DataFrame:
    """Anchors in blocks of near ones, each block with its spanning tree."""
    pull = F.aggregate(F.arrays_zip("e", F.transform("e", lambda x, i: F.sin((i + 1) * 1.7))), F.lit(0.0), lambda a, x: a + x.getField("e") * x.getField("1"))
    placed = with_row_index(anchors.withColumn("__pull", pull), ["dims", "label", "__pull"], "anchor", n_rows=n)

    def tree(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("anchor")
        parent, edge = spanning_tree(matrix(rows)) if rows.num_rows else (np.empty(0, np.int64), np.empty(0))
        return pa.table({c: rows.column(c) for c in ("anchor", "id", "label", "e", "dims", "a")} | {"parent": pa.array(parent), "edge": pa.array(edge)})

    block = F.floor(F.col("anchor") / ANCHOR_BLOCK).cast("int").alias("a")
    schema = "anchor bigint, id bigint, label bigint, e array<double>, dims int, a int, parent bigint, edge double"
    return placed.select("anchor", "id", "label", "e", "dims", block).groupBy("dims", "a").applyInArrow(tree, schema)


def hard_negatives(rows: DataFrame, anchor_rows: Column, positives: int = 5, negatives: int = 5, window: tuple[int, int] = (80, 100),
                   id_col: str = "id", label: str = "label", embedding: str = "e") -> DataFrame:
    """Hard negatives of the rows that ``anchor_rows`` holds for.

    ``rows`` have integral components (as doubles). ``window`` is the least and largest negative
    score in hundredths of the positive's. Returns anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score.
    """
    base = reliable(
        rows.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(embedding).cast("array<double>").alias("e"), anchor_rows.alias("asks"))
        .filter(F.col("id").isNotNull() & F.col("label").isNotNull() & usable("e"))
        .withColumn("e", F.transform("e", lambda x: x + F.lit(0.0)))  # no negative zero
        .dropDuplicates(["id", "label", "e"])
        .withColumn("dims", F.size("e"))
    )
    entries = reliable(_entries(base, max(positives, negatives) + 1))
    n, asking = entries.count(), base.filter("asks").count()
    d_blocks, a_blocks = max(1, -(-n // DATA_BLOCK)), max(1, -(-asking // ANCHOR_BLOCK))
    data = entries.select("label", "e", "ids", F.size("e").alias("dims"), F.pmod(F.xxhash64("label", "e"), F.lit(d_blocks)).cast("int").alias("d"),
                          F.explode(F.sequence(F.lit(0), F.lit(a_blocks - 1))).alias("a"))
    anchors = reliable(_forest(base.filter("asks"), asking))
    blocks = F.explode(F.sequence(F.lit(0), F.lit(d_blocks - 1))).alias("d")
    key = ["dims", "a", "d"]

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            block, right = Block(left), right.sort_by("anchor")
            found = bounded(block, right, Positives(block, right, positives))
        return _arrow(found, ["anchor", "score", "row"])

    def below(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            block, right = Block(left), right.sort_by("anchor")
            found = bounded(block, right, Negatives(block, right, negatives, window))
        return _arrow(found, ["anchor", "positive_score", "score", "row"])

    asked = anchors.select("*", blocks)
    first = Window.partitionBy("anchor").orderBy(F.desc("score"), "row")
    met = data.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(best, "anchor bigint, score bigint, row bigint")
    pairs = reliable(met.withColumn("__n", F.row_number().over(first)).filter(F.col("__n") <= positives)
                     .select("anchor", F.col("score").alias("positive_score"), F.col("row").alias("positive_id")))
    # five numbers an anchor; only anchors with a positive have negatives, yet the tree needs all
    scores = pairs.groupBy("anchor").agg(F.collect_list("positive_score").alias("positives"))
    asked = anchors.join(scores, "anchor", "left").withColumn("positives", F.coalesce("positives", F.array().cast("array<bigint>"))).select("*", blocks)
    met = data.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(below, "anchor bigint, positive_score bigint, score bigint, row bigint")
    first = Window.partitionBy("anchor", "positive_score").orderBy(F.desc("score"), "row")
    kept = met.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= negatives)
    return (
        pairs.join(kept, ["anchor", "positive_score"])
        .join(anchors.select("anchor", F.col("id").alias("anchor_id")), "anchor")
        .select("anchor_id", "positive_id", "rank", F.col("row").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every row of ``embeddings`` whose vec_id is divisible by 100."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    scaled = F.transform("embedding", lambda x: _floor(x.cast("double") * 256.0))
    return hard_negatives(rows.select(F.col("vec_id").alias("id"), moved.alias("label"), scaled.alias("e")), F.col("id") % 100 == 0)


def _floor(x: Column) -> Column:
    """Floor as a double, whatever the magnitude (beyond 2^53 doubles are whole; non-finite ones stay)."""
    return F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x)


#: The same in SQL: all scores of the anchors, ranked.
ORACLE = """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id AND len(a.e) = len(b.e)),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""
