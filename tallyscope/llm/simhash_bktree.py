"""Near-duplicates by SimHash: fingerprints within a few bits, found in BK-trees.

A document's fingerprint has bit i set if more than half of its shingles' hashes
have it set. Fingerprints are counted once each, however many documents share
one, and two link if they differ in at most ``RADIUS`` bits.

Two fingerprints within two bits agree on at least two of the four 16-bit
quarters, so each fingerprint goes to one shard for every pair of quarters (six
in all, keyed by 32 bits). A shard's fingerprints become a BK-tree: a child
hangs from its parent under their Hamming distance, and a search with radius r
from a node at distance d follows only the edges d - r to d + r. A fingerprint
is searched for in its shard's tree before it is inserted, and what is found is
united within the shard; the shard puts out one link a fingerprint, to the
smallest of its set, never all pairs.

The trees are handed to the fingerprints that need them by the shuffle on the
shard's key. They are not broadcast from the driver, which would have to
collect all fingerprints of the corpus first.

A shard above ``SHARD`` fingerprints is not one task's tree. Its members agree
on 32 bits, so two of them within two bits meet at a point one free bit from
both: each puts out itself and its 32 single-bit neighbours, at most 33 members
meet at any point, and all link to the smallest there. That is exact, linear in
the members, and leaves no group to a single task.

Components of links are found by alternating stars; a component is named after
the smallest doc_id of its fingerprints.

Defined cases: a null text is an empty one; a text without a word has
fingerprint zero and is linked like any other; with fewer words than a shingle
the whole sequence is the only one; repeated shingles count each time; a very
long text is hashed in blocks; equal rows and repeated ids are documents of
their own, with a row each; a null doc_id keeps its row and names no component
(null, if all of its component's ids are); extra columns are passed over; an
empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.llm.common import reliable, table
from tallyscope.llm.components import connected_components

#: Words of a shingle, differing bits that still link, and the seed of the hash.
SHINGLE, RADIUS, SEED = 3, 2, 42
#: Fingerprints of a shard that one BK-tree holds.
SHARD = 4096
#: Hashes whose bits are counted at once.
HASHES = 1 << 16
#: The six pairs of 16-bit quarters.
QUARTERS = [(a, b) for a in range(4) for b in range(a + 1, 4)]


def fingerprint(text: bytes | None) -> int:
    """The unsigned fingerprint of a text in UTF-8."""
    words = (text or b"").lower().split()  # bytes: A-Z only, and white space as the contract lists it
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - SHINGLE + 1)
    last = ends[min(SHINGLE, len(words)) - 1 :]
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for a in range(0, n, HASHES):
        part = zip(starts[a : min(n, a + HASHES)].tolist(), last[a : a + HASHES].tolist(), strict=False)
        hashes = np.array([digest(view[s:e], SEED) for s, e in part], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * counts > n).tolist())


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc`` and ``fp`` (signed, the same 64 bits) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py()) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(found)], names=["doc", "fp"])

    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc {kind}, fp bigint")


class BKTree:
    """Integers under their Hamming distance; children are keyed by the distance to their parent."""

    def __init__(self) -> None:
        self.root: list | None = None  # [value, position, {distance: node}]

    def add(self, value: int, position: int, radius: int) -> list[int]:
        """Insert ``value`` and return the positions of those within ``radius`` that were there before."""
        if self.root is None:
            self.root = [value, position, {}]
            return []
        found = self.within(value, radius)
        node = self.root
        while True:
            children = node[2]
            d = (node[0] ^ value).bit_count()
            if d not in children:
                children[d] = [value, position, {}]
                return found
            node = children[d]

    def within(self, value: int, radius: int) -> list[int]:
        """Positions of all values within ``radius``, by the edges that can lead to one."""
        found, stack = [], [self.root] if self.root else []
        while stack:
            other, position, children = stack.pop()
            d = (other ^ value).bit_count()
            if d <= radius:
                found.append(position)
            if len(children) > 2 * radius + 1:
                stack += [children[e] for e in range(d - radius, d + radius + 1) if e in children]
            else:
                stack += [child for e, child in children.items() if d - radius <= e <= d + radius]
        return found


def shard_links(values: list[int]) -> list[tuple[int, int]]:
    """(value, smallest of its set) for the values of a shard that are linked with others in it.

    ``values`` are different; sets are what chains of neighbours in the shard's tree unite.
    """
    tree, parent = BKTree(), list(range(len(values)))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, value in enumerate(values):
        for j in tree.add(value, i, RADIUS):
            parent[top(j)] = top(i)
    least: dict[int, int] = {}
    for i, value in enumerate(values):
        root = top(i)
        least[root] = min(value, least.get(root, value))
    return [(value, least[top(i)]) for i, value in enumerate(values) if least[top(i)] != value]


def _tree_links(members: DataFrame) -> DataFrame:
    """Links (a, b) of the shards in ``members`` (shard, bits, fp), each one tree of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(shard: list[int]) -> list[tuple[int, int]]:
            return shard_links([int(x) for x in np.array(shard, np.int64).view(np.uint64)]) if len(shard) > 1 else []

        def batch_of(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            both = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        key, shard, out = None, [], []
        for batch in batches:
            for *k, fp in zip(*(batch.column(c).to_pylist() for c in ("shard", "bits", "fp")), strict=True):
                if k != key:  # sorted by shard
                    out += links(shard)
                    key, shard = k, []
                    if len(out) >= 1 << 16:
                        yield batch_of(out)
                        out = []
                shard.append(fp)
        yield batch_of(out + links(shard))

    dealt = members.select("shard", "bits", "fp").repartition("shard", "bits").sortWithinPartitions("shard", "bits", "fp")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def _met_links(members: DataFrame) -> DataFrame:
    """Links of shards too large for a tree: neighbours meet one free bit from both."""
    bit = {i: [1 << b for b in range(64) if b // 16 not in pair] for i, pair in enumerate(QUARTERS)}
    signed = {i: [x - (1 << 64) if x >> 63 else x for x in bits] for i, bits in bit.items()}
    flips = F.when(F.col("shard") == 0, F.array(*[F.lit(x) for x in signed[0]]))
    for i in range(1, len(QUARTERS)):
        flips = flips.when(F.col("shard") == i, F.array(*[F.lit(x) for x in signed[i]]))
    points = members.select("fp", F.explode(F.concat(F.array(F.lit(0).cast("bigint")), flips)).alias("flip"))
    points = points.select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point")).distinct()
    met = points.groupBy("point").agg(F.collect_list("fp").alias("fps"))  # 65 at most: a point has 64 neighbours
    return met.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).filter("a <> b")


def near_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) that connect the same different fingerprints as all pairs within ``RADIUS`` bits."""
    part = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(0xFFFF) for i in range(4)]
    shards = F.array(*[F.struct(F.lit(i).alias("shard"), (F.shiftleft(part[a], 16).bitwiseOR(part[b])).alias("bits")) for i, (a, b) in enumerate(QUARTERS)])
    members = reliable(prints.select("fp", F.inline(shards)))
    sizes = members.groupBy("shard", "bits").agg(F.count("*").alias("n")).filter("n > 1")
    shared = reliable(members.join(sizes, ["shard", "bits"]))
    return _tree_links(shared.filter(F.col("n") <= SHARD)).unionAll(_met_links(shared.filter(F.col("n") > SHARD))).distinct()


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row of ``docs``."""
    rows = reliable(fingerprints(docs, text_col, id_col))
    prints = reliable(rows.groupBy("fp").agg(F.min("doc").alias("first"), F.count("*").alias("n")))
    found = connected_components(near_links(prints.select("fp")))
    linked = prints.join(found.withColumnRenamed("node", "fp"), "fp")
    names = linked.groupBy("component").agg(F.min("first").alias("name"))
    # most fingerprints are linked with none: they name themselves
    named = linked.join(names, "component").select("fp", "name")
    classes = prints.join(named, "fp", "left").select("fp", "n", F.coalesce("name", "first").alias("component_id"))
    return _with_class(rows, reliable(classes)).select(F.col("doc").alias(id_col), _hex("fp").alias("fingerprint"), "component_id")


def _hex(column: str) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def _with_class(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Each document's class. Fingerprints that hold a thousandth of all rows or more (a thousand
    at most) are broadcast, so that no task gets all copies of one text; the others are joined."""
    total = classes.agg(F.sum("n")).first()[0] or 0
    large = F.col("n") * 1000 >= total
    hot = F.broadcast(classes.filter(large).select("fp", F.col("component_id").alias("__hot"), F.lit(True).alias("__is_hot")))
    marked = rows.join(hot, "fp", "left")
    there = marked.filter("__is_hot").select("doc", "fp", F.col("__hot").alias("component_id"))
    rest = marked.filter("__is_hot is null").select("doc", "fp").join(classes.filter(~large).select("fp", "component_id"), "fp")
    return there.unionByName(rest)


def op13_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of ``documents`` and the components of those within two bits."""
    return near_duplicates(table(spark, sf_dir, "documents"))
