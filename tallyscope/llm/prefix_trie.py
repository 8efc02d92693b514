"""Prefix trie of conversations in adaptive radix trees.

A turn (role, text) becomes a 16-byte id, its MD5 as a big-endian number, and a
conversation the key of its turns' ids. Keys are cut into segments of ``SEGMENT``
turns, so that a conversation of any length is many short keys. Where a segment
hangs is told by a fingerprint of all turns before it: the XOR of 128-bit hashes
of (place, id), which segments can add up in any order and place, so no task
walks a whole conversation. Segments are sorted by (level, fingerprint, key) and
dealt by ranges; each task builds one adaptive radix tree for each run of segments
that hang from one node, emits the nodes at turn-aligned depths only, and drops it.
A node that several tasks have part of is merged by its fingerprint.

The trees have nodes for up to 4, 16, 48 and 256 children that grow from one
layout into the next, and paths without a branch are compressed into their lower
node; a key may end at any node, as keys may be prefixes of others.

Sums over a subtree need no walk up the trie. Every node belongs to the smallest
conversation through it, and the nodes of a conversation are the lower end of its
path. With what each conversation owns known from a first pass (characters of its
nodes, and whether it owns a leaf), the sums over a node's members give the sums
over its subtree: a member other than the node's own conversation owns nothing
above the node, so all that it owns lies below. A second pass adds these up.

Defined cases: rows without a conversation id take no part; turns are in order of
``turn``, null first, those with an equal one by a hash of role and text, a repeated
row is a turn again; null role or text is empty; a conversation without turns is a
member of the root and ends there; extra columns are passed over; an empty table
gives no node, not even a root. Conversations of a negative id c take c % 100 with
the sign of c, as Spark does.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyscope.llm.common import partitions, reliable, table
from tallyscope.operators.rowindex import with_row_index

#: Bytes of a turn's id, turns of a key, and segments of a block (two-level running sums).
WIDTH, SEGMENT, BLOCK = 16, 32, 1024
#: Segments that one task handles, and ids of a piece of a list of ends.
SEGMENTS_A_TASK, PIECE = 200_000, 10_000
#: Conversations share their first turns with that of the next smaller multiple; of so many turns less one at most.
FAMILY, SHARED = 100, 6


class Node:
    """A node with up to 4 or 16 children: their bytes, in order, and the children beside them."""

    __slots__ = ("path", "end", "bytes", "nodes")
    ROOM = 4

    def __init__(self, path: bytes, end: list | None = None):
        self.path, self.end = path, end
        self.bytes, self.nodes = bytearray(), []

    def child(self, byte: int) -> Node | None:
        i = self.bytes.find(byte)
        return self.nodes[i] if i >= 0 else None

    def put(self, byte: int, node: Node) -> Node:
        """Add or replace a child; returns the node, or the larger one that it became."""
        i = self.bytes.find(byte)
        if i >= 0:
            self.nodes[i] = node
            return self
        if len(self.nodes) == self.ROOM:
            return self.grown().put(byte, node)
        i = sum(b < byte for b in self.bytes)
        self.bytes.insert(i, byte)
        self.nodes.insert(i, node)
        return self

    def grown(self) -> Node:
        larger = Node16(self.path, self.end)
        larger.bytes, larger.nodes = self.bytes, self.nodes
        return larger

    def children(self) -> list[Node]:
        """In order of their bytes."""
        return self.nodes


class Node16(Node):
    __slots__ = ()
    ROOM = 16

    def grown(self) -> Node:
        larger = Node48(self.path, self.end)
        larger.bytes = bytearray(256)
        for i, byte in enumerate(self.bytes):
            larger.bytes[byte] = i + 1
        larger.nodes = self.nodes
        return larger


class Node48(Node):
    """``bytes`` tells for each of 256 bytes at which place of ``nodes`` its child is, from 1."""

    __slots__ = ()
    ROOM = 48

    def child(self, byte: int) -> Node | None:
        i = self.bytes[byte]
        return self.nodes[i - 1] if i else None

    def put(self, byte: int, node: Node) -> Node:
        if self.bytes[byte]:
            self.nodes[self.bytes[byte] - 1] = node
        elif len(self.nodes) == self.ROOM:
            return self.grown().put(byte, node)
        else:
            self.nodes.append(node)
            self.bytes[byte] = len(self.nodes)
        return self

    def grown(self) -> Node:
        larger = Node256(self.path, self.end)
        larger.nodes = [self.nodes[i - 1] if i else None for i in self.bytes]
        return larger

    def children(self) -> list[Node]:
        return [self.nodes[i - 1] for i in self.bytes if i]


class Node256(Node):
    """One place for every byte."""

    __slots__ = ()
    ROOM = 256

    def child(self, byte: int) -> Node | None:
        return self.nodes[byte]

    def put(self, byte: int, node: Node) -> Node:
        self.nodes[byte] = node
        return self

    def children(self) -> list[Node]:
        return [n for n in self.nodes if n is not None]


class RadixTree:
    """Byte strings, any of which may be a prefix of others, with a list of sums at each one's end."""

    def __init__(self) -> None:
        self.root: Node | None = None

    def add(self, key: bytes) -> Node:
        """The node at which ``key`` ends, made if it is not there."""
        if self.root is None:
            self.root = Node(key)
            return self.root
        above, edge, node, at = None, 0, self.root, 0
        while True:
            path = node.path
            size = len(path)
            if key[at : at + size] != path:
                same = 0
                rest = key[at : at + size]
                while same < len(rest) and rest[same] == path[same]:
                    same += 1
                fork = Node(path[:same])
                node.path = path[same + 1 :]
                fork.put(path[same], node)
                self._hang(above, edge, fork)
                if at + same == len(key):
                    return fork
                leaf = Node(key[at + same + 1 :])
                fork.put(key[at + same], leaf)
                return leaf
            at += size
            if at == len(key):
                return node
            child = node.child(key[at])
            if child is None:
                child = Node(key[at + 1 :])
                larger = node.put(key[at], child)
                if larger is not node:
                    self._hang(above, edge, larger)
                return child
            above, edge, node, at = node, key[at], child, at + 1

    def _hang(self, above: Node | None, edge: int, node: Node) -> None:
        """Put ``node`` in the place of its parent's child (which never grows the parent)."""
        if above is None:
            self.root = node
        else:
            above.put(edge, node)

    def aligned(self, width: int) -> Iterator[tuple[int, list]]:
        """(depth in units of ``width`` bytes, merged sums below) of each aligned place, children first."""
        stack: list[tuple[Node, int, bool]] = [(self.root, 0, False)] if self.root else []
        done: list[list] = []  # sums of finished nodes, to be taken by their parents
        while stack:
            node, start, seen = stack.pop()
            below = node.children()
            end = start + len(node.path)
            if not seen and below:
                stack.append((node, start, True))
                stack += [(c, end + 1, False) for c in below]
                continue
            sums = node.end
            for _ in below:
                sums = merged(sums, done.pop())
            for depth in range(-(-start // width), end // width + 1):
                yield depth, sums
            done.append(sums)


# what a node's members add up to: [members, smallest member, what that one owns, its length,
# lengths, owned, leaves, a row through the node]
def merged(a: list | None, b: list) -> list:
    if a is None:
        return b
    first = a if a[1] <= b[1] else b
    return [a[0] + b[0], *first[1:4], a[4] + b[4], a[5] + b[5], a[6] + b[6], a[7]]


def turns_of(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv``, ``at`` (place in the order of all turns), ``id`` and ``size`` (code points of the text)."""
    said, by = F.coalesce(F.col(text).cast("string"), F.lit("")), F.coalesce(F.col(role).cast("string"), F.lit(""))
    name = F.unhex(F.md5(F.concat(F.length(by).cast("string"), F.lit(":"), by, said)))
    rows = conversations.select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), name.alias("id"), F.length(said).cast("long").alias("size"))
    rows = reliable(rows.filter("conv is not null"))
    return reliable(with_row_index(rows, ["conv", "turn", "id"], "at").select("conv", "at", "id", "size"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv, place from 1, id, size) of the rebuilt conversations, and the ids of all that have none.

    A conversation c takes the first h turns of c - c % 100 and its own after its first h, with h
    made from a checksum of its id.
    """
    convs = turns.groupBy("conv").agg(F.min("at").alias("start"), F.count("*").alias("n"))
    convs = reliable(convs.withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % SHARED).withColumn("base", F.expr(f"conv - conv % {FAMILY}")))
    bases = convs.filter("conv = base").select("base", F.col("n").alias("there"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    convs = reliable(convs.select("conv", "start", "n", "h", "base", "taken"))
    placed = turns.join(convs.select("conv", "start", "h", "taken"), "conv").withColumn("own", F.expr("at - start + 1"))
    own = placed.filter("own > h").select("conv", F.expr("own - h + taken").alias("place"), "id", "size")
    heads = placed.filter(f"conv % {FAMILY} = 0 and own < {SHARED}").select(F.col("conv").alias("base"), F.col("own").alias("place"), "id", "size")
    taken = heads.join(convs.select("conv", "base", "taken"), "base").filter("place <= taken").select("conv", "place", "id", "size")
    return own.unionAll(taken), convs.filter("taken = 0 and n <= h").select("conv")


def _segments(turns: DataFrame, empty: DataFrame) -> DataFrame:
    """A row for each ``SEGMENT`` turns of a conversation: what it holds, and fingerprint and length of what is before it."""
    rows = turns.withColumn("level", F.expr(f"(place - 1) div {SEGMENT}"))
    hashed = rows.withColumns({"a": F.xxhash64(F.lit(0), "place", "id"), "b": F.xxhash64(F.lit(1), "place", "id")})
    held = F.array_sort(F.collect_list(F.struct("place", "id", "size", "a", "b")))
    segs = hashed.groupBy("conv", "level").agg(held.alias("held"), F.bit_xor("a").alias("xa"), F.bit_xor("b").alias("xb"), F.sum("size").alias("chars"))
    segs = segs.withColumn("block", F.expr(f"level div {BLOCK}"))

    def before(frame: DataFrame, keys: list[str], order: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        zero = F.lit(0).cast("long")
        return frame.withColumns({"sa": F.coalesce(F.bit_xor("xa").over(w), zero), "sb": F.coalesce(F.bit_xor("xb").over(w), zero), "sc": F.coalesce(F.sum("chars").over(w), zero)})

    segs = reliable(before(segs, ["conv", "block"], "level"))
    blocks = segs.groupBy("conv", "block").agg(F.bit_xor("xa").alias("xa"), F.bit_xor("xb").alias("xb"), F.sum("chars").alias("chars"))
    long = blocks.filter("block > 0").select("conv").distinct()
    blocks = before(blocks.join(long, "conv", "left_semi"), ["conv"], "block").filter("block > 0")
    later = segs.filter("block > 0").join(blocks.select("conv", "block", F.col("sa").alias("ba"), F.col("sb").alias("bb"), F.col("sc").alias("bc")), ["conv", "block"])
    columns = ["conv", "level", "held", "chars", "sa", "sb", "sc"]
    later = later.withColumns({"sa": F.col("sa").bitwiseXOR(F.col("ba")), "sb": F.col("sb").bitwiseXOR(F.col("bb")), "sc": F.expr("sc + bc")}).select(*columns)
    none = empty.select("conv", *[F.expr(x) for x in ("0L as level", "slice(array(named_struct('place', 0L, 'id', X'', 'size', 0L, 'a', 0L, 'b', 0L)), 1, 0) as held", "0L as chars", "0L as sa", "0L as sb", "0L as sc")])
    return segs.filter("block = 0").select(*columns).unionByName(later).unionByName(none)


_SUMS = "n bigint, conv bigint, own bigint, length bigint, lengths bigint, owned bigint, leaves bigint"
_EMITTED = f"a bigint, b bigint, pa bigint, pb bigint, depth bigint, size bigint, chars bigint, {_SUMS}, ends string"


def _run_nodes(above_all: int, start: tuple[int, int, int], tree: RadixTree) -> Iterator[tuple]:
    """The nodes of one tree whose segments hang from the node ``start`` (fingerprint, characters) at depth ``above_all``."""
    for depth, sums in tree.aligned(WIDTH):
        through = sums[7]
        if depth:
            held = through[:depth]
            a, b, chars = start
            above = (a, b)
            for turn in held:
                above = (a, b)
                a, b, chars = a ^ turn["a"], b ^ turn["b"], chars + turn["size"]
            yield (a, b, *above, above_all + depth, held[-1]["size"], chars, *sums[:7], None)
        elif not above_all:  # the root of all; other levels hang from nodes that the level above emits
            yield (0, 0, None, None, 0, 0, 0, *sums[:7], None)


def _emit(segments: DataFrame, ends: bool) -> DataFrame:
    """Parts of nodes and, with ``ends``, pieces of the lists of conversations that end at a node."""
    schema = pa.schema([pa.field(f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in _EMITTED.split(", ")])
    segment, size = SEGMENT, PIECE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        out: list[tuple] = []
        at, tree, last, ids = None, RadixTree(), None, []

        def piece() -> None:
            if ids:
                out.append((*last[1], None, None, None, None, None, None, ids[0], None, None, None, None, None, ",".join(map(str, ids))))
                ids.clear()

        for batch in batches:
            for row in batch.to_pylist():
                place = (row["level"], row["sa"], row["sb"])
                if place != at:
                    if at is not None:
                        out += _run_nodes(at[0] * segment, (at[1], at[2], before), tree)
                    at, tree, before = place, RadixTree(), row["sc"]
                held = row["held"]
                key = b"".join(t["id"] for t in held)
                end = tree.add(key)
                own = [1, row["conv"], row["own"], row["length"], row["length"], row["own"], row["leaf"], held]
                end.end = merged(end.end, own)
                if ends and row["last"]:
                    if last is None or last[0] != (place, key):
                        if last is not None:
                            piece()
                        a, b = place[1:]
                        for t in held:
                            a, b = a ^ t["a"], b ^ t["b"]
                        last = ((place, key), (a, b))
                    ids.append(row["conv"])
                    if len(ids) == size:
                        piece()
                if len(out) >= 1 << 14:
                    yield batch_of(out)
                    out = []
        if at is not None:
            out += _run_nodes(at[0] * segment, (at[1], at[2], before), tree)
        if last is not None:
            piece()
        for i in range(0, len(out), 1 << 14):
            yield batch_of(out[i : i + (1 << 14)])

    order = ["level", "sa", "sb", "ids", "conv"]
    tasks = max(partitions(segments.sparkSession), -(-segments.count() // SEGMENTS_A_TASK))
    dealt = segments.withColumn("ids", F.transform("held", lambda t: t.getField("id"))).repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    return dealt.drop("ids").mapInArrow(run, _EMITTED)


def _nodes(parts: DataFrame) -> DataFrame:
    """Parts of nodes merged by fingerprint, with their number of children."""
    same = [F.max(c).alias(c) for c in ("pa", "pb", "depth", "size", "chars")]
    sums = [F.sum(c).alias(c) for c in ("n", "lengths", "owned", "leaves")]
    nodes = parts.groupBy("a", "b").agg(*same, *sums, F.min(F.struct("conv", "own", "length")).alias("first"))
    nodes = reliable(nodes.select("*", "first.*").drop("first"))
    below = nodes.filter("pa is not null").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    return nodes.join(below, ["a", "b"], "left").fillna(0, "n_children")


def _digests(pieces: DataFrame) -> DataFrame:
    """SHA-256 of each node's list of ends, fed piece by piece in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["a", "b", "ends_sha256"])

        at, digest, out = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                if (row["a"], row["b"]) != at:
                    if at is not None:
                        out.append((*at, digest.hexdigest()))
                    at, digest = (row["a"], row["b"]), hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(row["ends"].encode())
            if len(out) >= 1 << 14:
                yield batch_of(out)
                out = []
        if at is not None:
            out.append((*at, digest.hexdigest()))
        yield batch_of(out)

    dealt = pieces.select("a", "b", "conv", "ends").repartition("a", "b").sortWithinPartitions("a", "b", "conv")
    return dealt.mapInArrow(run, "a bigint, b bigint, ends_sha256 string")


def prefix_trie(turns: DataFrame, empty: DataFrame) -> DataFrame:
    """Nodes of the trie of conversations given by their turns (conv, place from 1, id, size) and the
    ids of those without any: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""
    segs = reliable(_segments(turns, empty))
    lengths = segs.groupBy("conv").agg(F.sum("chars").alias("length"), F.max("level").alias("lowest"))
    zero = F.lit(0).cast("long")
    first = _nodes(_emit(segs.withColumns({"own": zero, "length": zero, "leaf": zero, "last": F.lit(False)}), False))
    deepest = F.max(F.struct("depth", "n_children"))
    owners = first.groupBy("conv").agg(F.sum("size").alias("own"), (deepest.getField("n_children") == 0).cast("long").alias("leaf"))
    known = reliable(lengths.join(owners, "conv", "left").fillna(0, ["own", "leaf"]))
    parts = reliable(_emit(segs.join(known, "conv").withColumn("last", F.col("level") == F.col("lowest")).drop("lowest"), True))
    nodes = reliable(_nodes(parts.filter("ends is null")))
    saved = F.expr("(lengths - n * (chars - size)) - (owned - own + (length - chars + size))")
    nodes = _with_parents(nodes).join(_digests(parts.filter("ends is not null")), ["a", "b"], "left")
    return nodes.select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", F.col("leaves").alias("n_leaves"),
        saved.alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def _with_parents(nodes: DataFrame) -> DataFrame:
    """Each node's parent's smallest conversation. Parents of a thousandth of all nodes or more (a
    thousand at most) are broadcast, so no task gets all children of a common turn."""
    total = nodes.count()
    large = F.col("n_children") * 1000 >= total
    parents = nodes.filter("n_children > 0").select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv").alias("parent_conv_id"), "n_children")
    hot = F.broadcast(parents.filter(large).drop("n_children").withColumn("__hot", F.lit(True)))
    marked = nodes.join(hot, ["pa", "pb"], "left")
    near = marked.filter("__hot or pa is null").drop("__hot")
    rest = marked.filter("__hot is null and pa is not null").drop("__hot", "parent_conv_id").join(parents.filter(~large).drop("n_children"), ["pa", "pb"])
    return near.unionByName(rest)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of the rebuilt ``conversations``."""
    return prefix_trie(*rebuilt(turns_of(table(spark, sf_dir, "conversations"))))


_STEP = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
_CRC = f"""xor(list_reduce(list_transform(range(1, len(CAST(conv_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substring(CAST(conv_id AS VARCHAR), i, 1)) AS BIGINT)),
  lambda crc, x: list_reduce([CAST(k AS BIGINT) FOR k IN range(8)], lambda c, k: {_STEP}, xor(crc, x)), CAST(4294967295 AS BIGINT)), 4294967295)"""

#: The same in SQL: every prefix of every rebuilt conversation as a list.
ORACLE = f"""
WITH own AS (
  SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, turns, {_CRC} % 6 AS h FROM own),
c AS (
  SELECT h.conv_id, list_concat(coalesce(list_slice(b.turns, 1, h), []), list_slice(h.turns, h + 1, len(h.turns))) AS turns
  FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 100),
m AS (SELECT conv_id, turns, list_slice(turns, 1, d) AS path, d FROM c, LATERAL (SELECT unnest(range(0, len(turns) + 1)) AS d)),
n AS (
  SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(length(path[-1].t), 0) AS size,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(turns) = d), '')) AS ends_sha256
  FROM m GROUP BY path, d),
k AS (SELECT n.*, (SELECT count(*) FROM n x WHERE x.d = n.d + 1 AND list_slice(x.path, 1, n.d) = n.path) AS n_children,
             (SELECT p.conv_id FROM n p WHERE p.d = n.d - 1 AND p.path = list_slice(n.path, 1, n.d - 1)) AS parent_conv_id FROM n),
s AS (
  SELECT k.path, k.d, sum(CASE WHEN x.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((x.n_convs - 1) * x.size) AS saved_tokens
  FROM k JOIN k x ON x.d >= k.d AND list_slice(x.path, 1, k.d) = k.path GROUP BY k.path, k.d)
SELECT conv_id, CAST(k.d AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM k JOIN s ON k.path = s.path AND k.d = s.d
"""
