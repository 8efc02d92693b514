"""The prefix trie of conversations against a plain version."""

import hashlib
import random
import zlib

import pytest

from tallyscope.llm import prefix_trie as T

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
SF = "/root/testdata/sf0.01"


def plain(rows):
    """Nodes by brute force; rows are (conv_id, turn, role, text) with different turns."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append(((turn is not None, turn or 0), (role or "", text or "")))
    own = {c: [t for _, t in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = tuple(own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h] + turns[h:])
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    out = {}
    for p in sorted(members, key=len, reverse=True):
        below = children.get(p, [])
        size = len(p[-1][1]) if p else 0
        leaves = sum(out[c][5] for c in below) if below else 1
        saved = (len(members[p]) - 1) * size + sum(out[c][6] for c in below)
        ends = ",".join(map(str, sorted(c for c in members[p] if len(paths[c]) == len(p))))
        parent = min(members[p[:-1]]) if p else None
        out[p] = (min(members[p]), len(p), parent, len(members[p]), len(below), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=str)


def run(spark, rows, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema).repartition(3)
    return sorted((tuple(r) for r in T.prefix_trie(*T.rebuilt(T.turns_of(df))).collect()), key=str)


def test_tree_with_all_node_layouts_keeps_every_key():
    rng = random.Random(3)
    keys = {bytes([a]) + bytes([rng.randrange(3)]) * rng.randrange(0, 4) for a in range(256)} | {b"", b"\0", b"\0\0\0"}
    keys |= {bytes([7, b, c]) for b in range(60) for c in range(b)}
    order = sorted(keys)
    rng.shuffle(order)
    tree = T.RadixTree()
    for k in order:
        node = tree.add(k)
        node.end = T.merged(node.end, [1, 0, 0, 0, 0, 0, 0, k])
    for k in order:
        assert tree.add(k).end[0] == 1
    kinds = set()
    stack = [tree.root]
    while stack:
        n = stack.pop()
        kinds.add(type(n).__name__)
        stack += n.children()
    assert kinds == {"Node", "Node16", "Node48", "Node256"}
    got = {}
    for depth, sums in tree.aligned(1):
        got.setdefault(depth, []).append(sums[0])
    for depth, counts in got.items():
        want = {}
        for k in keys:
            if len(k) >= depth:
                want[k[:depth]] = want.get(k[:depth], 0) + 1
        assert sorted(counts) == sorted(want.values())


@pytest.mark.parametrize("sizes", [(32, 1024, 10_000), (2, 3, 2)])
def test_matches_a_plain_version_with_short_segments_and_pieces(spark, monkeypatch, sizes):
    for name, value in zip(("SEGMENT", "BLOCK", "PIECE"), sizes, strict=True):
        monkeypatch.setattr(T, name, value)
    rng = random.Random(5)
    rows = []
    for c in [*range(0, 60), 100, 101, 107, 230, 231, 300]:
        n = rng.choice([1, 2, 3, 7, 12, 40]) if c else 30
        rows += [(c, t if t else None, rng.choice(["user", None]), rng.choice(["a", "bc", ""]) if t < 9 else "tail") for t in range(n)]
    rows += [(None, 1, "user", "lost")]
    assert run(spark, rows) == plain(rows)


def test_copies_long_conversations_and_ties(spark, monkeypatch):
    monkeypatch.setattr(T, "SEGMENT", 4)
    rows = [(1000 + i, t, "user", f"t{t}") for i in range(0, 300) for t in range(8)]
    rows += [(7, t, "user", f"t{t % 5}") for t in range(700)]
    rows += [(-3, 0, "user", "é" * 5000), (-250, 0, "user", "x")]
    assert run(spark, rows) == plain(rows)
    assert run(spark, [(5, 1, "b", "x"), (5, 1, "a", "x"), (5, 1, "a", "x")] * 4) == run(spark, [(5, 1, "a", "x"), (5, 1, "a", "x"), (5, 1, "b", "x")] * 4)


def test_an_empty_table_and_clashing_names(spark):
    assert run(spark, []) == []
    rows = [(200, 0, "user", "a", 1, "x"), (200, 1, "user", "b", 1, "x"), (201, 0, "user", "a", 1, "x")]
    got = run(spark, rows, SCHEMA + ", at int, id string")
    assert got == plain([r[:4] for r in rows])


def test_query_matches_a_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in T.op11_prefix_trie(spark, SF).collect()), key=str) == plain(rows)
