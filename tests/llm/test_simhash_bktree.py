"""SimHash near-duplicates: fingerprints, BK-trees and components against plain versions."""

import random
import re

import numpy as np
import pytest
import xxhash

from tallyscope.llm import simhash_bktree as S

SF = "/root/testdata/sf0.01"


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """[(doc, fp)] -> {position: smallest reachable doc}."""
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 2:
                group[top(i)] = top(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        ids = [x for x in (least.get(top(i)), doc) if x is not None]
        least[top(i)] = min(ids) if ids else None
    return [least[top(i)] for i in range(len(rows))]


def check(spark, docs, schema="doc_id bigint, text string"):
    got = S.near_duplicates(spark.createDataFrame(docs, schema).repartition(3)).collect()
    rows = [(d[0], plain_fingerprint(d[1])) for d in docs]
    want = [(d, f"{fp:016x}", c) for (d, fp), c in zip(rows, plain_components(rows), strict=True)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_fingerprints_match_a_plain_version(monkeypatch):
    monkeypatch.setattr(S, "HASHES", 7)
    rng = random.Random(4)
    for n in (0, 1, 2, 3, 4, 9, 10, 30):
        text = " ".join(rng.choice(["Été", "ABC", "x", "ÀB", "y z", " "]) for _ in range(n))
        assert S.fingerprint(text.encode()) == plain_fingerprint(text)
    assert S.fingerprint("a\x1cb c".encode()) == plain_fingerprint("a\x1cb c")
    assert S.fingerprint(None) == S.fingerprint(b" \t\n") == 0


def test_bk_tree_finds_all_within_the_radius():
    rng = random.Random(2)
    values = list({rng.getrandbits(64) & 0xFF00FF for _ in range(400)})
    tree = S.BKTree()
    for i, v in enumerate(values):
        assert sorted(tree.add(v, i, 2)) == [j for j in range(i) if (values[j] ^ v).bit_count() <= 2]


def test_documents_of_the_smallest_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.op13_simhash_bktree(spark, SF).collect()}
    assert len(got) == len(rows)
    prints = np.array([plain_fingerprint(r.text) for r in rows], np.uint64)
    ids = np.array([r.doc_id for r in rows])
    order = np.argsort(ids)
    prints, ids = prints[order], ids[order]
    close = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 2
    label = ids.copy()
    while True:  # spread the smallest id until nothing changes
        new = np.where(close, label[None, :], label.max() + 1).min(axis=1)
        if (new == label).all():
            break
        label = new
    assert got == {int(i): (f"{int(p):016x}", int(c)) for i, p, c in zip(ids, prints, label, strict=True)}


@pytest.mark.parametrize("shard", [1, 3, 4096])
def test_links_of_close_fingerprints_in_trees_and_in_large_shards(spark, monkeypatch, shard):
    monkeypatch.setattr(S, "SHARD", shard)
    rng = random.Random(shard)
    centres = [rng.getrandbits(64) for _ in range(6)] + [0, (1 << 64) - 1]
    values = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centres for _ in range(25)}
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in S.near_links(spark.createDataFrame(signed, "fp bigint")).collect()]
    assert len(links) <= (6 * len(values) if shard == 4096 else 6 * 33 * len(values))
    order = sorted(values)
    want = plain_components([(v, v) for v in order])
    group = {v: v for v in order}

    def top(v):
        while group[v] != v:
            v = group[v]
        return v

    for a, b in links:
        ra, rb = top(a), top(b)
        group[max(ra, rb)] = min(ra, rb)
    assert [top(v) for v in order] == want


def test_odd_documents(spark):
    long = " ".join(f"w{i % 977}" for i in range(70_000))
    docs = [(5, None), (6, ""), (2, " \n\t "), (9, "one"), (8, "ONE"), (9, "one two"), (7, long), (1, long), (1, long), (None, "one"), (None, "alone here"), (4, "a b c a b c a b c")]
    check(spark, docs)


def test_an_empty_table_and_clashing_names(spark):
    assert S.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    rows = [(3, "a b c d", 1, "x", 2), (1, "a b c d", 1, "x", 2)]
    got = S.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string, fp int, doc string, n int"))
    assert sorted((r.doc_id, r.component_id) for r in got.collect()) == [(1, 1), (3, 1)]


def test_a_group_of_copies_is_broadcast(spark):
    docs = [(i, "the same text for all of them") for i in range(2000)] + [(5000 + i, f"text {i} of its own {i * i}") for i in range(30)]
    got = S.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert {r.component_id for r in got if r.doc_id < 2000} == {0} and len(got) == 2030
