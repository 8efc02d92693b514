"""The join against brute force over all pairs, with real word tuples as shingles."""

import random
import re
import tracemalloc

import numpy as np

from tallyscope.llm import ngram_join as J


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})


def plain(rows):
    sets = [plain_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                    parent[root(i)] = root(j)
    low = {}
    for k, (i, _) in enumerate(rows):
        low[root(k)] = min(low.get(root(k), i), i)
    return sorted((i, len(sets[k]), low[root(k)]) for k, (i, _) in enumerate(rows))


def run(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, sig string, n int").repartition(4)
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_groups(df).collect())


def corpus(seed, n, passage_share=0.4):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randrange(3, 150))] for _ in range(n // 8)]
    rows = []
    for i in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.randrange(0, max(1, len(words) // 12) + 1)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        if rng.random() < passage_share:
            words = words + passage if rng.random() < 0.5 else passage + words
        if rng.random() < 0.1:
            words = words[: rng.randrange(1, 8)]
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(w.upper() if rng.random() < 0.1 else w for w in words)))
    return rows


def test_equals_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed, 260)
        assert run(spark, rows) == plain(rows)


def test_long_lists_in_chains_and_blocks(spark, monkeypatch):
    rows = corpus(3, 200, passage_share=0.9)
    want = plain(rows)
    for name, value in (("CHAIN", 5), ("BLOCK", 7), ("REPORTED", 2)):
        monkeypatch.setattr(J, name, value)
    assert run(spark, rows) == want


def test_members_alone_in_chains_of_a_dealt_list(spark, monkeypatch):
    for name, value in (("CHAIN", 5), ("REPORTED", 2)):
        monkeypatch.setattr(J, name, value)
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(40)]
    # the passage is often, but in no long text's prefix: each list is the near-bare copies, two or three of them
    long = [(i, " ".join([f"w{rng.randrange(10**6)}" for _ in range(160)] + passage)) for i in range(200)]
    for ends in (["a b", "c d"], ["e f", "g h"], ["i j", "k l", "m n"]):
        rows = long + [(1000 + i, " ".join([*passage, end])) for i, end in enumerate(ends)]
        assert run(spark, rows) == plain(rows)


def test_elements_are_counted_in_blocks(spark, monkeypatch):
    # sets larger than a block are among the texts
    rows = corpus(5, 150, passage_share=0.9)
    want = plain(rows)
    for name, value in (("COUNTED", 50), ("REPORTED", 2)):
        monkeypatch.setattr(J, name, value)
    assert run(spark, rows) == want


def test_counting_takes_little_more_than_the_elements(monkeypatch):
    rng = np.random.default_rng(2)
    for least in (1, 2, 8):
        monkeypatch.setattr(J, "REPORTED", least)
        for n in (0, 1, 7, 8, 9, 3000):
            given = rng.integers(0, n // 6 + 1, n).astype(np.uint64)
            values, counts = np.unique(given, return_counts=True)
            got = J.repeated(given.copy())
            assert got[0].tolist() == values[counts >= least].tolist() and got[1].tolist() == counts[counts >= least].tolist()
    given = rng.integers(0, 1 << 62, 1 << 20, dtype=np.uint64)
    tracemalloc.start()
    J.repeated(given)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # np.unique takes several times the elements
    assert most < given.nbytes / 2


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "ONE two"), (6, "one two three four five"), (7, "one two three four five"), (8, "É a b c d"), (9, "é a b c d")]
    rows += [(10, "x " * 30000), (11, "y z " * 10000), (11, "y z " * 10000)]
    assert run(spark, rows) == plain(rows)
    assert run(spark, []) == []
    assert run(spark, [(3, "  ")]) == [(3, 0, 3)]


def test_bounds_never_drop_a_link():
    rng = np.random.default_rng(1)
    for _ in range(500):
        a = np.unique(rng.integers(0, 1 << 62, rng.integers(1, 900), dtype=np.uint64))
        k = rng.integers(0, max(1, len(a) // 5) + 1)
        b = np.unique(np.concatenate([a[k:], rng.integers(0, 1 << 62, rng.integers(0, max(1, len(a) // 8) + 1), dtype=np.uint64)]))
        if len(b) and J.similar(a, b):
            assert J.may_link(J.signature(a), J.signature(b), len(a) + len(b))
            assert J.may_link(J.folded(J.signature(a), J.LEAST_WORDS), J.signature(b), len(a) + len(b))
            assert set(a[: J.prefix_length(len(a))]) & set(b[: J.prefix_length(len(b))])


def test_components_of_long_paths_and_stars(spark):
    from tallyscope.llm.components import connected_components

    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 4999), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(301)) and all(got[1000 + i] == 1000 for i in range(200)) and got[5000] == 4999
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
