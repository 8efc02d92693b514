"""Removal of repeats against a plain count of all 200-byte strings."""

import hashlib
import random
from collections import Counter

import numpy as np

from tallyscope.llm import suffix_dedup as S


def plain(rows):
    data = [(i, (t or "").encode()) for i, t in rows]
    n = Counter(d[p : p + 200] for _, d in data for p in range(len(d) - 199))
    out = []
    for i, d in data:
        cover = np.zeros(len(d) + 1, np.int64)
        for p in range(len(d) - 199):
            if n[d[p : p + 200]] > 1:
                cover[p] += 1
                cover[p + 200 if p + 200 < len(cover) else -1] -= 1
        gone = np.cumsum(cover)[: len(d)] > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(d), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(d, gone) if not g)).hexdigest()))
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, start int, key string").repartition(4)
    return sorted(map(tuple, S.removal_digests(df).collect()))


def corpus(seed, n):
    rng = random.Random(seed)

    def prose(k):
        return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 8))) for _ in range(k))

    passages = [prose(rng.randrange(30, 120)) for _ in range(6)]
    copies = [prose(90), prose(200)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.1:
            text = rng.choice(copies)
        elif kind < 0.2:
            words = copies[1].split(" ")
            words[rng.randrange(len(words))] = "edited"
            text = " ".join(words)
        elif kind < 0.6:
            text = prose(rng.randrange(40)) + rng.choice(passages) + prose(rng.randrange(60)) + (rng.choice(passages)[: rng.randrange(400)] if rng.random() < 0.5 else "")
        else:
            text = prose(rng.randrange(150))
        rows.append((i, text))
    return rows


ODD = [(900, None), (901, ""), (902, "a" * 199), (903, "b" * 200), (904, "c" * 201), (905, "ab" * 700), (906, "x" * 250 + "y" * 230 + "x" * 199), (907, "é" * 150), (908, "\x00" * 500)]


def test_equals_brute_force(spark):
    rows = corpus(1, 120) + ODD
    assert run(spark, rows) == plain(rows)


def test_anchors_too_large_for_a_tile(spark, monkeypatch):
    monkeypatch.setattr(S, "LARGEST", 600)
    monkeypatch.setattr(S, "TILE", 2000)
    rows = corpus(2, 100) + ODD
    assert run(spark, rows) == plain(rows)


def test_repeated_rows_and_empty_table(spark):
    text = "".join(random.Random(4).choice("abcdefgh ") for _ in range(700))
    rows = [(1, text), (1, text), (2, text[100:350]), (3, "short")]
    assert run(spark, rows) == plain(rows)
    assert run(spark, []) == []


def test_long_text_cut_in_parts(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 512)
    monkeypatch.setattr(S, "BLOCK", 700)
    rows = corpus(5, 60)
    rows.append((500, " ".join(t for _, t in rows[:20])))
    assert run(spark, rows) == plain(rows)


def test_index_streams_the_longest_matches():
    rng = random.Random(6)
    strings = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 60))).encode() for _ in range(12)] + [b"abab" * 9] * 2
    index = S.RunLengthIndex(strings)
    got = index.statistics()
    assert index.runs < index.size
    suffixes = [(k, i, s[i:]) for k, s in enumerate(strings) for i in range(len(s))]
    for k, i, s in suffixes:
        best = 0
        for m, j, t in suffixes:
            if (k, i) != (m, j):
                n = 0
                while n < min(len(s), len(t)) and s[n] == t[n]:
                    n += 1
                best = max(best, n)
        assert got[index.starts[k] + i] == best


def test_text_keeps_whole_characters(spark):
    text = "é" * 99 + "z" + "".join(random.Random(8).choice("abcdefgh ") for _ in range(300))
    df = spark.createDataFrame([(1, "p" + text, "en"), (2, "qq" + text, "de"), (3, None, "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r.text for r in S.remove_repeats(df).collect()}
    assert got[1] == "p" and got[2] == "qq" and got[3] == ""


def test_equal_rows_share_distinct_ranges_and_maps_pass(spark):
    from pyspark.sql import functions as F

    from tallyscope.llm import suffix_dedup as S

    text = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(450))
    rows = [(1, text)] * 60 + [(2, "other text that is short")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    keyed = df.select(F.xxhash64("doc_id", "text").alias("key"), F.struct("doc_id").alias("id"), "text")
    sizes = [len(r.ranges) for r in S.repeats(keyed).collect()]
    assert len(sizes) == 1 and sizes[0] <= 60
    assert {(r.doc_id, r.n_removed) for r in S.removal_digests(df).collect()} == {(1, 450), (2, 0)}
    with_map = df.withColumn("m", F.create_map(F.lit("a"), F.col("doc_id")))
    assert sorted((r.doc_id, r.m["a"], r.text) for r in S.remove_repeats(with_map).collect())[-1] == (2, 2, "other text that is short")


def test_marks_of_large_anchors_are_ranges_that_do_not_touch(spark, monkeypatch):
    monkeypatch.setattr(S, "LARGEST", 600)
    written, marks = S.Scratch.written, []

    def noted(self, df, name):
        out = written(self, df, name)
        if name == "edge-marks":
            marks.extend(out.collect())
        return out

    monkeypatch.setattr(S.Scratch, "written", noted)
    rng = random.Random(11)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(330))
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(60)) + passage[rng.randrange(60) :]) for i in range(60)]
    assert run(spark, rows) == plain(rows)
    marks.sort()
    assert marks and all(x.b < y.a for x, y in zip(marks, marks[1:]) if (x.anchor, x.seg) == (y.anchor, y.seg))


def test_index_needs_few_bytes_for_each_of_a_tile():
    import tracemalloc

    rng = random.Random(12)
    passage = bytes(rng.randrange(97, 123) for _ in range(250))
    strings = [bytes(rng.randrange(97, 123) for _ in range(30)) + passage[rng.randrange(40) :] for _ in range(1200)]
    tracemalloc.start()
    S.repeated_strings(strings)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 * sum(map(len, strings))
