"""Digests and neighbours against a plain loop over sorted documents."""

import hashlib
import random

from tallyscope.llm import fingerprints as P


def expected(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        e = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
        own, made, after = map(P.fingerprint, (t, e, nxt))
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), own, made, P.likeness(own, made), P.likeness(own, after)))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, bucket int").repartition(5)
    return sorted(map(tuple, P.neighbour_digests(df).collect()), key=str)


def words(rng, n):
    return " ".join(rng.choice(["alpha", "béta", "gamma", "δ", "e", "\U0001f600z"]) for _ in range(n))


def test_equals_a_loop(spark):
    rng = random.Random(1)
    rows = [(i * 3, words(rng, rng.randrange(60))) for i in range(500)] + [(7, None), (8, ""), (9, "x" * 9000)]
    assert run(spark, rows) == expected(rows)


def test_ties_nulls_and_tiny_tables(spark):
    for rows in ([(1, "only one document here")], [], [(1, "a b c d"), (1, "a b c e"), (None, "none"), (2, None)]):
        assert run(spark, rows) == expected(rows)
    same = [(5, "again and again")] * 50 + [(6, "other")]
    assert run(spark, same) == expected(same)


def test_score_is_bounded_and_tells_edits_from_others():
    rng = random.Random(2)
    # words of languages of their own: an edit keeps three quarters of them
    texts = []
    for _ in range(200):
        vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(80)]
        texts.append(" ".join(rng.choice(vocabulary) for _ in range(400)))
    near = far = 0
    for a, b in zip(texts, texts[1:]):
        x, y, z = P.fingerprint(a), P.fingerprint(P.edited(a, b)), P.fingerprint(b)
        assert 0 <= P.likeness(x, z) <= 1 and P.likeness(x, x) == 1 and P.likeness(x, z) == P.likeness(z, x)
        near += P.likeness(x, y)
        far += P.likeness(x, z)
        assert P.likeness(x, y) > P.likeness(x, z)
    assert near / 199 > far / 199 + 0.15


def test_digests(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None), (3, "abc")], "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in P.digests(df).collect()}
    assert got[1] == got[3] == P.fingerprint("abc") and got[2] == P.fingerprint("")


def test_ids_that_are_no_numbers(spark):
    from tallyscope.llm.fingerprints import neighbour_digests

    texts = {f"doc/{chr(97 + i % 26)}{i}": f"text number {i} " * (i % 5 + 1) for i in range(120)}
    got = {r.doc_id: r for r in neighbour_digests(spark.createDataFrame(list(texts.items()), "doc_id string, text string").repartition(3)).collect()}
    order = sorted(texts)
    assert sorted(got) == order
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        assert got[a].n_chars == len(texts[a])
        cut = len(texts[a]) // 4
        made = texts[a][: len(texts[a]) - cut] + texts[b][:cut]
        assert got[a].edited_sha256 == __import__("hashlib").sha256(made.encode()).hexdigest()
