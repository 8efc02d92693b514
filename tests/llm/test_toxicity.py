"""The chain on known data, held-out labels, odd rows, and its training steps."""

import zlib

import numpy as np

from tallyscope.llm import toxicity as T

DATA = "/root/testdata/sf0.1"


def rows(n=400):
    rng = np.random.default_rng(1)
    vocabulary = [f"wort{i}x" for i in range(150)]
    docs, labels = [], []
    for i in range(n):
        words = [vocabulary[j] for j in rng.integers(0, 150, rng.integers(5, 60))]
        kind = i % 4
        if kind == 1:
            words += ["Idiot,", "stupid!"]
        if kind == 2:
            words += [f"grobb{rng.integers(0, 1000)}", f"grobb{rng.integers(0, 1000)}"]
        docs.append((i, " ".join(rng.permutation(words)), 0, "x"))
        if i % 2 or i % 3 == 0 or kind == 2 and i % 8 == 2:
            labels.append((i, 1, int(kind in (1, 2))))
    return docs, labels


def frames(spark, docs, labels):
    return (
        spark.createDataFrame(docs, "doc_id long, text string, toxic int, id string").repartition(3),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_finds_what_was_never_labelled(spark):
    docs, labels = rows()
    d, lab = frames(spark, docs + [(1000, None, 0, ""), (1001, "", 1, ""), (1002, "idiot stupid " * 30000, 0, ""), (1003, "IDIOT stupid wort1x", 0, "")], labels + [(1, 1, None), (3, 1, 7), (5, 0, 0)])
    got = {r.doc_id: r for r in T.score(d, T.fit(d, lab)).collect()}
    assert len(got) == 404
    for i, _, _, _ in docs:
        assert got[i].toxic == (i % 4 in (1, 2)), i
        assert all(0 <= p <= 1 for p in (got[i].p_insult, got[i].p_coded, got[i].p_toxic))
    assert got[5].p_insult > 0.5 > got[5].p_coded and got[6].p_coded > 0.5 > got[6].p_insult
    assert not got[1000].toxic and not got[1001].toxic and got[1002].toxic and got[1003].toxic
    clean = T.keep_clean(d, T.fit(d, lab))
    assert clean.columns == d.columns and {r.doc_id for r in clean.collect()} == {i for i, r in got.items() if not r.toxic}


def test_no_labels_or_rows(spark):
    docs, labels = rows(40)
    d, lab = frames(spark, docs, labels)
    for some in (lab.filter("false"), lab.filter("toxic = 1"), lab.filter("toxic = 0")):
        assert {r.toxic for r in T.score(d, T.fit(d, some)).collect()} == {False}
    none = d.filter("false")
    assert T.score(none, T.fit(none, lab)).count() == 0


def test_out_of_fold_probabilities_feed_later_models():
    rng = np.random.default_rng(2)
    hits = [sorted(set(rng.integers(0, 6, 3).tolist())) for _ in range(300)]
    first = np.array([0 in h for h in hits])
    noise = rng.random(300) < 0.1
    second = first ^ noise
    chain = T.train_chain({bytes([i]): i for i in range(6)}, hits, np.column_stack([first, second]).astype(float), np.arange(300) % 3, np.ones(300))
    (w1, v1, _), (_, v2, _) = chain.models
    assert len(v1) == 0 and len(v2) == 1 and v2[0] > 0
    assert w1[0] > 3 and np.abs(w1[1:]).max() < w1[0] / 3, w1


def test_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    held = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 0}
    train = labels.filter("crc32(cast(doc_id as string)) % 4 <> 0")
    got = {r.doc_id: r.toxic for r in T.score(docs, T.fit(docs, train)).collect()}
    hit = [got[i] for i, t in held.items() if t == 1]
    false = [got[i] for i, t in held.items() if t == 0]
    # a few labels are noise: toxic ones without any abuse, clean ones full of it
    assert sum(hit) / len(hit) > 0.85 and sum(false) / len(false) < 0.01
