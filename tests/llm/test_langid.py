"""Naive Bayes against a plain version, held-out accuracy, and odd rows."""

import math
import zlib
from collections import Counter

from pyspark.sql import functions as F

from tallyscope.llm import langid as L

DATA = "/root/testdata/sf0.01"


def plain_model(rows):
    """Counts by dict, one n-gram at a time, with the same hashed buckets."""
    counts, seen = {}, Counter()
    for text, lang in rows:
        buckets, _ = L.ngram_buckets([text])
        counts.setdefault(lang, Counter()).update(buckets.tolist())
        seen[lang] += 1
    return counts, seen


def plain_score(counts, seen, text):
    size = 1 << L.BITS
    logs = {}
    for lang, c in counts.items():
        total = sum(c.values()) + L.SMOOTHING * size
        logs[lang] = math.log(seen[lang] / sum(seen.values())) + sum(math.log((c[b] + L.SMOOTHING) / total) for b in L.ngram_buckets([text])[0].tolist())
    best = min(logs, key=lambda k: (-logs[k], k))
    return best, 1 / sum(math.exp(v - logs[best]) for v in logs.values())


TRAIN = [("the cat and the dog", "en"), ("this and that", "en"), ("le chat et le chien", "fr"), ("der Hund und die Katze", "de"), ("una Ñandú", "es")]


def test_equals_a_plain_version(spark):
    df = spark.createDataFrame([(i, t, x, "n") for i, (t, x) in enumerate(TRAIN * 3)] + [(99, None, "xx", ""), (98, "no language", None, "")], "doc_id long, text string, lang string, bucket string")
    model = L.train(df.repartition(3))
    assert model.languages == ["de", "en", "es", "fr"]
    counts, seen = plain_model(TRAIN * 3)
    texts = ["the", "le chien", "und", "a", "Ñandú una", "x" * 3000]
    names, scores = model.score(texts)
    for t, n, s in zip(texts, names, scores, strict=True):
        want, p = plain_score(counts, seen, t)
        assert n == want and abs(s - p) < 1e-3


def test_texts_without_letters_and_no_training(spark):
    df = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "12 34!", "en"), (4, "word", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.predict(df, L.train(df), {"doc_id": F.col("doc_id")}).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    none = L.train(df.filter("false"))
    assert {r.lang_pred for r in L.predict(df, none, {"doc_id": F.col("doc_id")}).collect()} == {"und"}
    assert L.predict(df.filter("false"), none, {"doc_id": F.col("doc_id")}).count() == 0


def test_grams_never_cross_texts():
    both, owner = L.ngram_buckets(["ab", "", "Cd"])
    for k, t in enumerate(["ab", "", "Cd"]):
        assert sorted(both[owner == k]) == sorted(L.ngram_buckets([t])[0])


def test_held_out_accuracy(spark):
    out = L.op8_langid(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(out) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out and r.lang_pred != "und"]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97


def test_numbers_that_are_no_digits_are_no_letters():
    from tallyscope.llm.langid import has_letter

    assert not any(has_letter(t) for t in ("²", "½ ①", "Ⅷ", "12 _ 3", ""))
    assert has_letter("½ é") and has_letter("Ⅷ字")
