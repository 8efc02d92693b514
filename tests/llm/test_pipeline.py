"""The stages against plain versions, each on what its predecessor left."""

import public_tokenizers
import pyarrow as pa

import corpus_pipeline as C
from tallyscope.llm import packing, pii, toxicity

from . import test_ngram_join, test_packing, test_pii, test_suffix_dedup

DATA = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_every_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    # copies with ids of their own, so that every stage has something to do
    docs = docs.unionAll(docs.limit(20).selectExpr("doc_id + 100000", "concat(text, ' more')", "lang", "source", "n_chars")).repartition(4)
    left = {}
    for name, stage in C.STAGES:
        out = stage(spark, docs, DATA)
        if name != C.STAGES[-1][0]:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        path = str(tmp_path / name)
        out.write.parquet(path)
        left[name] = docs, spark.read.parquet(path)
        docs = left[name][1]

    before, after = left["toxicity"]
    chain = toxicity.fit(before, spark.read.parquet(f"{DATA}/labels.parquet"))
    clean = sorted(i for i, t in pairs(before) if chain.probabilities(chain.hits((t or "").encode()))[-1] < 0.5)
    assert ids(after) == clean

    before, after = left["ngram_join"]
    assert ids(after) == [i for i, n, c in test_ngram_join.plain(pairs(before)) if not n or i == c]
    assert len(ids(after)) < len(ids(before))

    before, after = left["suffix_dedup"]
    want = {i: (size, gone) for i, size, gone, _, _ in test_suffix_dedup.plain(pairs(before))}
    for r in after.collect():
        size, gone = want[r.doc_id]
        # a cut character goes whole
        assert size - gone - 6 <= len(r.text.encode()) <= size - gone and r.n_chars == len(r.text)

    before, after = left["pii"]
    texts = dict(pairs(before))
    found = 0
    for r in after.collect():
        spans = test_pii.plain(texts[r.doc_id])
        found += len(spans)
        assert all(r.text.count(f"<{k.upper()}>") for k, _, _ in spans) and r.n_chars == len(r.text)
        if not any(f"<{k.upper()}>" in r.text for k in pii.KINDS):
            assert r.text == texts[r.doc_id]
    assert found

    before, after = left["packing"]
    test_packing.check(after.collect(), {i: [t] for i, t in pairs(before)}, packing.SEQ_LEN)


def test_run_is_its_stages(spark):
    got = C.run(spark, DATA).collect()
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
    test_packing.check(got, {i: [t] for i, t in pairs(docs)}, packing.SEQ_LEN)


def test_empty_and_odd_documents(spark):
    schema = spark.read.parquet(f"{DATA}/documents.parquet").schema
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "one text", "en", "s", 8), (3, "one text", "en", "s", 8), (4, "one text", None, "s", 8), (None, "no id", "en", "s", 5)]
    for given, kept in (([], []), (rows, [None, 1, 2, 3])):
        docs = spark.createDataFrame(given, schema)
        for name, stage in C.STAGES[:-1]:
            docs = stage(spark, docs, DATA)
        assert sorted((r.doc_id for r in docs.collect()), key=lambda x: (x is not None, x)) == kept
        assert {r.doc_id for r in packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()} == set(kept)


def test_an_id_with_a_linked_and_another_text(spark):
    schema = spark.read.parquet(f"{DATA}/documents.parquet").schema
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(1, words), (3, words + " more"), (3, "a text of its own that nothing is linked with"), (3, "a text of its own that nothing is linked with"), (4, words), (5, ""), (5, words)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], schema)
    got = C.one_of_each_group(spark, docs, DATA)
    assert got.dtypes == docs.dtypes
    assert sorted(pairs(got)) == [(1, words), (3, "a text of its own that nothing is linked with"), (5, "")]


def test_the_join_with_groups_is_planned_once(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    plan = C.one_of_each_group(spark, docs, DATA)._jdf.queryExecution().optimizedPlan().toString()
    # with the groups' own joins in each branch the driver's plan was four times as large
    assert plan.count("Join ") <= 4


def batch_sizes(batches):
    yield pa.RecordBatch.from_arrays([pa.array([b.num_rows for b in batches], pa.int64())], names=["n"])


def test_texts_come_to_python_in_small_batches(spark):
    schema = spark.read.parquet(f"{DATA}/documents.parquet").schema
    docs = spark.createDataFrame([(i, "a text", "en", "s", 6) for i in range(2500)], schema).coalesce(1)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    had = spark.conf.get(name)
    try:
        # a smaller number of the session's own stays
        for given, most in (("10000", 1000), ("0", 1000), ("70", 70)):
            spark.conf.set(name, given)
            assert C.pack(spark, docs, DATA).count() >= 2500
            sizes = [r.n for r in docs.mapInArrow(batch_sizes, "n long").collect()]
            assert sum(sizes) == 2500 and max(sizes) == most
    finally:
        spark.conf.set(name, had)
