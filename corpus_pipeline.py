"""A corpus cleaned and packed in five stages, each one of the package's operators.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's ``docs``. All stages but the last return the columns of ``documents``:

- ``toxicity``: documents that the classifier chain rejects go.
- ``ngram_join``: of each group of documents linked by a five-word-shingle
  Jaccard similarity of 0.75 or more, the one with the smallest doc_id stays;
  documents without a word are linked with nothing and stay.
- ``suffix_dedup``: byte strings of 200 that start more than once go from the
  texts; a cut character goes whole; ``n_chars`` is counted anew.
- ``pii``: personal data is replaced by its kind in angle brackets; ``n_chars``
  is counted anew.
- ``packing``: pieces of sequences of 2048 tokens.

Defined cases are those of the operators; a null text is an empty one from
suffix_dedup on. Rows with a null doc_id are of no group and stay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tallyscope.llm import ngram_join, packing, pii, suffix_dedup, toxicity
from tallyscope.llm.common import Scratch, prepare, reliable, small_batches, table


def _prepare(spark: SparkSession) -> None:
    prepare(spark)
    small_batches(spark)


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the text as it is now, in the column's own type."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _prepare(spark)
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def _with_class(docs: DataFrame) -> DataFrame:
    """``docs`` and ``__class``, the n-gram join's class of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [ngram_join.set_id(ngram_join.shingle_set(t.as_py())) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.int64())], names=[*batch.schema.names, "__class"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("__class", LongType())]))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _prepare(spark)
    # both are read more than once below, where their plans would stand as often
    rows = reliable(ngram_join.jaccard_groups(docs))
    linked = (F.col("n_shingles") > 0) & (F.col("component_id") != F.col("doc_id"))
    groups = reliable(rows.groupBy("doc_id").agg(F.max(linked).alias("__gone"), (F.count("*") > 1).alias("__again")).filter("__gone or __again"))
    marked = docs.join(groups, "doc_id", "left")
    once = marked.filter("not coalesce(__again, false) and not coalesce(__gone, false)").select(*docs.columns)
    # an id that occurs again may have several texts: only those that are linked go
    gone = rows.join(groups.filter("__gone and __again").select("doc_id"), "doc_id", "left_semi").filter(linked).select("doc_id", F.col("class_id").alias("__class")).distinct()
    again = _with_class(marked.filter("__again").select(*docs.columns)).join(gone, ["doc_id", "__class"], "left_anti")
    # a row that repeats id and text is one document
    return once.unionAll(again.select(*docs.columns).dropDuplicates(["doc_id", "text"]))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _prepare(spark)
    return _counted(suffix_dedup.remove_repeats(docs))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _prepare(spark)
    return _counted(pii.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _prepare(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_join", one_of_each_group),
    ("suffix_dedup", drop_repeats),
    ("pii", mask_personal_data),
    ("packing", pack),
]

#: The classifier, the index and the tokenizer are not expressible in SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each leaves is written to the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        scratch = Scratch(spark)
        docs = scratch.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:  # what the stage has read is not needed again
            before.__exit__()
        before = scratch
    return STAGES[-1][1](spark, docs, sf_dir)
