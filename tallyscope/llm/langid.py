"""Language identification by multinomial naive Bayes over hashed character n-grams.

Training counts the hashed n-grams of every training text in its task, one
count vector a language, and sums the vectors by (language, bucket) with a
partial aggregate: what is shuffled is bounded by tasks x languages x buckets,
whatever the texts' length. The smoothed log-probability matrix (languages x
buckets, its size checked) is broadcast. Scoring hashes a block of texts at
once, gathers the columns of the matrix for its n-grams and sums them by text.

Defined cases: a null text, or one without any letter, is ``und`` with score
0; a null language is not learned from; without any training text every text
is ``und``; equal scores go to the smaller name; extra columns are passed
over.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.llm.common import column_texts, table, text_blocks

#: Hash buckets, n-gram lengths, additive smoothing.
BITS, ORDERS, SMOOTHING = 14, (2, 3), 0.5
#: Most bytes that the broadcast matrix may have.
MAX_MATRIX_BYTES = 256 << 20
UNDETERMINED = "und"

_MAYBE_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether a text has a letter; numbers that are no digits, as ½ or Ⅷ, are none."""
    return any(m.group().isalpha() for m in _MAYBE_LETTER.finditer(text))


def ngram_buckets(texts: list[str], orders: tuple[int, ...] = ORDERS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of lower-cased texts, and the index of the text each is of.

    Texts are padded by a space at both ends; n-grams never cross texts.
    """
    padded = [f" {t.lower()} " for t in texts]
    points = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(p) for p in padded])
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(ends, prepend=0))
    buckets, owners = [], []
    hashed = points * np.uint32(2654435761)
    for n in range(2, max(orders) + 1):
        hashed = (hashed[:-1] ^ (hashed[:-1] >> np.uint32(15))) * np.uint32(2246822519) + points[n - 1 :] * np.uint32(3266489917)
        if n in orders:
            same = owner[: len(hashed)] == owner[n - 1 :]
            mixed = (hashed ^ (hashed >> np.uint32(13))) * np.uint32(2654435761)
            buckets.append((mixed >> np.uint32(32 - bits))[same])
            owners.append(owner[: len(hashed)][same])
    return np.concatenate(buckets), np.concatenate(owners)


@dataclass
class Model:
    """Learned languages in order of name, log priors and the log-probability matrix."""

    languages: list[str]
    prior: np.ndarray
    matrix: np.ndarray

    def score(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """The most probable language of each text and its posterior probability."""
        if not self.languages:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        buckets, owners = ngram_buckets(texts)
        total = np.empty((len(texts), len(self.languages)))
        for k, column in enumerate(self.matrix):
            total[:, k] = np.bincount(owners, column[buckets], minlength=len(texts)) + self.prior[k]
        best = total.argmax(axis=1)
        top = total.max(axis=1)
        posterior = 1 / np.exp(total - top[:, None]).sum(axis=1)
        names, scores = [], []
        for t, b, p in zip(texts, best.tolist(), posterior.tolist(), strict=True):
            known = has_letter(t)
            names.append(self.languages[b] if known else UNDETERMINED)
            scores.append(p if known else 0.0)
        return names, scores


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from every row with a text and a language."""
    size = 1 << BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in batches:
            texts, langs = column_texts(batch), batch.column("lang").to_pylist()
            for a, b in text_blocks(texts):
                buckets, owners = ngram_buckets(texts[a:b])
                names = sorted(set(langs[a:b]))
                code = np.array([names.index(x) for x in langs[a:b]], np.int64)
                found = np.bincount(code[owners] * size + buckets, minlength=len(names) * size).reshape(-1, size)
                for k, name in enumerate(names):
                    counts[name] = counts.get(name, 0) + found[k]
                    seen[name] = seen.get(name, 0) + int((code == k).sum())
        for name, found in counts.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * (len(at) + 1), pa.string()),
                    pa.array(np.append(at, -1), pa.int32()),
                    pa.array(np.append(found[at], seen[name]), pa.int64()),
                ],
                names=["lang", "bucket", "n"],
            )

    rows = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sums = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = sums.toArrow()
    # a row a language and bucket: the matrix itself, checked before it is sent out
    langs = sorted(set(found.column("lang").to_pylist()))
    if len(langs) * size * 4 > MAX_MATRIX_BYTES:
        raise ValueError(f"{len(langs)} languages are too many for a matrix of {MAX_MATRIX_BYTES} bytes")
    matrix, docs_of = np.zeros((len(langs), size)), np.zeros(len(langs))
    at = {x: i for i, x in enumerate(langs)}
    row = np.array([at[x] for x in found.column("lang").to_pylist()], np.int64)
    bucket, n = found.column("bucket").to_numpy(), found.column("n").to_numpy()
    inner = bucket >= 0
    matrix[row[inner], bucket[inner]] = n[inner]
    docs_of[row[~inner]] = n[~inner]
    matrix += SMOOTHING
    matrix = np.log(matrix / matrix.sum(axis=1, keepdims=True)) if langs else matrix
    return Model(langs, np.log(docs_of / max(1, docs_of.sum())) if langs else docs_of, matrix.astype(np.float32))


def predict(docs: DataFrame, model: Model, keep: dict[str, Column], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` with ``lang_pred`` and ``score`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*[c.alias(n) for n, c in keep.items()])
    kept_names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column_texts(batch, "__text")
            names, scores = [], []
            for a, b in text_blocks(texts):
                x, y = shared.value.score(texts[a:b])
                names += x
                scores += y
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in kept_names], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*kept_names, "lang_pred", "score"]
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return docs.select(*[c.alias(n) for n, c in keep.items()], F.col(text_col).alias("__text")).mapInArrow(run, f"{schema}, lang_pred string, score double")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all ``documents``, learned from those whose crc32(doc_id) mod 3 is not 1."""
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    model = train(docs.filter(fold != 1))
    return predict(docs, model, {"doc_id": F.col("doc_id"), "held_out": F.coalesce(fold == 1, F.lit(False))})
