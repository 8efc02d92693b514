"""Quartile bucket digests of documents.

A digest counts the hashed byte triplets of a text in 128 buckets, writes for
each bucket which quartile of the counts it lies in (two bits), and puts a
logarithmic length and the ratios of the quartiles in front. Two digests are
compared by a bounded score: the differences of the bucket codes (a step of
three counts double) and of the head, against the largest difference the two
digests could have.

``neighbour_digests`` pairs every document with the next one by id. Ids are
cut into even ranges, rows are dealt by range and sorted in it, and the first
row of each range is sent to the range before as well (after the last document
comes the first), so the pairing is one shuffle and a scan without any window
over the whole table. What the driver sees is the first id of each range.

Defined cases: a null text is the empty text and keeps ``n_chars`` 0; rows with
one id are ordered by text; a null id comes first; a single document is its own
neighbour; extra columns are passed over; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.llm.common import order_buckets, partitions, table

BUCKETS = 128
#: Weight of one step of the length code, and the most that the head can add.
LENGTH_STEP, HEAD_MOST = 1.0, 24.0
_FULL = np.arange(4)
#: Cost of two bucket codes: their distance, and 6 for the widest.
CODE_COST = np.abs(_FULL[:, None] - _FULL[None, :]) * np.where(np.abs(_FULL[:, None] - _FULL[None, :]) == 3, 2, 1)
#: Most that a bucket could differ, by its two codes.
CODE_MOST = np.maximum(np.maximum(_FULL, 3 - _FULL)[:, None], np.maximum(_FULL, 3 - _FULL)[None, :])


def bucket_counts(data: bytes) -> np.ndarray:
    """Counts of hashed byte triplets."""
    b = np.frombuffer(data, np.uint8)
    if len(b) < 3:
        return np.zeros(BUCKETS, np.int64)
    wide = b.astype(np.uint32)
    triplet = wide[:-2] | (wide[1:-1] << np.uint32(8)) | (wide[2:] << np.uint32(16))
    return np.bincount((triplet * np.uint32(2654435761)) >> np.uint32(25), minlength=BUCKETS)


def fingerprint(text: str) -> str:
    """The digest of a text, 70 hex digits: length code, quartile ratios, bucket codes."""
    data = text.encode()
    counts = bucket_counts(data)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    length = min(255, int(np.log1p(len(data)) / np.log(1.1)))
    ratios = [int(q * 16 // max(1, q3)) % 16 if q3 else 0 for q in (q1, q2)]
    packed = codes.reshape(-1, 4) @ np.array([64, 16, 4, 1], np.uint8)
    return bytes([length, ratios[0] * 16 + ratios[1], len(data) % 251]).hex() + packed.astype(np.uint8).tobytes().hex()


def codes_of(digest: str) -> tuple[np.ndarray, bytes]:
    raw = bytes.fromhex(digest)
    body = np.frombuffer(raw[3:], np.uint8)
    return ((body[:, None] >> np.array([6, 4, 2, 0], np.uint8)) & 3).ravel(), raw[:3]


def likeness(a: str, b: str) -> float:
    """1 for equal digests, down to 0 for the largest difference they could have."""
    if a == b:
        return 1.0
    (x, hx), (y, hy) = codes_of(a), codes_of(b)
    head = LENGTH_STEP * abs(hx[0] - hy[0]) + sum(abs(hx[1] // k % 16 - hy[1] // k % 16) for k in (1, 16)) + (hx[2] != hy[2])
    low, high = np.minimum(x, y), np.maximum(x, y)
    cost = CODE_COST[low, high].sum() + min(HEAD_MOST, head)
    # buckets that both leave at the lowest quartile say little: only the others count
    most = CODE_MOST[low, high][high > 0].sum() * 1.0 + HEAD_MOST
    return float(max(0.0, 1.0 - cost / most)) if most else 0.0


def edited(text: str, other: str) -> str:
    """``text`` with its last quarter (in code points) replaced by the start of ``other``."""
    k = len(text) // 4
    return text[: len(text) - k] + other[:k]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``fingerprint`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, pa.string())], names=[id_col, "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, fingerprint string")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(id, text, next text) of the rows of each range; the row sent along only ends it."""
    held = None
    for batch in batches:
        for bucket, late, key, text in zip(
            batch.column("bucket").to_pylist(), batch.column("late").to_pylist(), batch.column("key"), batch.column("text"), strict=True
        ):
            text = text.as_py() or ""
            if held is not None and held[0] == bucket:
                yield held[1], held[2], text
                held = None
            if not late:
                held = (bucket, key.as_py(), text)


def neighbour_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's digest, that of its edited text, and their likeness to each other and to the next one's."""
    spark = docs.sparkSession
    n = partitions(spark)
    base = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    dealt, bucket = order_buckets(base, "key", 4 * n)
    # a row for each range: its first id (null before all others)
    first = dealt.groupBy(bucket).agg(F.min("key").alias("first"), F.max(F.col("key").isNull().cast("int")).alias("has_null")).orderBy(bucket).collect()
    kind = docs.schema[id_col].dataType.simpleString()
    heads = [(r[bucket], None if r.has_null else r["first"], first[i - 1][bucket]) for i, r in enumerate(first)]
    edge = spark.createDataFrame(heads, f"head_bucket int, head {kind}, before int")
    # as many rows as ranges, so a broadcast of known size
    sent = (
        dealt.join(F.broadcast(edge), (F.col(bucket) == F.col("head_bucket")) & F.col("key").eqNullSafe(F.col("head")), "left")
        .withColumn("to", F.explode(F.array(F.struct(F.col(bucket).alias("b"), F.lit(False).alias("late")), F.struct(F.col("before").alias("b"), F.lit(True).alias("late")))))
        .filter("to.b is not null")
        .select(F.col("to.b").alias("bucket"), F.col("to.late").alias("late"), "key", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        prints: dict[str, str] = {}

        def out(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            types = [arrow_key, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

        for key, text, after in _pairs(batches):
            own = prints.get(text) or fingerprint(text)
            nxt = fingerprint(after)
            prints = {after: nxt}
            made = edited(text, after)
            made_print = fingerprint(made)
            rows.append((key, len(text), hashlib.sha256(made.encode()).hexdigest(), own, made_print, likeness(own, made_print), likeness(own, nxt)))
            size += 1
            if size % 2000 == 0:
                yield out(rows)
                rows = []
        if rows:
            yield out(rows)

    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    arrow_key = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(kind, pa.int64())
    return (
        sent.repartition(n, "bucket")
        .sortWithinPartitions("bucket", "late", F.col("key").asc_nulls_first(), F.col("text").asc_nulls_first())
        .mapInArrow(run, f"`{id_col}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    )


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document of ``documents`` and of its edited text."""
    return neighbour_digests(table(spark, sf_dir, "documents"))
