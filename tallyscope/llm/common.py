"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tallyscope.operators.rowindex import BUCKET, bucketed
from tallyscope.session import new_scratch_path, scratch_dir

#: Characters of text handled at once inside a task; a longer text is a block of its own.
BLOCK_CHARS = 1 << 20
#: Rows of whole texts that Spark hands to a worker at once.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package as the driver does.

    On a cluster the package comes with ``--py-files`` or the image, and this
    path simply does not exist there.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    have = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (have, root) if x)


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python by ``BATCH_ROWS`` rows, where Spark's default is ten times as many.

    The executor holds a batch outside its heap, twice while it grows, and the
    worker once more; both keep much of the room. It holds for the session's later queries, too; a
    smaller number of the session's own stays.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def give_back() -> None:
    """Return the memory that Arrow keeps, at a task's end; the worker may go on with another operator."""
    pa.default_memory_pool().release_unused()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, by any path that Spark's readers can open."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def reliable(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint in the shared folder.

    Survives lost executors; Spark's cleaner removes the files with the last
    reference where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on.
    """
    scratch_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Parquet tables in the shared folder that are gone when the ``with`` block ends.

    For data that is scanned more than once, by few columns each time, and is
    needed by eager steps of the block only.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` as a compressed table, read back."""
        path = new_scratch_path(self.spark, name)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.parquet(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in self.paths:
            place = hadoop(path)
            place.getFileSystem(conf).delete(place, True)


def text_blocks(texts: list[str], limit: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts make up about ``limit`` characters."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def column_texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A string column of a batch, null as the empty text."""
    return [t or "" for t in batch.column(name).to_pylist()]


def order_buckets(df: DataFrame, column: str, buckets: int) -> tuple[DataFrame, str]:
    """Add ``bucket``: which of about ``buckets`` even ranges of a column a row is in.

    Cut points are approximate quantiles of the whole column; any cut points are
    right, they only decide how even the buckets are. Order-preserving:
    a smaller value never has a larger bucket. Nulls come first.
    """
    from pyspark.ml.feature import Bucketizer

    if not isinstance(df.schema[column].dataType, NumericType):
        tagged, _ = bucketed(df, [column], rows_per_bucket=max(1, df.count() // buckets))
        return tagged.withColumnRenamed(BUCKET, "bucket"), "bucket"
    low = F.coalesce(F.col(column).cast("double"), F.lit(float("-1e300")))
    cuts = []
    if buckets > 1:
        probs = [i / buckets for i in range(1, buckets)]
        row = df.agg(F.percentile_approx(low, probs, 10 * buckets).alias("q")).first()
        cuts = sorted(set(row.q or []))
    name = "bucket"
    if not cuts:
        return df.withColumn(name, F.lit(0)), name
    keyed = df.withColumn("__order_value", low)
    out = Bucketizer(
        splits=[float("-inf"), *cuts, float("inf")], inputCol="__order_value", outputCol="__order_bucket"
    ).transform(keyed)
    return out.withColumn(name, F.col("__order_bucket").cast("int")).drop("__order_value", "__order_bucket"), name


#: Bits of a ``bit_table``, as a power of two: 512 KB, whatever the input.
TABLE_BITS = 22


def spot(column: str | Column) -> Column:
    """Where a value stands in a bit table."""
    return F.shiftrightunsigned(F.xxhash64(column), 64 - TABLE_BITS)


def bit_table(values: DataFrame, where: Column) -> np.ndarray:
    """A bit for the spot ``where`` of every row, as words.

    Of fixed size, so it can be broadcast: it tells most values that are not
    among these, and the more there are the fewer. What passes it is joined.
    """
    words = (
        values.select(where.alias("spot"))
        .groupBy(F.shiftright("spot", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 as int))")).alias("bits"))
        .toArrow()
    )
    bits = np.zeros(1 << (TABLE_BITS - 6), np.int64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return bits


def in_table(bits: np.ndarray, spots: np.ndarray) -> np.ndarray:
    """Which spots have their bit."""
    return ((bits[spots >> 6] >> (spots & 63)) & 1).astype(bool)
