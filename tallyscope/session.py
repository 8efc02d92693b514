"""Session helpers: a local session for tests/bench and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tallyscope") -> SparkSession:
    """A local session configured the way the tests and the bench expect.

    On a cluster, build the session yourself, in any time zone; the library
    reads ``spark.checkpoint.dir`` for the shared scratch folder.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("TALLYSCOPE_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _conf_checkpoint_dir(spark: SparkSession) -> str | None:
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d
    try:
        d = spark.sparkContext.getCheckpointDir()
    except Exception:  # older API surface
        d = None
    return d or None


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts and round-trip files.

    Read from ``spark.checkpoint.dir`` (what the cluster names). Only when it is
    unset *and* the session is local (tests, bench) do we create our own.
    """
    d = _conf_checkpoint_dir(spark)
    if d:
        return d
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; a shared folder is required on a cluster"
        )
    d = tempfile.mkdtemp(prefix="tallyscope-ckpt-")
    atexit.register(shutil.rmtree, d, ignore_errors=True)  # ours alone, so it goes with the process
    spark.sparkContext.setCheckpointDir(d)
    return spark.sparkContext.getCheckpointDir() or d


def new_scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-path of the shared scratch folder."""
    import uuid

    base = scratch_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str = "materialized") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    For a derived frame that later work scans several times: the lineage is
    cut, later passes are columnar scans with pruning, and a lost executor
    costs nothing. Without a shared folder (a cluster that names none) the
    frame is persisted instead.
    """
    from pyspark import StorageLevel

    spark = df.sparkSession
    try:
        path = new_scratch_path(spark, name)
    except RuntimeError:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@contextmanager
def written(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """``df`` as a table in the shared folder, gone when the block ends: for data that eager steps scan more than once."""
    from pyspark import StorageLevel

    spark = df.sparkSession
    try:
        path = new_scratch_path(spark, name)
    except RuntimeError:  # a cluster that names no shared folder
        kept = df.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            yield kept
        finally:
            kept.unpersist()
        return
    df.write.parquet(path)
    try:
        yield spark.read.parquet(path)
    finally:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
