"""Global row index and prefix sums in a total key order, without a single-partition sort.

``row_number() over (order by k)`` with no partition moves every row into one
task. Instead:

1. the order columns and a hash of the whole row make a total key: rows that
   differ are ordered the same way on every run, and a value that a third of
   all rows share is spread over many ranges;
2. a sample of the key, sorted by Spark, gives cut keys; a range that turns out
   to hold more than twice its share is cut again by a sample of its own;
3. a row's range is the number of cuts up to its key, by binary search in one
   array literal (log2 of the cuts in steps, whatever their number);
4. rows a range are counted (one number a range to the driver), and a position
   is the row's number within its range plus the counts before it. Sums up to a
   row are built alike.

Cuts depend only on the data and a fixed seed and are literals from then on, so
re-execution after an executor loss yields the same ranges and index.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rowkey import row_key
from ..session import materialize
from .kinds import q

#: Rows of a range: about a thousandth of all, within these bounds.
LEAST_ROWS_PER_BUCKET, TARGET_ROWS_PER_BUCKET = 16_384, 2_000_000
SAMPLES_PER_BUCKET = 20
#: Ranges that one sample cuts; more come from cutting these again.
FIRST_CUTS = 1024
#: Times that ranges over twice their share are cut again.
RECUTS = 4
BUCKET, TIE = "__b", "__tie"


def _search(key: Column, cuts: Column, n: int) -> Column:
    """Number of cuts <= key, by binary search over a sorted array of ``n``."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(n.bit_length()))])

    def probe(k: Column) -> Callable:
        return lambda lo, step: F.when((lo + step <= n) & (F.get(cuts, lo + step - 1) <= k), lo + step).otherwise(lo)

    # the one-element transform builds the key once a row
    return F.get(F.transform(F.array(key), lambda k: F.aggregate(steps, F.lit(0), probe(k))), F.lit(0))


def _cut_array(df: DataFrame, keys: list[str], rows: list[tuple]) -> Column:
    """Cut keys as one literal array of structs, which the optimizer folds."""
    kinds = [df.schema[k].dataType for k in keys]
    return F.array(*[F.struct(*[F.lit(v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(r, kinds))]) for r in rows])


def _tagged(df: DataFrame, keys: list[str], cuts: list[tuple]) -> DataFrame:
    if not cuts:
        return df.withColumn(BUCKET, F.lit(0))
    key = F.struct(*[F.col(q(k)).alias(f"k{i}") for i, k in enumerate(keys)])
    return df.withColumn(BUCKET, _search(key, _cut_array(df, keys, cuts), len(cuts)))


def _sampled_cuts(df: DataFrame, keys: list[str], buckets: int, n: int, seed: int) -> list[tuple]:
    """Different keys that cut ``n`` rows into about ``buckets`` even ranges."""
    frac = min(1.0, SAMPLES_PER_BUCKET * buckets / max(1, n))
    place = Window.orderBy(*[F.col(q(k)) for k in keys])  # the sample: 20 rows a range, 1,024 ranges at most
    sample = df.select(*[F.col(q(k)) for k in keys]).sample(False, frac, seed).withColumn("__place", F.row_number().over(place) - 1)
    step = max(1, round(n * frac / buckets))
    rows = sample.where((F.col("__place") % step == 0) & (F.col("__place") > 0)).drop("__place").collect()
    return list(dict.fromkeys(tuple(r) for r in rows))


def _sizes(tagged: DataFrame, n: int) -> list[int]:
    got = {r[BUCKET]: r["n"] for r in tagged.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("n")).collect()}
    return [int(got.get(b, 0)) for b in range(n)]


def with_tie(df: DataFrame, order_by: list[str]) -> tuple[DataFrame, list[str]]:
    """``df`` with the hash that orders rows whose ``order_by`` is the same, and the total key."""
    return df.withColumn(TIE, row_key(df)[0]), [*order_by, TIE]


def bucketed(df: DataFrame, order_by: list[str], n_rows: int | None = None,
             rows_per_bucket: int | None = None, seed: int = 42, write: bool = False) -> tuple[DataFrame, list[int]]:
    """``df`` tagged with ``__b`` (the range of its key; a smaller key never has a larger one) and the
    row count of every range. ``order_by`` should be a total key (``with_tie``): only rows that are
    equal in it stay together whatever their number. ``write``: keep the tagged rows in the shared
    folder, so that ranges are looked up once (for narrow rows that are scanned again)."""
    n = df.count() if n_rows is None else n_rows
    if rows_per_bucket is None:
        rows_per_bucket = min(TARGET_ROWS_PER_BUCKET, max(LEAST_ROWS_PER_BUCKET, n // FIRST_CUTS))
    buckets = max(1, math.ceil(n / max(1, rows_per_bucket)))
    if buckets == 1:
        return _tagged(df, order_by, []), [n]
    cuts = _sampled_cuts(df, order_by, min(FIRST_CUTS, buckets), n, seed)
    def tag() -> tuple[DataFrame, list[int]]:
        tagged = _tagged(df, order_by, cuts)
        tagged = materialize(tagged, "ranges") if write else tagged
        return tagged, _sizes(tagged, len(cuts) + 1)

    tagged, sizes = tag()
    for again in range(RECUTS):
        large = [b for b, size in enumerate(sizes) if size > 2 * rows_per_bucket]
        more = []
        for i in range(0, len(large), 16):  # so many at once that a sample stays small
            part = large[i:i + 16]
            rows = sum(sizes[b] for b in part)
            more += _sampled_cuts(tagged.where(F.col(BUCKET).isin(part)), order_by, min(16 * FIRST_CUTS, 2 * math.ceil(rows / rows_per_bucket)), rows, seed + again + 1)
        new = set(more) - set(cuts)
        if not new:  # what is left over the target can't be told apart
            break
        cuts = _sorted_cuts(df, order_by, [*cuts, *new])
        tagged, sizes = tag()
    return tagged, sizes


def _sorted_cuts(df: DataFrame, keys: list[str], cuts: list[tuple]) -> list[tuple]:
    """Cut keys in Spark's order (nulls first, text by bytes)."""
    frame = df.sparkSession.createDataFrame(cuts, df.select(*[F.col(q(k)) for k in keys]).schema)
    return [tuple(r) for r in frame.orderBy(*[F.col(q(k)) for k in keys]).collect()]


def before_each(values: list, zero=0) -> list:
    """What lies before each range: running totals, the first is ``zero``."""
    out, acc = [], zero
    for v in values:
        out.append(acc)
        acc += v
    return out


def at_bucket(values: list, kind: str) -> Column:
    """The value of a row's range, from a literal array."""
    if len(values) == 1:
        return F.lit(values[0]).cast(kind)
    return F.get(F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>"), F.col(BUCKET))


def with_row_index(df: DataFrame, order_by: list[str], name: str = "idx", n_rows: int | None = None,
                   rows_per_bucket: int | None = None, seed: int = 42) -> DataFrame:
    """``df`` plus a 0-based BIGINT ``name`` giving each row's position in ``order_by`` order
    (rows that are the same there: by a hash of the row)."""
    total, keys = with_tie(df, order_by)
    tagged, counts = bucketed(total, keys, n_rows, rows_per_bucket, seed, write=True)
    w = Window.partitionBy(BUCKET).orderBy(*[F.col(q(k)) for k in keys])
    place = (F.row_number().over(w) - 1 + at_bucket(before_each(counts), "bigint")).cast("bigint")
    return tagged.withColumn(name, place).drop(BUCKET, TIE)
