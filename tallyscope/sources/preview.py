"""S6 head preview and S7 seeded random sample.

The sample order is ``md5(key || ':' || seed)`` then the key: deterministic
under any repartitioning or re-execution, and reproducible in SQL. A large
sample (e.g. 50,000 plot points) is not taken with one global top-k, whose
final merge would receive partitions x n rows in a single task; instead one
aggregate counts how many hashes fall under a ladder of thresholds, the
smallest threshold holding n rows is kept as a filter, and the exact top-n is
taken from those ~2n rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import sample_order
from ..operators.kinds import q


def head(df: DataFrame, n: int, order_by: list[str]) -> DataFrame:
    """First n rows in key order (TakeOrderedAndProject, n rows per task)."""
    return df.orderBy(*[F.col(q(k)) for k in order_by]).limit(n)


def _hex_threshold(j: int) -> str:
    """32-hex-digit string of 2**(128-j): hashes below it are a 2**-j share."""
    return format(1 << (128 - j), "032x") if j > 0 else "g"  # "g" sorts after every hex digit


def seeded_sample(df: DataFrame, n: int, key_cols: list[str], seed: int = 42,
                  order_cols: list[str] | None = None) -> DataFrame:
    """n rows in md5(key:seed) order (all rows when the table is smaller).

    Adds no columns; ``order_cols`` (default ``key_cols``) break md5 ties.
    """
    order_cols = key_cols if order_cols is None else order_cols
    h = sample_order(key_cols, seed)
    tagged = df.withColumn("__h", h)
    ordering = [F.col("__h")] + [F.col(q(c)) for c in order_cols]
    ladder = list(range(0, 48))
    row = tagged.agg(*[F.count_if(F.col("__h") < F.lit(_hex_threshold(j))).alias(f"c{j}") for j in ladder]).first()
    best = max((j for j in ladder if row[f"c{j}"] >= n), default=0)
    if best > 0:
        tagged = tagged.where(F.col("__h") < F.lit(_hex_threshold(best)))
    return tagged.orderBy(*ordering).limit(n).drop("__h")
