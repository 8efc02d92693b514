"""Duplicate rows of any column types, without shuffling the rows that are unique.

1. Every row becomes its 128-bit canonical key (16 bytes); keys are counted with
   map-side combine, so a row with many copies ships one key a task.
2. A key that occurs once belongs to a row that has no copy. Rows of the other
   keys are compared in full, on their canonical values: two different rows
   whose keys collide stay two rows.

Nulls equal nulls, NaN equals NaN, -0.0 equals 0.0, and two maps are equal if
they hold the same entries in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rowkey import KEY, canonical, needs_form, with_row_key
from ..session import materialize, written
from .kinds import q

#: Repeated keys that may be broadcast: 16 bytes each, 16 MB in all.
BROADCAST_KEYS = 1_000_000


def _compared(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` with a canonical twin of each column that can't be grouped as it is, and the columns to compare."""
    twins = {f"__same{i}": canonical(F.col(q(f.name)), f.dataType) for i, f in enumerate(df.schema.fields) if needs_form(f.dataType)}
    plain = [f.name for f in df.schema.fields if not needs_form(f.dataType)]
    return df.select("*", *[v.alias(n) for n, v in twins.items()]), plain + list(twins)


def key_counts(df: DataFrame) -> DataFrame:
    """(key halves, n): how many rows have each canonical key."""
    return with_row_key(df).select(*KEY).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))


def duplicate_stats(df: DataFrame) -> dict:
    """Rows, distinct rows and duplicates (rows - distinct)."""
    if not df.columns:
        n = df.count()
        return {"rows": n, "distinct": min(n, 1), "duplicates": max(0, n - 1)}
    with written(key_counts(df), "row-keys") as keys:
        row = keys.agg(F.sum("n").alias("rows"), F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") > 1).alias("again")).first()
        rows, distinct = int(row["rows"] or 0), int(row["once"])
        if row["again"]:
            distinct += _in_full(df, keys.where("n > 1").select(*KEY), int(row["again"])).count()
    return {"rows": rows, "distinct": distinct, "duplicates": rows - distinct}


def _of_keys(df: DataFrame, keys: DataFrame, n_keys: int, how: str) -> DataFrame:
    """Rows whose key is (``left_semi``) or is not (``left_anti``) among ``keys``."""
    side = F.broadcast(keys) if n_keys <= BROADCAST_KEYS else keys
    return with_row_key(df).join(side, list(KEY), how)


def _in_full(df: DataFrame, keys: DataFrame, n_keys: int) -> DataFrame:
    """The different rows among those with a repeated key, compared value by value."""
    again = _of_keys(df, keys, n_keys, "left_semi")
    compared, columns = _compared(again.select(*[F.col(q(c)) for c in df.columns], *KEY))
    return compared.dropDuplicates([*KEY, *[c for c in columns if c not in KEY]]).select(*[F.col(q(c)) for c in df.columns])


def drop_duplicates(df: DataFrame) -> DataFrame:
    """One row of each set of equal rows. Rows without a copy pass through without a shuffle
    where the repeated keys are few enough to be broadcast."""
    if not df.columns:
        return df.limit(1)
    if df.isStreaming:
        compared, columns = _compared(df)
        return compared.dropDuplicates(columns).select(*[F.col(q(c)) for c in df.columns])
    keys = materialize(key_counts(df).where("n > 1").select(*KEY), "repeated-keys")
    n_keys = keys.count()
    if not n_keys:
        return df
    if n_keys > BROADCAST_KEYS:  # most rows move anyway: compare them all at once
        compared, columns = _compared(with_row_key(df))
        return compared.dropDuplicates(columns).select(*[F.col(q(c)) for c in df.columns])
    once = _of_keys(df, keys, n_keys, "left_anti").select(*[F.col(q(c)) for c in df.columns])
    return once.unionAll(_in_full(df, keys, n_keys))
