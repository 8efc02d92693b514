"""Canonical row keys: rows of any column types that can be hashed, grouped and compared.

``canonical`` maps a value to a form in which equal values are identical: the
entries of a map are sorted by key, -0.0 is 0.0, every NaN is one NaN, and
nested types are mapped inside out. ``with_row_key`` adds a 128-bit hash of the
whole row; two rows with different hashes differ, rows with one hash are
compared in full by whoever needs to be exact (operators.duplicates).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.kinds import q

#: The two halves of a row's hash.
KEY = ("__key_hi", "__key_lo")


def needs_form(dt: T.DataType) -> bool:
    """Whether a type's values must be mapped before they can be grouped."""
    if isinstance(dt, T.ArrayType):
        return needs_form(dt.elementType)
    if isinstance(dt, T.StructType):
        return any(needs_form(f.dataType) for f in dt.fields)
    return isinstance(dt, (T.MapType, T.FloatType, T.DoubleType, T.VariantType))


def canonical(c: Column, dt: T.DataType) -> Column:
    """``c`` in a form that is identical for equal values; null stays null."""
    if not needs_form(dt):
        return c
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return F.when(F.isnan(c), F.lit(float("nan")).cast(dt)).otherwise(c + F.lit(0.0).cast(dt))
    if isinstance(dt, T.MapType):
        entry = F.transform(F.map_entries(c), lambda e: F.struct(
            canonical(e.getField("key"), dt.keyType).alias("key"), canonical(e.getField("value"), dt.valueType).alias("value")))
        return F.array_sort(entry)
    if isinstance(dt, T.ArrayType):
        return F.transform(c, lambda e: canonical(e, dt.elementType))
    if isinstance(dt, T.StructType):
        fields = [canonical(c.getField(f.name), f.dataType).alias(f"f{i}") for i, f in enumerate(dt.fields)]
        return F.when(c.isNotNull(), F.struct(*fields))
    return F.to_json(c)  # a variant's JSON has its keys in order


def row_values(df: DataFrame) -> list[Column]:
    """Every column of ``df`` in its canonical form."""
    return [canonical(F.col(q(f.name)), f.dataType) for f in df.schema.fields]


def row_key(df: DataFrame) -> list[Column]:
    """The two 64-bit halves of a hash of the whole row.

    Spark's hash passes over nulls, so which columns are null is hashed as well.
    """
    values = row_values(df) + [F.col(q(f.name)).isNull() for f in df.schema.fields if f.nullable]
    return [F.xxhash64(F.lit(i), *values).alias(name) for i, name in enumerate(KEY)]


def with_row_key(df: DataFrame) -> DataFrame:
    """``df`` and the two halves of each row's hash."""
    return df.select("*", *row_key(df))
