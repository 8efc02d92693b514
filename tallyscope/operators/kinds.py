"""Column kinds (numeric / categorical / datetime / other), decided from the schema only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

NUMERIC_TYPES = (
    T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType,
)
INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOAT_TYPES = (T.FloatType, T.DoubleType)
DATETIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def kind_of(dt: T.DataType) -> str:
    if isinstance(dt, NUMERIC_TYPES):
        return "numeric"
    if isinstance(dt, T.StringType):
        return "categorical"
    if isinstance(dt, DATETIME_TYPES):
        return "datetime"
    return "other"


def kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: kind_of(f.dataType) for f in df.schema.fields}


def columns_of(df: DataFrame, kind: str, first: int | None = None) -> list[str]:
    cols = [f.name for f in df.schema.fields if kind_of(f.dataType) == kind]
    return cols if first is None else cols[:first]


def numeric_cols(df: DataFrame, first: int | None = None) -> list[str]:
    return columns_of(df, "numeric", first)


def categorical_cols(df: DataFrame, first: int | None = None) -> list[str]:
    return columns_of(df, "categorical", first)


def datetime_cols(df: DataFrame, first: int | None = None) -> list[str]:
    return columns_of(df, "datetime", first)


def q(name: str) -> str:
    """Back-quote a column name for F.col / SQL."""
    return "`" + name.replace("`", "``") + "`"
