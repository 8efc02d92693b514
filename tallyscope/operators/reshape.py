"""Reshaping helpers (P4 melt, P8 null indicators) as plain DataFrame projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kinds import kind_of, q


def melt(df: DataFrame, ids: list[str], values: list[str] | None = None, var_name: str = "column",
         value_name: str = "value", dropna: bool = True) -> DataFrame:
    """Wide -> long (ids..., column, value), NULL values removed by default.

    Values share one type: DOUBLE when every melted column is numeric, STRING otherwise.
    One Generate in the same stage as the scan - no shuffle."""
    values = [c for c in df.columns if c not in ids] if values is None else values
    numeric = all(kind_of(df.schema[c].dataType) == "numeric" for c in values)
    t = "double" if numeric else "string"
    items = [F.struct(F.lit(c).alias(var_name), F.col(q(c)).cast(t).alias(value_name)) for c in values]
    out = df.select(*[F.col(q(i)) for i in ids], F.inline(F.array(*items)))
    return out.where(F.col(value_name).isNotNull()) if dropna else out


def null_indicators(df: DataFrame, cols: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """1 where the value is NULL, else 0, per column (``keep`` columns pass through)."""
    cols = df.columns if cols is None else cols
    return df.select(*[F.col(q(k)) for k in (keep or [])],
                     *[F.col(q(c)).isNull().cast("int").alias(c) for c in cols])
