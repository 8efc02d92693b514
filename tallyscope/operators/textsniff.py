"""Type sniffing of text columns (A22 date-like rate, A23 numeric-like rate, A24 date order).

Rates are over all non-null values of a column. Every row is turned into its
(column, value) pairs and counted by column with map-side combine: one scan and
a few rows of shuffle, however many text columns there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DATE_LIKE_PATTERN
from ..functions.scalar import date_slot, looks_numeric, strip_ws
from .kinds import categorical_cols, q


def sniff_rates(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Per text column: non-null values, date-like, numeric-like and '%'-carrying ones."""
    cols = categorical_cols(df) if cols is None else cols
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, n_values bigint, n_date bigint, n_num bigint, n_pct bigint")
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(q(c)).cast("string").alias("value")) for c in cols])
    v = F.col("value")
    return (df.select(F.inline(pairs)).where(v.isNotNull())
            .groupBy("column").agg(
                F.count(v).alias("n_values"),
                F.count_if(v.rlike("^(?:" + DATE_LIKE_PATTERN + ")")).alias("n_date"),
                F.count_if(looks_numeric(v)).alias("n_num"),
                F.count_if(strip_ws(v).contains("%")).alias("n_pct")))


def date_pattern_rate(df: DataFrame, decimals: int = 6) -> DataFrame:
    """Share of date-like values among the non-null ones."""
    return sniff_rates(df).select("column", "n_values", F.col("n_date").alias("n_match"),
                                  F.round(F.col("n_date") / F.col("n_values"), decimals).alias("rate"))


def numeric_text_rate(df: DataFrame, decimals: int = 6) -> DataFrame:
    """Share of numeric-looking values (after stripping symbols), and the share carrying '%'."""
    return sniff_rates(df).select(
        "column", "n_values", F.col("n_num").alias("n_match"),
        F.round(F.col("n_num") / F.col("n_values"), decimals).alias("rate"),
        "n_pct", F.round(F.col("n_pct") / F.col("n_values"), decimals).alias("pct_share"))


def date_order(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Per column, does the first / second slot of a d-m-y shaped value ever
    exceed 12; convention 'dmy', 'mdy' or NULL (contradictory or undecidable).

    Full-column scan, all columns in one aggregate.
    """
    cols = categorical_cols(df) if cols is None else cols
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, first_gt12 boolean, second_gt12 boolean, convention string")
    # slots are projected once per row, then aggregated
    slots = df.select(*[x for i, c in enumerate(cols)
                        for x in (date_slot(F.col(q(c)), 1).alias(f"a{i}"), date_slot(F.col(q(c)), 2).alias(f"b{i}"))])
    pairs = []
    for i, c in enumerate(cols):
        a, b = F.col(f"a{i}"), F.col(f"b{i}")
        both = a.isNotNull() & b.isNotNull()
        pairs.append(F.struct(
            F.lit(c).alias("column"),
            F.coalesce(F.max(F.when(both, a)) > 12, F.lit(False)).alias("first_gt12"),
            F.coalesce(F.max(F.when(both, b)) > 12, F.lit(False)).alias("second_gt12"),
        ))
    long = slots.agg(F.array(*pairs).alias("a")).select(F.inline("a"))
    conv = (F.when(F.col("first_gt12") & F.col("second_gt12"), F.lit(None))
            .when(F.col("first_gt12"), F.lit("dmy"))
            .when(F.col("second_gt12"), F.lit("mdy")))
    return long.select("column", "first_gt12", "second_gt12", conv.cast("string").alias("convention"))
