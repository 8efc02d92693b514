"""The driver's query map: one callable (spark, sf_dir) -> DataFrame per operator.

Float outputs are rounded to 6 decimals (3 for skewness/kurtosis, 1-2 for
percentages as in the audit) so Spark and the SQL oracle agree bit for bit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from .operators import eda as V
from .operators import evidence as EV
from .operators import profile as P
from .operators import textsniff as TS
from .operators.duplicates import drop_duplicates
from .operators.reshape import melt
from .config import DAY_FIRST_FORMATS, FALLBACK_FORMATS, MONTH_FIRST_FORMATS, UNAMBIGUOUS_FORMATS
from .functions.scalar import parse_dates
from .plans.cleaning import CleaningPlan, before_after, category_codes
from .plans.rules import Suggestion, assess, suggestions_frame
from .session import materialize, new_scratch_path
from .sources import csv as CSV
from .sources.preview import head, seeded_sample
from .sources.tables import LINEITEM_ORDER, dated_orders, dirty_orders, read_table, tagged_orders

D6 = 6


def _t(name):
    return lambda spark, sf: read_table(spark, sf, name)


def _do(spark, sf):
    return dirty_orders(spark, sf)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    # ---- profile: dirty_orders ----
    "overview": lambda s, d: P.overview(_do(s, d)),
    "column_summary": lambda s, d: P.column_summary(_do(s, d), ["row_id"]),
    "null_profile": lambda s, d: P.null_profile(_do(s, d)),
    "null_table_sorted": lambda s, d: P.null_table_sorted(_do(s, d)),
    "missing_overall": lambda s, d: P.missing_overall(_do(s, d)),
    "duplicate_count": lambda s, d: P.duplicate_count(_do(s, d)),
    "severity_cards": lambda s, d: P.severity_cards(_do(s, d)),
    "cardinality": lambda s, d: P.cardinality(_do(s, d)),
    "constant_columns": lambda s, d: P.constant_columns(_do(s, d)),
    "mode_values": lambda s, d: P.mode_values(_do(s, d)),
    "sentinels": lambda s, d: P.sentinels(_do(s, d)),
    "out_of_domain": lambda s, d: P.out_of_domain(_do(s, d)),
    "whole_number_floats": lambda s, d: P.whole_number_floats(_do(s, d)),
    # ---- profile: driver tables ----
    "describe_numeric": lambda s, d: P.describe_numeric(_t("lineitem")(s, d), decimals=D6),
    "skew_kurtosis": lambda s, d: P.skew_kurtosis(_t("lineitem")(s, d)),
    "skew_flags": lambda s, d: P.skew_flags(_t("events")(s, d)),
    "audit_stats": lambda s, d: P.audit_stats(_t("lineitem")(s, d), decimals=D6),
    "iqr_outliers": lambda s, d: P.iqr_outliers(_t("events")(s, d)),
    # ---- quantiles by narrowing, as for columns of any size ----
    "describe_small_band": lambda s, d: P.describe_numeric(_t("lineitem")(s, d), decimals=D6),
    # ---- NaN is missing ----
    "nan_describe": lambda s, d: P.describe_numeric(_nan_events(s, d), decimals=D6),
    "nan_null_profile": lambda s, d: P.null_profile(_nan_events(s, d)),
    "nan_iqr_outliers": lambda s, d: P.iqr_outliers(_nan_events(s, d)),
}


def _nan_events(spark, sf):
    """``events`` with every fourth value NaN."""
    gone = F.col("event_id") % 4 == 0
    return _t("events")(spark, sf).withColumn("value", F.when(gone, float("nan")).otherwise(F.col("value").cast("double")))


def _audited(spark, sf, rules=None):
    # the audit and the fit scan this derived table ~15 times: materialise it once
    do = materialize(_do(spark, sf), "dirty-orders")
    return do, assess(do, ["row_id"], rules=rules)


def _suggestions(s, d):
    _, a = _audited(s, d)
    sent = F.array_join(F.transform("sentinels", lambda x: x.cast("string")), ",")
    return suggestions_frame(s, a.suggestions).select(
        F.col("step").cast("bigint").alias("step"), "type", "col", "dim", "lo", "hi",
        F.when(F.size("sentinels") > 0, sent).alias("sentinels"), "to_int", "is_percent")


def _clean_only(types, cols=None, codes=False):
    """Fit and apply only the suggested steps of the given types (on the raw table)."""
    def run(s, d):
        do, a = _audited(s, d, types)
        out, plan = CleaningPlan(a.suggestions).fit_transform(do)
        if codes:
            out = category_codes(out, plan.categories)
        return out if cols is None else out.select(*cols)
    return run


def _cleaning_log(s, d):
    do, a = _audited(s, d)
    plan = CleaningPlan(a.suggestions).fit(do)
    return plan.log_df(s).select(
        F.col("step").cast("bigint").alias("step"), "type", "col", "dim", "n_affected",
        F.round("fitted_num", D6).alias("fitted_num"), "fitted_text")


def _before_after(s, d):
    do, a = _audited(s, d)
    out, plan = CleaningPlan(a.suggestions).fit_transform(do)
    return before_after(do, out)


QUERIES.update({
    "date_pattern_rate": lambda s, d: TS.date_pattern_rate(_do(s, d)),
    "numeric_text_rate": lambda s, d: TS.numeric_text_rate(_do(s, d)),
    "date_order": lambda s, d: TS.date_order(_do(s, d)),
    "suggestions": _suggestions,
    "clean_to_datetime": _clean_only({"to_datetime"}, ["row_id", "order_date_txt", "us_date_txt", "ambiguous_date_txt"]),
    "clean_to_numeric": _clean_only({"to_numeric"}, ["row_id", "amount_txt", "rate_txt"]),
    "clean_dedup": _clean_only({"drop_duplicates"}),
    "clean_category_codes": _clean_only({"to_category"}, ["row_id", "status", "status_code", "sparse_note",
                                                          "sparse_note_code", "const_src", "const_src_code"], codes=True),
    "clean_drop_col": _clean_only({"drop_col"}),
    "clean_fill_median": _clean_only({"fill_median"}, ["row_id", "customer_age"]),
    "clean_fill_mode": _clean_only({"fill_mode"}, ["row_id", "order_date_txt", "status"]),
    "clean_fix_range": _clean_only({"fix_range"}, ["row_id", "customer_age", "discount_rate"]),
    "clean_to_integer": _clean_only({"to_integer"}, ["row_id", "unit_count"]),
    "clean_pipeline": _clean_only(None),
    "cleaning_log": _cleaning_log,
    "before_after": _before_after,
})


def _report_facts(s, d):
    do, a = _audited(s, d)
    return EV.report_facts(do, a)


def _evidence_pack(s, d):
    li = read_table(s, d, "lineitem")
    a = assess(li, LINEITEM_ORDER)
    plan = CleaningPlan(a.suggestions).fit(li)
    return EV.evidence_pack(li, a, plan)


def _csv_roundtrip(s, d):
    src = read_table(s, d, "customer")
    path = new_scratch_path(s, "csv-roundtrip")
    CSV.write_csv(src, path)
    return CSV.read_csv(s, path)


def _csv_latin1(s, d):
    src = read_table(s, d, "documents")
    path = new_scratch_path(s, "csv-latin1")
    CSV.write_csv(src, path, encoding="ISO-8859-1")
    return CSV.read_csv(s, path)


EV_KEY = ["event_id"]


def _date_formats(s, d):
    """All texts of ``dated_orders`` under each of the three conventions that a column can have."""
    def parsed(primary):
        return parse_dates(F.col("txt"), [*primary, *UNAMBIGUOUS_FORMATS, *FALLBACK_FORMATS])
    return dated_orders(s, d).select("order_key", "txt", parsed(DAY_FIRST_FORMATS).alias("day_first"),
                                     parsed(MONTH_FIRST_FORMATS).alias("month_first"), parsed(()).alias("undecided"))


def _dedup_map(s, d):
    rows = drop_duplicates(tagged_orders(s, d))
    return rows.select("status", F.col("tags")["pri"].alias("pri"), F.col("tags")["mod"].alias("mod"), F.abs(F.col("zeros")[0]).alias("zero"))


def _log_sink(s, d):
    """The cleaning log written as text and read back."""
    do, a = _audited(s, d)
    path = new_scratch_path(s, "cleaning-log")
    CSV.write_log_text(CleaningPlan(a.suggestions).fit(do).log_df(s), path)
    return s.read.text(path).withColumnRenamed("value", "line")


def _step_isolation(s, d):
    """A step that its column's type rules out, one that no one knows and a flag for review do not keep the others from running."""
    steps = [Suggestion("fill_median", "o_orderdate", "Completeness"), Suggestion("shout", "o_orderstatus", "Validity"),
             Suggestion("range_flag", "o_totalprice", "Accuracy"), Suggestion("to_integer", "o_totalprice", "Validity")]
    out, plan = CleaningPlan(steps).fit_transform(read_table(s, d, "orders"))
    total = out.agg(F.sum("o_totalprice").alias("total_after")).withColumn("__one", F.lit(1))
    return plan.log_df(s).withColumn("__one", F.lit(1)).join(F.broadcast(total), "__one").select(
        F.col("step").cast("bigint").alias("step"), "type", "col", "n_affected", "note", "total_after")


def _evidence_rows(s, d):
    li = read_table(s, d, "lineitem")
    a = assess(li)
    return EV.evidence_rows(li, a, CleaningPlan(a.suggestions).fit(li), decimals=D6)

QUERIES.update({
    # ---- EDA ----
    "histogram": lambda s, d: V.histogram(_t("events")(s, d)),
    "distribution_stats": lambda s, d: V.distribution_stats(_t("events")(s, d)),
    "zscore_box_stats": lambda s, d: V.zscore_box_stats(_t("events")(s, d)),
    "outlier_points": lambda s, d: V.outlier_points(_t("events")(s, d), EV_KEY),
    "correlation_matrix": lambda s, d: V.correlation_matrix(_t("lineitem")(s, d)),
    "strongest_pair": lambda s, d: V.strongest_pair(_t("lineitem")(s, d)),
    "ols_fit": lambda s, d: V.ols_fit(_t("lineitem")(s, d)),
    "ols_line": lambda s, d: V.ols_line(_t("lineitem")(s, d)),
    "top_correlations": lambda s, d: V.top_correlations(_t("lineitem")(s, d)),
    "scatter_sample": lambda s, d: V.scatter_sample(_t("lineitem")(s, d), ["l_orderkey", "l_linenumber"], LINEITEM_ORDER),
    "random_sample": lambda s, d: seeded_sample(_t("events")(s, d), 10, EV_KEY),
    "head_preview": lambda s, d: head(_t("lineitem")(s, d), 10, LINEITEM_ORDER),
    "category_frequency": lambda s, d: V.category_frequency(_t("part")(s, d)),
    "dominant_share": lambda s, d: V.dominant_share(_t("part")(s, d)),
    "top_categories": lambda s, d: V.top_categories(_t("part")(s, d)),
    "ts_downsample": lambda s, d: V.ts_downsample(_t("lineitem")(s, d), "l_shipdate", "l_extendedprice", LINEITEM_ORDER),
    "ts_rolling_mean": lambda s, d: V.ts_rolling_mean(_t("lineitem")(s, d), "l_shipdate", "l_extendedprice", LINEITEM_ORDER),
    "null_map": lambda s, d: V.null_map(_do(s, d), ["row_id"]),
    "chart_catalog": lambda s, d: V.chart_catalog(_t("lineitem")(s, d)),
    # ---- evidence / report ----
    "numeric_evidence": lambda s, d: EV.numeric_evidence(_t("lineitem")(s, d), decimals=D6),
    "report_facts": _report_facts,
    "dialogue_context": lambda s, d: EV.dialogue_context(_t("conversations")(s, d)),
    "data_context_rows": lambda s, d: EV.data_context_rows(_t("lineitem")(s, d), decimals=D6),
    "data_context": lambda s, d: EV.data_context(_t("lineitem")(s, d)),
    "evidence_pack": _evidence_pack,
    # ---- CSV source and sinks ----
    "csv_roundtrip": _csv_roundtrip,
    "csv_latin1": _csv_latin1,
    # ---- rows of any type, every row, every format ----
    "duplicate_count_map": lambda s, d: P.duplicate_count(tagged_orders(s, d)),
    "clean_dedup_map": _dedup_map,
    "rolling_mean_all": lambda s, d: V.rolling_mean(_t("lineitem")(s, d), "l_shipdate", "l_extendedprice", LINEITEM_ORDER),
    "date_formats": _date_formats,
    "constant_flags": lambda s, d: P.constant_flags(_do(s, d)),
    "melt_events": lambda s, d: melt(_t("events")(s, d), ["event_id"], ["user_id", "value"]),
    "log_sink": _log_sink,
    "step_isolation": _step_isolation,
    "evidence_rows": _evidence_rows,
})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)
