"""S4/S5 sinks: cleaned data and the cleaning log as text."""

import os

from tallyscope.plans.cleaning import LOG_SCHEMA, CleaningPlan
from tallyscope.plans.rules import Suggestion
from tallyscope.session import new_scratch_path
from tallyscope.sources.csv import read_csv, write_csv, write_log_text


def _lines(spark, path):
    return [r.value for r in spark.read.text(path).collect()]


def test_log_text_one_line_per_step_and_default_line(spark):
    df = spark.createDataFrame([(1, None), (2, 4.0), (3, 6.0)], "k bigint, v double")
    _, plan = CleaningPlan([Suggestion("fill_median", "v", "Completeness")]).fit_transform(df)
    p = new_scratch_path(spark, "log")
    write_log_text(plan.log_df(spark), p)
    lines = _lines(spark, p)
    assert len(lines) == 1 and lines[0].startswith("#01 fill_median 'v' -> 5.0 (1 affected)") and lines[0].endswith("[Completeness]")
    empty = new_scratch_path(spark, "log-empty")
    write_log_text(spark.createDataFrame([], LOG_SCHEMA), empty)
    assert _lines(spark, empty) == ["No cleaning steps were applied."]


def test_cleaned_csv_round_trip_keeps_types(spark):
    df = spark.createDataFrame([(1, " padded ", 2.5), (2, 'has "quotes", commas', None)], "k bigint, s string, x double")
    p = new_scratch_path(spark, "csv")
    write_csv(df, p)
    back = read_csv(spark, p)
    assert dict(back.dtypes) == {"k": "bigint", "s": "string", "x": "double"}
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in df.collect())
    assert any(f.endswith(".csv") for f in os.listdir(p))
