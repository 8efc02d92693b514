"""Cleaning order, fitted values and fit/transform properties."""

import datetime as dt

from pyspark.sql import functions as F

from tallyscope.plans.cleaning import CleaningPlan
from tallyscope.plans.rules import Suggestion, assess


def test_rows_equal_after_conversion_are_deduplicated(spark):
    df = spark.createDataFrame([("1,000",), ("1000",), ("$2,000",), ("2000",), ("5",)], "amount_txt string")
    sugs = [Suggestion("to_numeric", "amount_txt", "Validity"), Suggestion("drop_duplicates", "_all_", "Accuracy")]
    out, plan = CleaningPlan(sugs).fit_transform(df)
    assert sorted(r[0] for r in out.collect()) == [5.0, 1000.0, 2000.0]
    assert [r.n_affected for r in plan.log if r.type == "drop_duplicates"] == [2]


def test_fill_median_then_fix_range_uses_contaminated_median(spark):
    vals = [20.0, 30.0, 40.0, 999.0, 999.0, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "k bigint, age double")
    sugs = [Suggestion("fill_median", "age", "Completeness"),
            Suggestion("fix_range", "age", "Accuracy", lo=0.0, hi=60.0, sentinels=[999.0], to_int=True)]
    out, plan = CleaningPlan(sugs).fit_transform(df)
    # median of [20, 30, 40, 999, 999] = 40 fills the null; valid = [20, 30, 40, 40] -> median 35
    got = dict((r.k, r.age) for r in out.collect())
    assert got == {0: 20, 1: 30, 2: 40, 3: 35, 4: 35, 5: 40}
    fitted = [r.fitted_num for r in plan.log]
    assert fitted == [40.0, 35.0]


def test_all_bad_column_is_left_null(spark):
    df = spark.createDataFrame([(i, 200.0 + i) for i in range(5)], "k bigint, age double")
    sugs = [Suggestion("fix_range", "age", "Accuracy", lo=0.0, hi=60.0, to_int=True)]
    out, plan = CleaningPlan(sugs).fit_transform(df)
    assert all(r.age is None for r in out.collect())
    assert "left null" in plan.log[0].note and plan.log[0].n_affected == 5


def test_to_integer_keeps_nulls_and_rounds_half_even(spark):
    df = spark.createDataFrame([(0, 2.0), (1, None), (2, 4.0)], "k bigint, unit_count double")
    out, _ = CleaningPlan([Suggestion("to_integer", "unit_count", "Validity")]).fit_transform(df)
    assert dict(out.collect()) == {0: 2, 1: None, 2: 4}
    assert dict(out.dtypes)["unit_count"] == "bigint"


def test_numeric_text_edge_cases(spark):
    from tallyscope.functions.scalar import text_to_number

    vals = ["($5)", "(5%)", "$(5)", "1d", "nan", " 12.5 ", "₹1,234", "1e3", "45%"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r[0] for r in df.select(text_to_number(F.col("v"))).collect()]
    assert got == [-5.0, -0.05, None, None, None, 12.5, 1234.0, 1000.0, 0.45]


def test_steps_on_dropped_columns_are_ignored(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "k bigint, gone string")
    sugs = [Suggestion("drop_col", "gone", "Completeness"), Suggestion("drop_col", "gone", "Tidiness"),
            Suggestion("fill_mode", "gone", "Completeness")]
    out, plan = CleaningPlan(sugs).fit_transform(df)
    assert out.columns == ["k"] and len(plan.log) == 1


def test_fit_is_independent_of_partitioning(spark):
    from tallyscope.sources.tables import dirty_orders

    do = dirty_orders(spark, "/root/testdata/sf0.001")
    a = assess(do, ["row_id"])
    one, _ = CleaningPlan(a.suggestions).fit_transform(do.repartition(1))
    many, _ = CleaningPlan(a.suggestions).fit_transform(do.repartition(7, "status"))
    assert sorted(one.collect()) == sorted(many.collect())


def test_transform_replays_on_new_data(spark):
    train = spark.createDataFrame([(i, None if i % 4 == 0 else float(i)) for i in range(20)], "k bigint, v double")
    plan = CleaningPlan([Suggestion("fill_median", "v", "Completeness")]).fit(train)
    new = spark.createDataFrame([(100, None)], "k bigint, v double")
    assert plan.transform(new).first().v == plan.log[0].fitted_num


def test_two_digit_years_and_impossible_dates(spark):
    from tallyscope.functions.scalar import parse_dates

    df = spark.createDataFrame([("12/05/69",), ("12/05/68",), ("31/02/2024",), ("3 Jan 2024",), ("Jan 3, 2024",),
                                ("20240103",), ("2024-1-3",)], "v string")
    fmts = ["d/M/yyyy", "d/M/yy", "yyyy-M-d", "yyyyMMdd", "d MMM yyyy", "MMM d, yyyy"]
    got = [r[0] for r in df.select(parse_dates(F.col("v"), fmts)).collect()]
    assert got[0] == dt.datetime(1969, 5, 12) and got[1] == dt.datetime(2068, 5, 12)
    assert got[2] is None
    assert got[3:] == [dt.datetime(2024, 1, 3)] * 4


def test_date_order_detection(spark):
    from tallyscope.operators.textsniff import date_order

    df = spark.createDataFrame([("13/01/2024", "01/13/2024", "13/13/2024", "01/02/2024")],
                               "dmy string, mdy string, both string, neither string")
    got = {r.column: r.convention for r in date_order(df).collect()}
    assert got == {"dmy": "dmy", "mdy": "mdy", "both": None, "neither": None}


def test_range_fix_on_text_column_coerces_instead_of_failing(spark):
    spark.conf.set("spark.sql.ansi.enabled", "true")
    df = spark.createDataFrame([(0, "5"), (1, "x"), (2, "200"), (3, "7")], "k bigint, rating string")
    sugs = [Suggestion("fix_range", "rating", "Accuracy", lo=0.0, hi=5.0)]
    out, plan = CleaningPlan(sugs).fit_transform(df)
    # "x" is not a number (missing), 200 and 7 are out of range: all take the median of valid values (5)
    assert dict(out.collect()) == {0: 5.0, 1: 5.0, 2: 5.0, 3: 5.0}
    assert plan.log[0].n_affected == 2
