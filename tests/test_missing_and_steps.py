"""NaN as missing at every entry, and the cleaner's steps one by one."""

import random

import pytest
from pyspark.sql import functions as F

from tallyscope import CleaningPlan, FittedPlan, Suggestion, assess
from tallyscope.functions.scalar import parse_dates
from tallyscope.operators import eda, profile


def rows(df):
    return sorted(map(str, df.collect()))


def test_nan_is_null_for_every_operator(spark):
    data = [(i, float(i % 17), float(i % 5) if i % 4 else None, "t") for i in range(200)]
    nulls = spark.createDataFrame(data, "k bigint, a double, price double, s string")
    nans = nulls.withColumn("price", F.coalesce("price", F.lit(float("nan"))))
    for f in (
        profile.null_profile, profile.describe_numeric, profile.skew_kurtosis, profile.constant_columns, profile.mode_values, profile.overview,
        profile.severity_cards, profile.out_of_domain, profile.whole_number_floats, profile.missing_overall, profile.audit_stats,
        eda.histogram, eda.distribution_stats, eda.correlation_matrix, eda.zscore_box_stats, eda.chart_catalog,
    ):
        assert rows(f(nans)) == rows(f(nulls)), f.__name__
    assert [s.__dict__ for s in assess(nans).suggestions] == [s.__dict__ for s in assess(nulls).suggestions]
    assert any(s.type == "fill_median" and s.col == "price" for s in assess(nans).suggestions)
    empty = spark.createDataFrame([(1, float("nan")), (2, float("nan"))], "k bigint, v double")
    assert any(s.type == "drop_col" and s.col == "v" for s in assess(empty).suggestions)


def test_whole_medians_only_for_whole_columns(spark):
    df = spark.createDataFrame([(2,), (3,), (None,)], "v bigint")
    out, plan = CleaningPlan([Suggestion("fill_median", "v", "Completeness")]).fit_transform(df)
    assert sorted(r.v for r in out.collect()) == [2.0, 2.5, 3.0] and plan.log[0].fitted_num == 2.5
    even = spark.createDataFrame([(2,), (4,), (4,), (None,)], "v bigint")
    out, _ = CleaningPlan([Suggestion("fill_median", "v", "Completeness")]).fit_transform(even)
    assert dict(out.dtypes) == {"v": "bigint"} and sorted(r.v for r in out.collect()) == [2, 4, 4, 4]


def test_transform_is_fit_transform(spark):
    df = spark.createDataFrame([(i, v, t) for i, (v, t) in enumerate(zip([39, 40, None, 999, -5, 39, 40], ["1", None, "x", "4", "5%", "6", "7"]))], "k bigint, age bigint, t string")
    pool = [
        Suggestion("fill_median", "age", "C"), Suggestion("fix_range", "age", "A", lo=0.0, hi=60.0, sentinels=[999.0], to_int=True),
        Suggestion("drop_col", "t", "C"), Suggestion("fill_mode", "t", "C"), Suggestion("to_numeric", "t", "V"), Suggestion("to_integer", "age", "V"),
        Suggestion("drop_duplicates", "_all_", "A"), Suggestion("fill_median", "t", "C"),
    ]
    rng = random.Random(2)
    for _ in range(8):
        steps = rng.sample(pool, rng.randrange(1, 6))
        out, plan = CleaningPlan(steps).fit_transform(df)
        again = plan.transform(df)
        assert out.dtypes == again.dtypes and rows(out) == rows(again), [s.type for s in steps]
        loaded = FittedPlan.from_json(plan.to_json())
        assert loaded.log == plan.log and rows(loaded.transform(df)) == rows(out)


def test_one_bad_step_does_not_stop_the_others(spark):
    df = spark.createDataFrame([(1, [1, 2], {"a": 1}, None), (1, [1, 2], {"a": 1}, None), (2, [3], {"b": 2}, "x")], "k bigint, arr array<int>, m map<string,int>, s string")
    steps = [Suggestion("fix_range", "arr", "A", lo=0.0), Suggestion("to_numeric", "m", "V"), Suggestion("drop_duplicates", "_all_", "A"), Suggestion("fill_mode", "s", "C")]
    out, plan = CleaningPlan(steps).fit_transform(df)
    assert [r.note.startswith("skipped") for r in plan.log] == [True, True, False, False]
    assert out.count() == 2 and {r.s for r in out.collect()} == {"x"} and plan.transform(df).count() == 2


def test_long_category_lists_are_refused_whole(spark):
    df = spark.createDataFrame([(f"v{i % 40}",) for i in range(200)], "c string")
    plan = CleaningPlan([Suggestion("to_category", "c", "V")]).fit(df)
    assert plan.categories == {} and plan.log[0].note.startswith("skipped")


@pytest.mark.parametrize("zone", ["UTC", "America/Sao_Paulo", "America/New_York"])
def test_dates_are_the_same_in_every_zone(spark, zone):
    texts = {"15/10/2017": "2017-10-15 00:00:00", "2024-03-10 02:30:00": "2024-03-10 02:30:00", "2024-3-10T2:30": "2024-03-10 02:30:00", "1/2/70": "1970-02-01 00:00:00",
             "3 Mar 2021 23:59:59": "2021-03-03 23:59:59", "2024-03-10 24:00:00": None, "31/02/2020": None}
    from tallyscope.config import FALLBACK_FORMATS

    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        got = {r.t: r.d for r in df.select("t", parse_dates(F.col("t"), FALLBACK_FORMATS).cast("string").alias("d")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == texts
