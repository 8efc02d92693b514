"""Canonical row keys, duplicates of any row type, and the ranges of the row index."""

import pytest
from pyspark.sql import functions as F

from tallyscope.functions import rowkey
from tallyscope.operators import duplicates as D
from tallyscope.operators.rowindex import bucketed, with_row_index, with_tie


def _maps(spark):
    rows = [(1, {"a": 1.0, "b": 2.0}), (1, {"b": 2.0, "a": 1.0}), (1, {"a": 1.0, "b": 3.0}), (1, None), (1, None), (None, {"a": -0.0}), (None, {"a": 0.0})]
    return spark.createDataFrame(rows, "k int, m map<string,double>")


def test_rows_that_differ_in_a_map_stay(spark):
    df = _maps(spark)
    assert D.duplicate_stats(df) == {"rows": 7, "distinct": 4, "duplicates": 3}
    kept = [(r.k, None if r.m is None else tuple(sorted(r.m.items()))) for r in D.drop_duplicates(df).collect()]
    assert sorted(kept, key=str) == sorted([(1, (("a", 1.0), ("b", 2.0))), (1, (("a", 1.0), ("b", 3.0))), (1, None), (None, (("a", 0.0),))], key=str)


def test_the_cleaner_keeps_rows_that_differ_in_a_map(spark):
    from tallyscope.plans.cleaning import CleaningPlan
    from tallyscope.plans.rules import Suggestion

    out, plan = CleaningPlan([Suggestion("drop_duplicates", "_all_", "Accuracy")]).fit_transform(_maps(spark))
    assert out.count() == 4 and plan.transform(_maps(spark)).count() == 4


def test_nested_types_and_floats_are_compared_by_value(spark):
    rows = [([{"x": float("nan")}], (1, -0.0)), ([{"x": float("nan")}], (1, 0.0)), ([{"x": None}], (1, 0.0)), ([], (1, 0.0)), (None, None), (None, None)]
    df = spark.createDataFrame(rows, "a array<map<string,double>>, s struct<i:int,d:double>")
    assert D.duplicate_stats(df) == {"rows": 6, "distinct": 4, "duplicates": 2}
    assert D.drop_duplicates(df).count() == 4


def test_rows_whose_keys_collide_are_compared_in_full(spark, monkeypatch):
    monkeypatch.setattr(D, "with_row_key", lambda df: df.select("*", *[F.lit(1).cast("bigint").alias(k) for k in rowkey.KEY]))
    df = spark.createDataFrame([(1, {"a": 1}), (1, {"a": 2}), (1, {"a": 2}), (2, {"a": 2})], "k int, m map<string,int>")
    assert D.duplicate_stats(df)["distinct"] == 3
    assert D.drop_duplicates(df).count() == 3


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_many_repeated_keys_take_the_shuffled_way(spark, monkeypatch, limit):
    monkeypatch.setattr(D, "BROADCAST_KEYS", limit)
    df = spark.range(2000).selectExpr("id % 700 as k", "map('v', id % 700) as m")
    assert D.duplicate_stats(df) == {"rows": 2000, "distinct": 700, "duplicates": 1300}
    assert D.drop_duplicates(df).count() == 700


def test_null_positions_do_not_share_a_key(spark):
    df = spark.createDataFrame([(None, 1), (1, None)], "a int, b int")
    assert D.key_counts(df).count() == 2


def test_empty_tables(spark):
    df = spark.createDataFrame([], "k int, m map<string,int>")
    assert D.duplicate_stats(df) == {"rows": 0, "distinct": 0, "duplicates": 0}
    assert D.drop_duplicates(df).count() == 0


def test_equal_order_values_spread_over_ranges(spark):
    # one timestamp holds all rows: the row hash tells them apart
    df = spark.range(4000).selectExpr("1 as ts", "id as v").repartition(5)
    tagged, sizes = bucketed(*with_tie(df, ["ts"]), rows_per_bucket=200)
    assert max(sizes) <= 400 and sum(sizes) == 4000
    idx = with_row_index(df, ["ts"], rows_per_bucket=200)
    assert sorted(r.idx for r in idx.collect()) == list(range(4000))
    again = {r.v: r.idx for r in with_row_index(df.repartition(3), ["ts"], rows_per_bucket=900).collect()}
    assert again == {r.v: r.idx for r in idx.collect()}  # ties are ordered alike on every run


def test_a_range_over_its_share_is_cut_again(spark, monkeypatch):
    from tallyscope.operators import rowindex

    monkeypatch.setattr(rowindex, "FIRST_CUTS", 3)
    monkeypatch.setattr(rowindex, "SAMPLES_PER_BUCKET", 40)
    df = spark.range(6000).selectExpr("id % 4 as a", "cast(id as string) as b", "case when id % 3 > 0 then id end as c").repartition(4)
    tagged, sizes = bucketed(df, ["a", "c", "b"], rows_per_bucket=150)
    assert len(sizes) > 20 and max(sizes) <= 300
    idx = [(r.a, r.c, r.b) for r in with_row_index(df, ["a", "c", "b"], rows_per_bucket=150).orderBy("idx").collect()]
    assert idx == [(r.a, r.c, r.b) for r in df.orderBy("a", "c", "b").collect()]
