"""The forms that hold for tables of any size, forced on small ones."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyscope.config import AuditConfig
from tallyscope.operators import freq, quantiles
from tallyscope.operators import profile as P
from tallyscope.operators.eda import correlations, rolling_mean, ts_rolling_mean
from tallyscope.operators.evidence import dialogue_context


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("scale", [1.0, 1e-13, 1e250])
def test_rolling_mean_over_every_row_in_ranges(spark, scale):
    rng = np.random.default_rng(4)
    values = (rng.integers(-500, 500, 900) / 4 * scale).tolist()
    df = spark.createDataFrame([(i // 3, i, v) for i, v in enumerate(values)], "ts bigint, k bigint, v double").repartition(4)
    got = rolling_mean(df, "ts", "v", ["k"], window=37, max_points=200, decimals=None, rows_per_bucket=50).orderBy("idx").collect()
    want = pd.Series(values).rolling(37, min_periods=1).mean()
    assert [r.idx for r in got] == list(range(0, 900, 5))
    assert np.allclose([r.rolling_mean for r in got], [want[r.idx] for r in got], rtol=1e-9, atol=scale * 1e-9)
    assert [r.value for r in got] == [values[r.idx] for r in got]


def test_rolling_mean_of_short_series(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(12)], "ts bigint, v double")
    assert [r.rolling_mean for r in rolling_mean(df, "ts", "v").collect()] == [None] * 12
    assert rolling_mean(df.limit(4), "ts", "v").count() == 0
    assert ts_rolling_mean(df, "ts", "v").where("rolling_mean is null").count() == 12


@pytest.mark.parametrize("per_range", [3, 40])
def test_dialogue_context_over_short_ranges_and_repeated_turns(spark, per_range):
    rows = [(c, t // 2, "user" if t % 3 else "assistant", f"c{c}t{t}") for c in range(4) for t in range(17)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    got = dialogue_context(df, rows_per_bucket=per_range)
    one = dialogue_context(df.repartition(1), rows_per_bucket=10_000)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, one.collect()))
    # by brute force where no turn repeats
    single = [r for r in rows if int(r[3].split("t")[1]) % 2 == 0]
    found = dialogue_context(spark.createDataFrame(single, df.schema).repartition(3), rows_per_bucket=per_range).collect()
    want = [(r[0], r[1], i, *single[n - i][1:]) for n, r in enumerate(single) if r[2] == "user" for i in range(1, 7) if n >= i and single[n - i][0] == r[0]]
    assert sorted(map(tuple, found)) == sorted(want)


def test_every_text_of_a_dialogue_moves_about_once(spark):
    df = spark.createDataFrame([(i // 40, i % 40, "user", "x" * 50) for i in range(2000)], "conv_id bigint, turn bigint, role string, text string")
    plan = _plan(dialogue_context(df, rows_per_bucket=200))
    assert "SinglePartition" not in plan and "Join" not in plan
    assert plan.count("Exchange hashpartitioning(__b") <= 2  # the rows, and a few rows a range for the halo


@pytest.mark.parametrize("counters", [1 << 15, 16])
def test_top_k_by_counters_and_hashes_equals_the_frequency_table(spark, monkeypatch, counters):
    monkeypatch.setattr(freq, "COUNTERS", counters)
    monkeypatch.setattr(freq, "LOOKED_INTO", 1)
    df = spark.range(3000).selectExpr(
        "id", "cast(id as string) as name", "id % 7 as few", "cast(pow(id % 90, 2) as int) % 400 as mid", "case when id % 3 = 0 then 'hot' else concat('v', id) end as hot",
        "cast(null as string) as none", "cast(id div 2 as double) as twice", "map('a', id % 3, 'b', 1) as m", "case when id % 5 > 0 then id % 1500 end as gaps")
    for k in (1, 5, 20):
        want = sorted(map(tuple, freq.top_k(freq.frequency_table(df, df.columns), k).collect()))
        assert sorted(map(tuple, freq.exact_top_k(df, df.columns, k).collect())) == want
    modes = {r["column"]: (r["mode"], r["mode_count"]) for r in freq.modes(freq.frequency_table(df)).collect()}
    assert modes == {r["column"]: (r["value"], r["n"]) for r in freq.exact_top_k(df, df.columns, 1).collect()}


def test_few_values_and_distinct_counts(spark):
    df = spark.range(5000).selectExpr("id as many", "id % 25 as few", "id % 26 as more", "cast(null as string) as none", "map('b', id % 2, 'a', 1) as m")
    assert freq.few_values(df, df.columns, 25) == {"many": None, "few": 25, "more": None, "none": 0, "m": 2}
    counts = {r["column"]: r["n_unique"] for r in freq.distinct_by_key(df, df.columns).collect()}
    assert counts == {"many": 5000, "few": 25, "more": 26, "m": 2}


def test_quantiles_from_range_partitioned_value_counts(spark, monkeypatch):
    rng = np.random.default_rng(7)
    values = np.concatenate([np.repeat([0.0, 1.0, 2.0, 3.0], 1500), rng.normal(7, 0.1, 2000)])
    df = spark.createDataFrame([(float(v), float(-v)) for v in values], "x double, y double").repartition(4)
    probs = [0.0, 0.1, 1499.75 / 7999, 2999.5 / 7999, 0.77, 0.99, 1.0]
    by_counts = quantiles._by_counts
    seen = []
    monkeypatch.setattr(quantiles, "_by_counts", lambda df, exprs, targets, rows_per_bucket=None: seen.append(len(targets)) or by_counts(df, exprs, targets, 300))
    got = quantiles.exact_quantiles(df, {"x": F.col("x"), "y": F.col("y")}, probs, cfg=AuditConfig(exact_quantile_max_band=100))
    assert seen
    assert np.allclose(got["x"], np.quantile(values, probs), rtol=0, atol=1e-12)
    assert np.allclose(got["y"], np.quantile(-values, probs), rtol=0, atol=1e-12)


def test_no_value_map_of_a_whole_column(spark):
    assert AuditConfig().exact_quantile_max_band <= 16_384


def test_constant_flags_and_merged_states(spark):
    df = spark.range(3000).selectExpr("id as a", "1 as one", "cast(null as int) as none", "case when id > 0 then 1 end as gap", "map('x', 1) as m", "'v' || (id % 900) as t")
    flags = {r["column"]: r["is_constant"] for r in P.constant_flags(df).collect()}
    assert flags == {"a": False, "one": True, "none": True, "gap": False, "m": True, "t": False}
    states = P.cardinality_states(df.where("id < 1500"), ["a", "t"]).unionAll(P.cardinality_states(df.where("id >= 1200"), ["a", "t"]))
    got = {r["column"]: r["n_unique"] for r in P.merged_cardinality(states).collect()}
    assert abs(got["a"] - 3000) < 150 and abs(got["t"] - 900) < 45


def test_correlations_of_wide_tables_have_the_digits_of_narrow_ones(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(300, 1)) + rng.normal(size=(300, 110))
    data[::7, 3] = np.nan
    cols = [f"c{i}" for i in range(110)]
    df = spark.createDataFrame(pd.DataFrame(data, columns=cols)).select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in cols]).repartition(1)
    wide, narrow = correlations(df), correlations(df, cols[:5])
    want = pd.DataFrame(data).corr().to_numpy()
    assert max(abs(r - want[i, j]) for (i, j), r in wide["r"].items()) < 1e-10
    assert all(math.isclose(narrow["r"][p], wide["r"][p], rel_tol=1e-13) for p in narrow["r"])
