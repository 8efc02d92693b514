"""Physical-plan shape: the properties the scale design relies on."""

from tallyscope.sources.tables import read_table

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_limits_before_the_shuffle(spark):
    from tallyscope.operators import freq

    li = read_table(spark, SF, "lineitem")
    plan = _plan(freq.top_k(freq.frequency_table(li, ["l_returnflag", "l_linestatus"]), 5))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_sniffing_scans_once_and_reads_only_needed_columns(spark):
    from tallyscope.operators.textsniff import sniff_rates

    li = read_table(spark, SF, "lineitem")
    plan = _plan(sniff_rates(li, ["l_returnflag", "l_linestatus", "l_shipmode"] if "l_shipmode" in li.columns else ["l_returnflag", "l_linestatus"]))
    assert plan.count("FileScan") == 1 and "Sort" not in plan
    assert "l_comment" not in plan and "l_extendedprice" not in plan   # pruned scan


def test_no_cartesian_or_nested_loop_joins(spark):
    from tallyscope.operators import eda
    from tallyscope.operators.evidence import dialogue_context
    from tallyscope.operators.profile import column_summary

    li = read_table(spark, SF, "lineitem")
    plans = [_plan(eda.histogram(read_table(spark, SF, "events"))),
             _plan(dialogue_context(read_table(spark, SF, "conversations"))),
             _plan(column_summary(li, ["l_orderkey"]))]
    for p in plans:
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_frequency_table_combines_map_side(spark):
    from tallyscope.operators import freq

    plan = _plan(freq.frequency_table(read_table(spark, SF, "part"), ["p_brand"]))
    # partial aggregate (map-side combine) below the exchange
    assert plan.count("HashAggregate") >= 2 and "Exchange" in plan
