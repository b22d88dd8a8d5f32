"""Plan-shape checks for the scale properties."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.01"
PY_NODES = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "PythonUDF")


def _plan(spark, name):
    return E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["panel_long", "total_consistency", "hhi", "doc_chunks",
                                  "region_enrich", "series_lookup"])
def test_no_python_and_no_cartesian(spark, name):
    plan = _plan(spark, name)
    assert not any(n in plan for n in PY_NODES), name
    assert "CartesianProduct" not in plan, name


def test_partial_aggregation_before_order_shuffle(spark):
    df = E.queries()["panel_long"](spark, SF)
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    scans = [i for i, l in enumerate(lines) if "FileScan parquet" in l and "o_totalprice" in l]
    for i in scans:                       # orders are summed per (customer, quarter) before they move
        above = "\n".join(lines[max(0, i - 6):i])
        assert "partial_sum" in above and "HashAggregate" in above
    df.collect()                          # AQE decides exchange reuse at run time: one shuffle of orders
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    plan = _plan(spark, "series_lookup")
    assert "PushedFilters: [IsNotNull(n_name), EqualTo(n_name,NATION_3)" in plan
    assert "ReadSchema: struct<o_custkey:bigint,o_totalprice:double,o_orderdate:" in plan


def test_holt_is_the_only_python_node(spark):
    plan = _plan(spark, "fc_holt")
    assert "MapInPandas" in plan
