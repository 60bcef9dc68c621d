"""Plan checks: no Python in the hot path, one scan per input, windows after aggregation."""

import pytest

from tillbook.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_no_python_and_no_cross_join(spark, name):
    p = plan(catalog.QUERIES[name](spark, SF))
    for node in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "MapInArrow", "FlatMapGroupsInPandas"):
        assert node not in p, f"{name} runs Python: {node}"
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_summary_scans_ledger_once(spark):
    df = catalog.QUERIES["summary_all_long"](spark, SF)
    df.collect()
    final = plan(df).split("Initial Plan")[0]  # the Total rows' join reuses the ledger's aggregation
    assert final.count("lineitem.parquet") == 1 and "ReusedExchange" in final


def test_window_only_after_aggregation(spark):
    df = catalog.QUERIES["networth_table"](spark, SF)
    p = plan(df)
    w = p.index("Window")
    assert "HashAggregate" in p[w:]
