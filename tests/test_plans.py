"""Plan-shape checks: pruning at the scan and no extra shuffles for lookups."""
import os

import pytest

SF = "/root/testdata/sf0.001"


def _plan(df, capsys) -> str:
    df.explain("formatted")
    return capsys.readouterr().out


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_order_scan_is_pruned_and_region_needs_no_join(spark, capsys):
    # the operator's own plan: the registered key writes its rows for the rank
    from sheetwise.operators import orders as O
    from sheetwise.sources.fixtures import order_lines
    plan = _plan(O.region_sales(O.order_rows(order_lines(spark, SF))), capsys)
    lineitem_schema = [ln for ln in plan.splitlines() if "ReadSchema" in ln and "l_orderkey" in ln][0]
    for unused in ("l_extendedprice", "l_tax", "l_linestatus", "l_shipdate"):
        assert unused not in lineitem_schema
    # the five joins of the order view only: normalising regions adds no join
    tree = plan.split("\n\n")[0]
    joins = sum(tree.count(j) for j in ("BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin"))
    assert joins == 5


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_overview_has_one_order_level_aggregate(spark, capsys):
    from sheetwise.suite import queries
    plan = _plan(queries()["order_overview"](spark, SF), capsys)
    tree = plan.split("\n\n")[0]
    # scan/joins -> dedup (partial+final) -> order roll-up (partial+final) -> overview (partial+final)
    assert tree.count("HashAggregate") <= 6
    assert "Union" not in tree.split("Generate")[0]
