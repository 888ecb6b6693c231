"""Every registered query: a pair with SQL, and a plan that spreads."""

import re

import pytest

import __spark_entry__ as driver
from skygauge.plans import catalog
from tests.conftest import SF_SMALL

WITHOUT_SQL = {"long_text"}  # of the queries outside the optional folder


def plan_of(spark, name):
    return catalog.QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()


def test_every_query_has_its_sql():
    assert set(catalog.QUERIES) - set(catalog.ORACLE) == WITHOUT_SQL
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_entry_gives_rows(spark):
    assert driver.entry(spark).count() > 0


NARROW = ["safe_float", "base_slot", "mask_secrets", "portal_items", "forecast_first_value", "e2e_latency", "event_id"]


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_no_cross_join_and_no_python(spark, name):
    plan = plan_of(spark, name)
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|Python|ArrowEval", plan)
    if name in NARROW:
        assert "Exchange" not in plan


def test_columns_and_filters_reach_the_scan(spark):
    plan = plan_of(spark, "lookback_counts")
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(ts", plan)
    assert re.search(r"ReadSchema: struct<ts:timestamp_ntz>", plan)
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan_of(spark, "mask_secrets")


def test_hot_keys_are_chunked_in_the_gate(spark):
    from skygauge.operators import gate, ordered
    from skygauge.plans import views

    rows = views.order_gate_rows(spark, SF_SMALL).selectExpr(
        "*", "unix_micros(cast(clock as timestamp)) as _at", "false as _seed", "signature as _mark"
    )
    plan = gate._classify(ordered.with_chunk(rows, "offset", 1000), 1)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(region" in plan and re.search(r"hashpartitioning\(region#\d+, _chunk#\d+L", plan)
