"""What the plans must and must not contain."""

import datetime as dt
import re

import pytest

from conftest import SMALL
from reclutark.functions.calendar import QUARTER, Period
from reclutark.queries import queries
from reclutark.sources import fixtures as fx, tables

def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(queries()))
def test_no_python_and_no_pair_joins(spark, name):
    plan = plan_of(queries()[name](spark, SMALL))
    for operator in (
        "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "MapInArrow", "FlatMapGroups", "FlatMapCoGroups", "CartesianProduct", "BroadcastNestedLoopJoin",
    ):
        assert operator not in plan


def test_period_reaches_the_scan(spark, tmp_path):
    df = Period(QUARTER, year=1998, quarter=2).filter(fx.altas(spark, SMALL, "fecha_alta"), "fecha_alta")
    pushed = re.search(r"PushedFilters: \[(.*?)ReadSchema", plan_of(df)).group(1)
    assert "GreaterThanOrEqual(o_orderdate,1998-04-01T00:00)" in pushed
    stored = str(tmp_path / "altas")
    tables.write_table(tables.empty_table(spark, "altas"), stored)
    df = Period(QUARTER, year=1998, quarter=2).filter(tables.read_table(spark, str(tmp_path), "altas"), "fecha_alta")
    assert "GreaterThanOrEqual(fecha_alta,1998-04-01)" in plan_of(df)
    df = tables.read_range(tables.read_table(spark, str(tmp_path), "altas"), "fecha_alta", dt.date(1998, 1, 1))
    assert "GreaterThanOrEqual(fecha_alta,1998-01-01)" in plan_of(df)


def test_scans_read_only_what_is_used(spark):
    plan = plan_of(queries()["hires_by_month"](spark, SMALL))
    assert plan.count("FileScan") == 1
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in plan


def test_messages_are_limited_before_the_shuffle(spark):
    assert plan_of(queries()["chat_last_n"](spark, SMALL)).count("WindowGroupLimit") == 2


def test_orders_are_shuffled_once_at_most(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(queries()["days_by_site"](spark, SMALL))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(re.findall(r"Exchange hashpartitioning\(o_custkey", plan)) == 1
    assert not re.findall(r"Exchange hashpartitioning\(c_nationkey.*o_orderkey", plan)


@pytest.mark.parametrize("name", ["import_upsert", "import_master", "import_report"])
def test_imports_sort_no_wide_rows(spark, name):
    """Keys are aggregated by hash; the staged text is read once, into the checkpoint, whatever reads the cleansed rows."""
    df = queries()[name](spark, SMALL)
    df.collect()
    plan = plan_of(df)
    assert "SortAggregate" not in plan
