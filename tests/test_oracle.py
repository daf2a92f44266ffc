"""Every named query against its SQL in DuckDB, on the smallest data."""

import sys
from pathlib import Path

import pytest

from conftest import SMALL

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import check  # noqa: E402

import __spark_entry__ as entry_point  # noqa: E402
from reclutark import oracle, queries  # noqa: E402


@pytest.fixture(scope="module")
def con():
    return check.connect(SMALL)


def test_every_query_has_sql():
    assert set(queries.queries()) == set(oracle.oracle_sql())
    assert set(queries.queries()) <= set(entry_point.queries()) and set(entry_point.oracle_sql()) <= set(entry_point.queries())


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_matches_sql(spark, con, name):
    result = check.check(spark, con, SMALL, name, entry_point.queries()[name], entry_point.oracle_sql()[name])
    assert result.startswith("ok") and "TYPES" not in result, result


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.columns == ["medio_reclutamiento_alta", "contratados", "porcentaje"] and df.count() > 0
