import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from conftest import tuples
from reclutark.operators import changes, tableview


@pytest.fixture(scope="module")
def grid(spark):
    rows = [(1, "b", 5, True, dt.date(2024, 1, 1)), (2, None, None, None, None), (3, "A", -1, False, dt.date(2023, 1, 1)), (4, "", 0, True, None)]
    return spark.createDataFrame(rows, "id long, t string, n int, ok boolean, d date")


def ids(df):
    return [r["id"] for r in df.collect()]


def ordered(df, column, descending=False):
    return ids(df.orderBy(*tableview.sort_order(df, column, descending, ["id"])))


def test_sort_text_in_any_case_with_missing_first(grid):
    assert ordered(grid, "t") == [2, 4, 3, 1]
    assert ordered(grid, "t", descending=True) == [1, 3, 2, 4]


def test_sort_numbers_booleans_and_dates(grid):
    assert ordered(grid, "n") == [3, 2, 4, 1]
    assert ordered(grid, "ok") == [2, 3, 1, 4]
    assert ordered(grid, "d") == [2, 4, 3, 1]
    assert ordered(grid, "d", descending=True) == [1, 3, 2, 4]


def test_facets_and_search(spark, grid):
    found = tableview.facets(grid, ["t", "n", "ok"])
    assert sorted(tuples(found)) == [
        ("n", "-1", "-1"), ("n", "0", "0"), ("n", "5", "5"), ("ok", "false", "Faltante"), ("ok", "true", "Entregado"),
        ("t", "A", "A"), ("t", "b", "b"),
    ]
    assert tuples(tableview.facet_search(found, "ENT"), "valor") == [("true",)]
    assert tableview.facet_search(found, "").count() == 7


def test_facets_sort_in_spanish(spark):
    words = spark.createDataFrame([(w,) for w in ("Zeta", "árbol", "nube", "ñandú", "bote", "oso")], "w string")
    shown = [r["valor"] for r in tableview.sorted_facets(tableview.facets(words, ["w"])).collect()]
    assert shown == ["árbol", "bote", "nube", "ñandú", "oso", "Zeta"]


def test_filter_is_any_within_and_all_across(grid):
    assert ids(tableview.faceted_filter(grid, {"t": ["A", "b"], "ok": ["true"], "n": []})) == [1]
    assert ids(tableview.faceted_filter(grid, {"n": ["0", "5"]})) == [1, 4]
    assert ids(tableview.faceted_filter(grid, {})) == [1, 2, 3, 4]


def test_filters_commute(grid):
    one = tableview.faceted_filter(tableview.faceted_filter(grid, {"t": ["b", "A"]}), {"ok": ["true"]})
    other = tableview.faceted_filter(tableview.faceted_filter(grid, {"ok": ["true"]}), {"t": ["b", "A"]})
    assert ids(one) == ids(other)


def test_pick_and_rename_skip_missing(grid):
    assert tableview.pick(grid, ["n", "x", "id"]).columns == ["n", "id"]
    assert tableview.rename(grid, {"n": "N", "x": "X", "id": "ID"}).columns == ["N", "ID"]


def test_page_is_clamped(spark):
    df = spark.range(23).select((F.col("id") + 1).alias("id"))
    rows = tableview.page_of(df, "id", ["id"], page=9, size=10).collect()
    assert [r["id"] for r in rows] == [21, 22, 23]
    assert [r["fila"] for r in rows] == [21, 22, 23]
    assert {(r["pagina"], r["paginas"], r["total"]) for r in rows} == {(3, 3, 23)}
    assert [r["id"] for r in tableview.page_of(df, "id", ["id"], page=0, size=10).collect()] == list(range(1, 11))
    assert tableview.page_of(df.where("id < 0"), "id", ["id"]).count() == 0


@pytest.mark.parametrize("descending", [False, True])
def test_all_pages_agree_with_the_sorted_table(spark, descending):
    """Near start, near end and in the middle, with a third of the rows on one sort value."""
    df = spark.range(400).select("id", F.when(F.col("id") % 3 == 0, "Hot").otherwise((F.col("id") % 7).cast("string")).alias("t"))
    expected = ordered(df, "t", descending)
    for page in (1, 4, 9, 13, 20):
        got = tableview.page_of(df, "t", ["id"], page=page, size=20, descending=descending)
        assert [r["id"] for r in got.collect()] == expected[(page - 1) * 20 : page * 20], page


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("leaf, ways", [(10, 3), (1, 2), (60, 64)])
def test_pages_from_split_ranges_agree_with_the_sorted_table(spark, descending, leaf, ways):
    """Days with missing ones, all pages from one directory, ranges split down to a few rows."""
    day = F.when(F.col("id") % 4 == 0, F.lit(None)).otherwise(F.date_add(F.lit("2024-01-01"), (F.col("id") * 37 % 90).cast("int")))
    df = spark.range(300).select("id", day.alias("t")).repartition(5)
    expected = ordered(df, "t", descending)
    directory = tableview.Directory(df, "t", ["id"], descending, leaf, ways)
    for page in (7, 1, 15, 14, 8):
        rows = directory.page(page, 20).collect()
        assert [r["id"] for r in rows] == expected[(page - 1) * 20 : page * 20], page
        assert [r["fila"] for r in rows] == list(range((page - 1) * 20 + 1, page * 20 + 1))
    assert sum(r.rows for r in directory.ranges) == 300 and len(directory.ranges) > 3


def test_a_directory_reads_no_more_than_it_needs(spark):
    df = spark.range(5000).selectExpr("id", "id % 7 AS t")
    directory = tableview.Directory(df, "t", ["id"], leaf=100, ways=16)
    page = directory.page(100, 25)
    assert max(r.rows for _, r in directory._touched(99 * 25, 100 * 25)) <= 100
    known = len(directory.ranges)
    assert directory.page(100, 25).collect() == page.collect() and len(directory.ranges) == known
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan and "Exchange rangepartitioning" not in plan.split("Window")[1]


def test_rows_that_nothing_tells_apart_stay_in_one_range(spark):
    df = spark.range(50).selectExpr("1 AS id", "'x' AS t")
    assert tableview.Directory(df, "t", ["id"], leaf=5).page(2, 10).count() == 10


def test_no_heap_grows_with_the_place_of_a_page(spark):
    df = spark.range(3000).selectExpr("id", "id % 7 AS t")
    plan = tableview.page_of(df, "t", ["id"], page=60, size=25)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" not in plan and "Offset" not in plan


def test_json_records(spark):
    df = spark.createDataFrame(
        [(1, "ñ", float("nan"), True, dt.date(2024, 1, 2)), (2, None, 1.5, None, None)], "a int, b string, c double, d boolean, e date"
    )
    got = [json.loads(r["registro"]) for r in tableview.json_records(df).collect()]
    assert got == [
        {"a": 1, "b": "ñ", "c": None, "d": True, "e": "2024-01-02"}, {"a": 2, "b": None, "c": 1.5, "d": None, "e": None},
    ]
    assert "ñ" in tableview.json_records(df).first()["registro"]


def test_overlay_overwrites_with_null_and_keeps_other_columns(spark):
    target = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, v string, w string")
    edits = spark.createDataFrame([(2, None)], "id long, v string")
    assert sorted(tuples(changes.overlay(target, edits, "id", ["v"]))) == [(1, "a", "x"), (2, None, "y")]


def test_last_per_key(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 3, None), (1, 2, "b"), (2, 1, "c")], "k long, o long, v string")
    assert sorted(tuples(changes.last_per_key(df, ["k"], "o"))) == [(1, 3, None), (2, 1, "c")]
