import pytest

from sheetloom.operators import pivots, versions
from sheetloom.rows import ROW_ID


def counts(before, after):
    return {(r["metric"], r["column"]): r["n"] for r in versions.compare_versions(before, after).collect()}


def cells(before, after):
    return sorted(tuple(r) for r in versions.changed_cells(before, after).collect())


def test_cells_filled_cleared_changed(sheet):
    before = sheet("name string, `a.b` long", [("x", 1), (None, 2), ("z", None), ("w", 4)])
    after = sheet("name string, `a.b` long", [("x", 1), ("y", 2), ("z", 3), (None, 5)])
    assert cells(before, after) == [
        (1, "name", None, "y"), (2, "a.b", None, "3"), (3, "a.b", "4", "5"), (3, "name", "w", None),
    ]
    found = counts(before, after)
    assert found[("cells_filled", "name")] == 1 and found[("cells_cleared", "name")] == 1
    assert found[("cells_filled", "a.b")] == 1 and found[("cells_changed", "a.b")] == 1
    assert found[("rows_changed", None)] == 3 and found[("rows_gone", None)] == 0


def test_rows_added_and_gone_are_no_cell_changes(sheet):
    before = sheet("v string", ["a", "b", "c"])
    after = before.where(f"{ROW_ID} > 0").union(sheet("v string", ["n"] * 5).where(f"{ROW_ID} = 4"))
    found = counts(before, after)
    assert (found[("rows_before", None)], found[("rows_after", None)]) == (3, 3)
    assert (found[("rows_added", None)], found[("rows_gone", None)], found[("rows_changed", None)]) == (1, 1, 0)
    assert cells(before, after) == []


def test_columns_of_one_version_and_other_types(sheet):
    before = sheet("v string, old long", [("7", 1), ("8", None)])
    after = sheet("v long, new double", [(7, 1.5), (9, None)])
    assert cells(before, after) == [(0, "new", None, "1.5"), (0, "old", "1", None), (1, "v", "8", "9")]


def test_own_names_do_not_clash(sheet):
    before = sheet("old_id long, old0 string, at string, i long", [(1, "a", "x", 1)])
    after = sheet("old_id long, old0 string, at string, i long", [(2, "a", "y", 1)])
    assert cells(before, after) == [(0, "at", "x", "y"), (0, "old_id", "1", "2")]


def test_empty_tables_and_no_columns(sheet, spark):
    empty = sheet("v string", [])
    assert cells(empty, empty) == [] and set(counts(empty, empty).values()) == {0}
    bare = spark.range(3).toDF(ROW_ID)
    assert cells(bare, bare) == [] and counts(bare, bare)[("rows_before", None)] == 3
    with pytest.raises(ValueError):
        versions.compare_versions(spark.range(3), bare)


def test_pivot_headers_are_numbered_in_order(spark):
    df = spark.range(0, 30_000, 1, 7).selectExpr("id % 12345 AS h", "id AS v").union(spark.sql("SELECT NULL, 1L"))
    found = pivots.pivot_headers(df, "h").orderBy("position").collect()
    assert [(r["header"], r["position"]) for r in found] == [(i, i + 1) for i in range(12345)]


@pytest.mark.parametrize("func", pivots.FUNCTIONS)
def test_long_pivot_holds_the_cells_of_the_wide_one(sales, func):
    wide = pivots.pivot_table(sales, ["Port"], "Tons", func, "Cargo").collect()
    long = pivots.pivot_long(sales, ["Port"], "Tons", func, "Cargo").collect()
    assert {(r["Port"], r["header"]): r["value"] for r in long} == {
        (r["Port"], c): r[c] for r in wide for c in ("oil", "ore")
    }
    assert {(r["header"], r["header_position"]) for r in long} == {("oil", 1), ("ore", 2)}


def test_more_headers_than_columns_allow(spark):
    spark.conf.set("spark.sql.pivotMaxValues", "5")
    try:
        df = spark.range(40).selectExpr("id % 2 AS k", "id % 20 AS h", "id AS v")
        with pytest.raises(ValueError, match="pivot_long"):
            pivots.pivot_table(df, ["k"], "v", "sum", "h")
        assert pivots.pivot_long(df, ["k"], "v", "sum", "h").count() == 20
        page = pivots.pivot_page(df, ["k"], "v", "sum", "h", page=3, page_size=6)
        assert page.columns == ["k", "18", "19"]
        assert [tuple(r) for r in page.orderBy("k").collect()] == [(0, 18 + 38, 0), (1, 0, 19 + 39)]
        assert pivots.pivot_page(df, ["k"], "v", "sum", "h", page=4, page_size=6).count() == 0
    finally:
        spark.conf.unset("spark.sql.pivotMaxValues")


def test_long_pivot_refuses_taken_names_and_takes_empty_tables(sales, spark):
    with pytest.raises(ValueError):
        pivots.pivot_long(sales.withColumnRenamed("Port", "value"), ["value"], "Tons", "sum", "Cargo")
    assert pivots.pivot_long(sales.limit(0), ["Port"], "Tons", "sum", "Cargo").count() == 0
