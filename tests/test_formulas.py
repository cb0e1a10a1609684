import inspect

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sheetloom.functions.conditions import condition
from sheetloom.operators import aggregates, distinct, formulas, lookups, medians, ordered, pivots
from tests.conftest import rows, values


@pytest.fixture(scope="module")
def staff(sheet):
    return sheet("EmpID long", [101, 102, 103])


@pytest.fixture(scope="module")
def depts(sheet):
    return sheet("EmpID long, Dept string", [(101, "Sales"), (102, "Tech"), (101, "Late")])


def test_vlookup(staff, depts):
    out = lookups.vlookup(staff, depts, "EmpID", "EmpID", ["Dept"])
    assert values(out, "Dept") == ["Sales", "Tech", None]
    assert lookups.lookup_match_count(staff, depts, "EmpID", "EmpID").first() == (2, 3)
    assert lookups.index_match is lookups.vlookup


def test_vlookup_inner_null_keys_and_clash(sheet):
    df = sheet("k string, v string", [("a", "1"), (None, "2"), ("z", "3")])
    other = sheet("key string, v string", [(None, "null"), ("a", "first"), ("a", "second")])
    out = lookups.vlookup(df, other, "k", "key", ["v"], how="inner")
    assert rows(out) == [("a", "1", "first"), (None, "2", "null")]
    assert out.columns == ["_row_id", "k", "v", "v_lookup"]


def test_vlookup_errors(staff, depts, sheet):
    for args in [("Nope", "EmpID", ["Dept"]), ("EmpID", "Nope", ["Dept"]), ("EmpID", "EmpID", ["Nope"])]:
        with pytest.raises(ValueError):
            lookups.vlookup(staff, depts, *args)
    with pytest.raises(ValueError):
        lookups.vlookup(staff, depts, "EmpID", "EmpID", ["Dept"], how="outer")
    with pytest.raises(ValueError):
        lookups.vlookup(staff, sheet("EmpID string, D string", [("101", "x")]), "EmpID", "EmpID", ["D"])


def test_hlookup(sheet):
    across = sheet("Jan string, Feb string", [("Jan", "Feb"), ("100", "200")])
    out = lookups.hlookup(sheet("Month string", ["Jan", "Feb", "Mar"]), across, "Month", 0, 1)
    assert values(out, "Lookup Value") == ["100", "200", None]
    numbers = sheet("a long, b long", [(1, 2), (10, 20)])
    assert values(lookups.hlookup(sheet("k long", [2, 1]), numbers, "k", 0, 1), "Lookup Value") == ["20", "10"]
    for bad in [(-1, 1), (0, 2)]:
        with pytest.raises(ValueError):
            lookups.hlookup(sheet("Month string", ["Jan"]), across, "Month", *bad)


def test_pivot(sales):
    out = pivots.pivot_table(sales, ["Port"], "Tons").collect()
    assert [tuple(r) for r in out] == [("Aden", 44), ("Bergen", 19)]
    with pytest.raises(ValueError):
        pivots.pivot_table(sales, [], "Tons")
    with pytest.raises(ValueError):
        pivots.pivot_table(sales, ["Port"], "Tons", "mode")
    with pytest.raises(ValueError):
        pivots.pivot_table(sales, ["Nope"], "Tons")


def test_pivot_with_columns(sheet):
    data = [("N", "b", 1.0), ("N", "a", 2.0), ("S", "a", 3.0), (None, "a", 9.0), ("S", None, 9.0), ("T", "c", None)]
    df = sheet("r string, c string, v double", data)
    out = pivots.pivot_table(df, ["r"], "v", "mean", "c")
    assert out.columns == ["r", "a", "b"]
    assert [tuple(r) for r in out.collect()] == [("N", 2.0, 1.0), ("S", 3.0, 0.0)]
    out = pivots.pivot_table(df, ["r"], "v", "sum", "c")
    assert [tuple(r) for r in out.collect()] == [("N", 2.0, 1.0, 0.0), ("S", 3.0, 0.0, 0.0), ("T", 0.0, 0.0, 0.0)]


def test_pivot_of_text_and_limits(sheet, spark):
    df = sheet("r string, v string", [("a", "1"), ("a", "x"), ("b", "y"), ("b", None)])
    assert [tuple(r) for r in pivots.pivot_table(df, ["r"], "v", "sum").collect()] == [("a", 1.0), ("b", 0.0)]
    assert [tuple(r) for r in pivots.pivot_table(df, ["r"], "v", "mean").collect()] == [("a", 1.0)]
    assert [tuple(r) for r in pivots.pivot_table(df, ["r"], "v", "max").collect()] == [("a", "x"), ("b", "y")]
    spark.conf.set("spark.sql.pivotMaxValues", "2")
    try:
        with pytest.raises(ValueError):
            pivots.pivot_table(df, ["r"], "v", "count", "v")
    finally:
        spark.conf.unset("spark.sql.pivotMaxValues")


def test_if(sheet):
    df = sheet("Score long, Notes string", [(3, "leaks at night"), (8, "dry"), (None, None)])
    out = formulas.if_column(df, "Score", ">=", 5, "high", "low", "Level")
    assert values(out, "Level") == ["low", "high", "low"]
    out = formulas.if_column(df, "Notes", "contains", "LEAK", "look", "fine", "Notes")
    assert values(out, "Notes") == ["look", "fine", "fine"]
    assert values(formulas.if_column(df, "Score", ">", "5", 1, 2.5, "N"), "N") == [2.5, 1, 2.5]
    assert values(formulas.if_column(df, "Score", ">", 5, "x", 1, "N"), "N") == ["1", "x", "1"]
    with pytest.raises(ValueError):
        formulas.if_column(df, "Score", ">", 1, 1, 0, "  ")


def test_conditions_on_blanks_and_text(sheet):
    df = sheet("n long, t string", [(1, "10"), (None, None), (3, "abc"), (4, "9")])

    def hits(*args):
        return values(df.withColumn("hit", condition(df, *args)), "hit")

    assert hits("n", "!=", 1) == [False, True, True, True]
    assert hits("n", "<", 4) == [True, False, True, False]
    assert hits("n", "==", "abc") == [False] * 4
    assert hits("n", "!=", "abc") == [True] * 4
    assert hits("t", "not_contains", "B") == [True, True, False, True]
    assert hits("t", "<", "5") == [True, False, False, False]  # half the rows parse: compared as text
    assert values(df.withColumn("hit", condition(df, "t", "<", 5, numeric=True)), "hit") == [False] * 4
    with pytest.raises(ValueError):
        condition(df, "n", ">", "abc")
    with pytest.raises(ValueError):
        condition(df, "n", "~", 1)
    with pytest.raises(ValueError):
        condition(df, "N", ">", 1)


def test_aggregates(sales, sheet):
    agg = aggregates.aggregate_value
    assert agg(sales, "Tons", "sum") == 63
    bergen = {"condition_column": "Port", "condition_op": "==", "condition_value": "Bergen"}
    assert agg(sales, "Tons", "sumif", **bergen) == 19
    assert agg(sales, "Tons", "averageif", **bergen) == 9.5
    assert agg(sales, "Tons", "countif", condition_column="Port", condition_op="==", condition_value="Aden") == 3
    df = sheet("v string", ["1", "x", "", None, "4", "10"])
    expected = {"sum": 15, "average": 5, "count": 3, "counta": 5, "min": 1, "max": 10, "median": 4}
    assert {f: agg(df, "v", f) for f in expected} == expected
    empty = sheet("v string", ["x"])
    assert {f: agg(empty, "v", f) for f in expected} == {**dict.fromkeys(expected, 0), "counta": 1}
    for bad in [("sumif", {}), ("mode", {}), ("sumif", {**bergen, "condition_value": ""})]:
        with pytest.raises(ValueError):
            agg(sales, "Tons", bad[0], **bad[1])
    with pytest.raises(ValueError):
        agg(sales, "Nope", "sum")


def test_concatenate(sheet):
    df = sheet("First string, Last string, N double", [("Mona", "Lind", 1.5), (None, "X", 12345678.9)])
    out = formulas.concatenate(df, ["First", "Last", "N"], " ", "Full")
    assert values(out, "Full") == ["Mona Lind 1.5", " X 12345678.9"]
    with pytest.raises(ValueError):
        formulas.concatenate(df, ["First"], " ", "Full")
    with pytest.raises(ValueError):
        formulas.concatenate(df, ["First", "Nope"], " ", "Full")


@pytest.mark.parametrize(
    "mode, args, result",
    [
        ("left", {"n": 2}, "Qx"), ("right", {"n": 4}, "9-é7"), ("right", {"n": 30}, "Qx09-é7"),
        ("mid", {"start": 3, "length": 2}, "9-"), ("mid", {"start": 0, "length": 1}, "Q"), ("len", {}, 7),
    ],
)
def test_text_extract(sheet, mode, args, result):
    df = sheet("Code string", ["Qx09-é7", None])
    assert values(formulas.text_extract(df, "Code", mode, "out", **args), "out") == [result, None]


@pytest.mark.parametrize("mode, args", [("left", {}), ("right", {"n": 0}), ("mid", {"start": -1, "length": 2}), ("up", {})])
def test_text_extract_errors(sheet, mode, args):
    with pytest.raises(ValueError):
        formulas.text_extract(sheet("Code string", ["A"]), "Code", mode, "out", **args)


def test_serial_number(sheet):
    out = ordered.serial_number(sheet("A long", [10, 20, 30]))
    assert out.columns[0] == "Sr No" and values(out, "Sr No") == [1, 2, 3]
    again = ordered.serial_number(out.where("A > 10"), start=5)
    assert values(again, "Sr No") == [5, 6] and again.columns.count("Sr No") == 1


def test_rank(sheet):
    df = sheet("Score string", ["45", "90", "60", "90", "x", None])
    assert values(ordered.rank_column(df, "Score", "R"), "R") == [4.0, 1.0, 3.0, 1.0, None, None]
    assert values(ordered.rank_column(df, "Score", "R", ascending=True), "R") == [1.0, 3.0, 2.0, 3.0, None, None]
    assert ordered.rank_column(df, "Score", "Score").columns == df.columns


def test_rank_and_fill_equal_pandas_on_skewed_data(spark):
    df = spark.range(5000).select(
        F.col("id").alias("_row_id"),
        F.when(F.col("id") % 3 == 0, 7.0).when(F.col("id") % 5 != 1, F.pmod(F.xxhash64("id"), F.lit(900)) / 3.0).alias("v"),
        F.when(F.col("id") % 701 == 13, F.concat(F.lit("t"), F.col("id"))).when(F.col("id") % 2 == 0, " ").alias("t"),
    )
    pdf = df.toPandas().sort_values("_row_id").reset_index(drop=True)
    for ascending in (True, False):
        got = ordered.rank_column(df, "v", "r", ascending).toPandas().sort_values("_row_id")["r"].reset_index(drop=True)
        assert got.equals(pdf["v"].rank(method="min", ascending=ascending).rename("r"))
    blanked = pdf["t"].where(pdf["t"].fillna("").str.strip() != "")
    out = ordered.directional_fill(df, ["t"], ["v"]).toPandas().sort_values("_row_id").reset_index(drop=True)
    assert out["t"].fillna("").tolist() == blanked.ffill().fillna("").tolist()
    assert out["v"].equals(pdf["v"].bfill())


def test_no_task_sees_the_whole_table(spark):
    """Counts of ranges come from the driver, so nothing meets in a single partition."""
    df = spark.range(1000).select(F.col("id").alias("_row_id"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("v"))
    for out in (ordered.serial_number(df), ordered.rank_column(df, "v", "r"), ordered.forward_fill(df, "v")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" in plan and plan.count("Exchange SinglePartition") == 0
    assert ordered.forward_fill(df.fillna(0), "v")._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0  # nothing to fill


def test_unique_and_duplicates(sheet):
    df = sheet("City string", ["Lima", "Oslo", None, "Lima", ""])
    assert [r["City"] for r in distinct.unique_values(df, "City").collect()] == ["Lima", "Oslo", ""]
    assert distinct.duplicate_count(df).first()[0] == 1
    assert values(distinct.drop_rows(df, [0, 3, 99]), "City") == ["Oslo", None, ""]
    assert values(distinct.drop_missing_rows(df, "City"), "City") == ["Lima", "Oslo", "Lima"]


def test_order_keys_are_the_bits_of_doubles(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([
        rng.integers(-(2**63), 2**63, 20_000).view(np.float64), rng.normal(size=2000), rng.integers(-1000, 1000, 500) / 100.0,
        np.exp2(np.arange(-1074, 1024).astype(float)), -np.exp2(np.arange(-1074, 1024, 7).astype(float)), [0.0, np.inf, -np.inf],
    ])
    powers = np.exp2(np.arange(-1020, 1024).astype(float))
    x = np.concatenate([x[~np.isnan(x)], np.nextafter(powers, 0), np.nextafter(powers, np.inf), [5e-324, 2.2250738585072014e-308, 1.7976931348623157e308]])
    bits = np.abs(x).view(np.int64)
    df = spark.createDataFrame([(float(v), int(b)) for v, b in zip(x, np.where(x < 0, -bits, bits))], "v double, want long")
    assert medians.with_order_keys(df, {"v": "key"}).where("NOT key <=> want").count() == 0


def test_exact_medians_of_many_columns(spark):
    df = spark.range(20001).select(
        (F.pmod(F.xxhash64("id"), F.lit(10**9)) / 7.0).alias("a"),
        F.when(F.col("id") % 3 != 0, 5.0).otherwise(F.col("id").cast("double")).alias("hot"),
        F.when(F.col("id") < 8, F.col("id").cast("double")).alias("few"),
        F.lit(None).cast("double").alias("none"),
        F.when(F.col("id") < 20000, F.when(F.col("id") % 2 == 0, -1.0).otherwise(1e300)).alias("two"),
        (1 + F.col("id") * F.lit(2.0**-52)).alias("last bits"),
        F.when(F.col("id") % 2 == 0, -0.0).otherwise(0.0).alias("zeros"),
        (-F.col("id") * F.lit(5e-324)).alias("least"),
    )
    pdf = df.toPandas()
    got, extra = medians.exact_medians(df, {c: F.col(f"`{c}`") for c in df.columns}, {"n": F.count(F.lit(1))})
    assert extra == {"n": 20001}
    assert got["none"] == (0, None)
    for c in pdf.columns.drop("none"):
        assert got[c] == (pdf[c].count(), pdf[c].median()), c
    assert medians.exact_medians(df.limit(0), {"a": F.col("a")})[0] == {"a": (0, None)}


def test_grouped_median_of_hot_and_small_groups(spark):
    group = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, F.concat(F.lit("own"), F.col("id"))).otherwise(F.concat(F.lit("g"), F.col("id") % 11))
    df = spark.range(6000).select(
        F.when(F.col("id") % 29 != 0, group).alias("g"), (F.col("id") % 2).alias("h"),
        F.when(F.col("id") % 13 != 0, F.pmod(F.xxhash64("id"), F.lit(5000)) / 7.0).alias("v"),
    )
    want = df.toPandas().groupby(["g", "h"], dropna=False)["v"].median().dropna().to_dict()
    got = medians.grouped_median(df, ["g", "h"], F.col("v"), "m").collect()
    assert {(r["g"], r["h"]): r["m"] for r in got} == {(None if pd.isna(g) else g, h): m for (g, h), m in want.items()}
    assert len(got) == len(want)


def test_no_pass_of_a_median_sorts_or_lists_values(spark):
    """Spark's own median and lists keep a group's values in one task."""
    code = inspect.getsource(medians)
    assert "F.median" not in code and "collect_list" not in code and "percentile" not in code
