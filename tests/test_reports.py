import pytest
from pyspark.sql import functions as F

from sheetloom.operators import anomalies, limits, missing, quality
from tests.conftest import rows, values


def fill(df, **strategies):
    return missing.fill_missing(df, strategies)


def test_missing_report(sheet):
    df = sheet("n long, t string, num string, full long", [(1, "a", "1", 1), (None, " ", "2", 2), (None, None, None, 3)])
    report = [tuple(r) for r in missing.missing_report(df).collect()]
    assert report == [
        (0, "n", "bigint", True, 2, 66.7, "median"),
        (1, "t", "string", False, 2, 66.7, "mode"),
        (2, "num", "string", False, 1, 33.3, "mode"),
        (3, "full", "bigint", True, 0, 0.0, None),
    ]
    assert missing.missing_totals(df).first() == (3, 5)
    assert [r["column"] for r in missing.top_missing(df, 2).collect()] == ["n", "t"]
    mostly = sheet("t string", ["1", "2", "3", "4", None])
    assert missing.missing_report(mostly).first()["suggested_method"] == "median"


def test_fill_statistics(sheet):
    df = sheet("v double, c string, i long", [(1.0, "b", 1), (None, "a", None), (4.0, " ", 4), (10.0, None, 2), (None, "c", 3)])
    assert values(fill(df, v={"method": "mean"}), "v") == [1, 5, 4, 10, 5]
    assert values(fill(df, v={"method": "median"}), "v") == [1, 4, 4, 10, 4]
    assert values(fill(df, i={"method": "median"}), "i") == [1, 2.5, 4, 2, 3]
    assert values(fill(df, c={"method": "mode"}), "c") == ["b", "a", "a", "a", "c"]
    assert values(fill(df, c={"method": "mean"}), "c") == ["b", "a", " ", None, "c"]
    numbers = sheet("c string", ["1", None, "4"])
    assert values(fill(numbers, c={"method": "mean"}), "c") == ["1", "2.5", "4"]


def test_fill_constant_widens_only_if_needed(sheet):
    df = sheet("i long, v double, c string, full long", [(1, None, "x", 1), (None, 2.5, "", 2)])
    out = fill(df, i={"method": "constant", "value": 7}, v={"method": "constant", "value": "?"},
               c={"method": "constant", "value": 0}, full={"method": "constant", "value": "?"})
    assert rows(out) == [(1, "?", "x", 1), (7, "2.5", "0", 2)]
    assert [t for _, t in out.dtypes] == ["bigint", "bigint", "string", "string", "bigint"]
    assert values(fill(df, i={"method": "constant"}), "i") == ["1", ""]


def test_fill_directions_and_rows(sheet):
    df = sheet("c string, v long", [(" ", None), ("a", 1), ("", None), (None, 3), ("b", None)])
    assert values(fill(df, c={"method": "ffill"}), "c") == [None, "a", "a", "a", "b"]
    assert values(fill(df, c={"method": "bfill"}, v={"method": "bfill"}), "c") == ["a", "a", "b", "b", "b"]
    assert values(fill(df, v={"method": "bfill"}), "v") == [1, 1, 3, 3, None]
    assert values(fill(df, v={"method": "drop_rows"}), "v") == [1, 3]


def test_fill_order_and_unknowns(sheet):
    df = sheet("k string, v double", [("x", 1.0), (None, 100.0), ("y", None), ("z", 3.0)])
    out = fill(df, nope={"method": "mean"}, v={"method": "what"}, k={"method": "drop_rows"})
    assert len(rows(out)) == 3
    assert values(missing.fill_missing(df, {"k": {"method": "drop_rows"}, "v": {"method": "mean"}}), "v") == [1, 2, 3]
    assert values(missing.fill_missing(df, {"v": {"method": "median"}, "k": {"method": "drop_rows"}}), "v") == [1, 3, 3]
    assert values(fill(sheet("v double", [None, None]), v={"method": "median"}), "v") == [None, None]


def test_anomalies(sheet):
    few = sheet("Price double", [1.0] * 9)
    assert anomalies.detect_anomalies(few, "Price").count() == 0
    prices = [1000.0 + i for i in range(20)] + [150000.0]
    found = anomalies.detect_anomalies(sheet("Price double", prices), "Price").collect()
    # median 1010, MAD 5
    assert [(r[0], r[2], r[3]) for r in found] == [(20, 150000.0, round(0.6745 * 148990 / 5, 2))]
    text = sheet("P string", [str(p) for p in prices] + ["n/a", None])
    assert [r[0] for r in anomalies.detect_anomalies(text, "P").collect()] == [20]
    flat = sheet("P double", [5.0] * 30 + [6.0])
    assert [(r[0], r[3]) for r in anomalies.detect_anomalies(flat, "P").collect()] == [(30, 31.0)]
    assert anomalies.detect_anomalies(sheet("P double", [5.0] * 30), "P").count() == 0
    with pytest.raises(ValueError):
        anomalies.detect_anomalies(few, "Nope")


def test_anomalies_in_several_columns(sheet):
    df = sheet("a double, b double", [(float(i), float(i % 3)) for i in range(20)] + [(900.0, 1.0), (1.0, 77.0)])
    found = anomalies.detect_anomalies(df, ["a", "b"])
    assert {(r["column"], r["_row_id"]) for r in found.collect()} == {("a", 20), ("b", 21)}
    assert anomalies.count_anomalies(df, ["a", "b"]) == {"a": 1, "b": 1}


def test_quality(sheet, messy):
    clean = quality.quality_report(sheet("A long, B string", [(i, c) for i, c in enumerate("xyz")]))
    assert clean.score >= 90 and clean.grade == "A" and clean.issues[0]["type"] == "none"
    report = quality.quality_report(messy)
    assert report.score < 100
    assert {i["type"] for i in report.issues} >= {"missing_values", "duplicate_rows"}
    assert report.duplicate_rows == 2 and report.total_missing_cells == 5
    # 5 of 30 cells: 16.7 % -> 25.05; 2 of 10 rows: 20 % -> 25
    assert report.score == round(100 - 25.05 - 25)
    assert report.as_dict()["missing_by_column"][0]["column"] == "Weight"


def test_quality_mixed_and_anomalies(sheet, spark):
    df = sheet("m string, p double, f boolean", [(str(i) if i % 2 else f"x{i}", 100.0 + i, True) for i in range(19)] + [("y", 99999.0, True)])
    report = quality.quality_report(df)
    assert report.mixed_type_columns == ["m"]
    assert report.anomaly_columns == [{"column": "p", "count": 1}]
    assert report.score == round(100 - 0.8 - 5)
    assert {r["type"] for r in report.issues_frame(spark).collect()} == {"anomalies", "mixed_types"}
    assert report.to_frame(spark).first()["score"] == report.score


def test_grades():
    assert [quality.grade(s) for s in (95, 80, 65, 45, 20)] == ["A", "B", "C", "D", "F"]


def test_rate_limit(spark):
    data = [(i, "a", f"2024-01-01 00:00:{i:02d}") for i in range(6)] + [(6, "b", "2024-01-01 00:00:01"), (7, "a", "2024-01-01 00:01:00")]
    df = spark.createDataFrame(data, "event_id long, who string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    out = limits.rate_limit(df, ["who"], "ts", "event_id", 5, 60).orderBy("event_id")
    assert [r["allowed"] for r in out.collect()] == [True] * 5 + [False, True, True]
    assert limits.admitted(df, ["who"], "ts", "event_id", 5, 60).count() == 7
    usage = limits.window_usage(df, ["who"], "ts", 5, 60).collect()
    assert sorted((r["who"], r["events"], r["allowed"], r["refused"]) for r in usage) == [
        ("a", 1, 1, 0), ("a", 6, 5, 1), ("b", 1, 1, 0),
    ]
    plan = limits.admitted(df, ["who"], "ts", "event_id", 5, 60)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
