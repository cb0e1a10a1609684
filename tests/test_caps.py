"""No cap on columns or steps, errors told apart, windows without a zone."""

import datetime

import pytest

from sheetloom.operators import limits, quality
from sheetloom.plans import recipes
from tests.conftest import rows


def test_quality_looks_at_every_numeric_column(sheet):
    names = [f"n{i}" for i in range(34)]
    data = [tuple(float(r + c) for c in range(34)) for r in range(12)] + [tuple([5.0 + c for c in range(33)] + [99999.0])]
    df = sheet(", ".join(f"{n} double" for n in names), data)
    assert [a["column"] for a in quality.quality_report(df).anomaly_columns] == ["n33"]
    assert quality.quality_report(df, max_numeric_columns=30).anomaly_columns == []


def test_a_bad_pattern_is_skipped_with_its_reason(sheet):
    df = sheet("Note string", ["a(b", "c"])
    step = {"action": "if", "params": {"column": "Note", "op": "contains", "value": "(", "true_value": "1", "false_value": "0", "new_column": "R"}}
    replay = recipes.apply_recipe(df, [step, {"action": "serial_number", "params": {}}])
    assert len(replay.skipped) == 1 and "pattern" in replay.skipped[0]["reason"]
    assert [r[0] for r in rows(replay.df)] == [1, 2]


def test_a_failing_job_ends_the_replay(sheet, monkeypatch):
    def broken(df, p):
        raise RuntimeError("executor lost")

    monkeypatch.setitem(recipes.STEPS, "rank", broken)
    with pytest.raises(RuntimeError):
        recipes.apply_recipe(sheet("A long", [1]), [{"action": "rank", "params": {}}])


def test_windows_do_not_move_with_the_session_zone(spark):
    day = 86_400
    df = spark.createDataFrame([(1, datetime.datetime(2024, 3, 1, 23, 30))], "k long, ts timestamp_ntz")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        found = set()
        for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            found.add(df.select(limits.window_start(df, "ts", day)).first()[0])
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert found == {19783 * day}
