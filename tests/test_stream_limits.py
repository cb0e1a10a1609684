import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sheetloom.catalog import reports
from sheetloom.operators import limits
from sheetloom.streaming.fixes import run_available
from sheetloom.streaming.limits import admit_stream, admitted_events, run_admission

START = dt.datetime(2024, 1, 1)


def _admitted(spark, stream, root, n, close=False, lateness="30 seconds"):
    run_admission(stream, ["who"], "ts", "event_id", n, 60, root, lateness=lateness, close=close)
    return admitted_events(spark, root, "ts", "event_id", n)


def _ids(df):
    return sorted((r["who"] or "", r["window_start"], r["event_id"]) for r in df.collect())


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_stream_admits_what_the_table_form_admits(spark, tmp_path, kind):
    """Arrival is shuffled within the lateness, one key has most events, one key is null, times repeat."""
    rng = random.Random(4)
    events = []
    for i in range(600):
        who = "hot" if i % 3 else rng.choice(["a", "b", None])
        events.append((f"e{i:04d}", who, START + dt.timedelta(seconds=i // 2)))
    schema = f"event_id string, who string, ts {kind}"
    folder = tmp_path / "in"
    folder.mkdir()
    stream = spark.readStream.schema(schema).parquet(str(folder))
    root = str(tmp_path / "run")
    seen = 0
    for a in range(0, 600, 50):
        part = events[a : a + 50]
        rng.shuffle(part)
        spark.createDataFrame(part, schema).write.mode("append").parquet(str(folder))
        if a % 200 == 150:
            got = _ids(_admitted(spark, stream, root, 4))
            assert len(got) >= seen
            seen = len(got)
    assert seen > 0
    table = spark.createDataFrame(events, schema)
    want = _ids(limits.admitted(table, ["who"], "ts", "event_id", 4, 60))
    assert _ids(_admitted(spark, stream, root, 4)) != want  # the newest windows are open
    got = _admitted(spark, stream, root, 4, close=True)
    assert _ids(got) == want
    times = {r["event_id"]: r["ts"] for r in got.collect()}
    assert all(times[e] == t for e, _, t in events if e in times)


def test_late_and_incomplete_events_take_no_part(spark, tmp_path):
    schema = "event_id long, who string, ts timestamp"
    folder = tmp_path / "in"
    folder.mkdir()
    stream = spark.readStream.schema(schema).parquet(str(folder))
    root = str(tmp_path / "run")

    def add(*rows):
        df = spark.createDataFrame([(i, w, None if s is None else START + dt.timedelta(seconds=s)) for i, w, s in rows], schema)
        df.write.mode("append").parquet(str(folder))

    assert _admitted(spark, stream, root, 2).collect() == []  # no events yet
    add((1, "a", 50), (2, "a", 40), (3, "a", 55), (None, "a", 1), (4, "a", None))
    assert _admitted(spark, stream, root, 2).collect() == []
    add((5, "a", 300))
    assert [i for _, _, i in _ids(_admitted(spark, stream, root, 2))] == [1, 2]
    add((6, "a", 0))  # its window is closed
    assert [i for _, _, i in _ids(_admitted(spark, stream, root, 2, close=True))] == [1, 2, 5]


def test_one_window_with_many_events(spark, tmp_path):
    df = spark.range(20_000).select(
        F.col("id").alias("event_id"), F.lit("k").alias("who"), (F.lit(START) + F.make_interval(secs=F.col("id") % 7)).alias("ts")
    )
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = _admitted(spark, stream, str(tmp_path / "run"), 50, close=True)
    assert [i for _, _, i in _ids(got)] == [7 * i for i in range(50)]


def test_states_hold_many_keys(spark, tmp_path):
    """A state for every key and window made Python calls grow with the keys."""
    df = spark.range(400).select(
        F.col("id").alias("event_id"), F.col("id").cast("string").alias("who"), F.lit(START).alias("ts")
    )
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run_admission(stream, ["who"], "ts", "event_id", 2, 60, str(tmp_path / "run"), groups=8)
    run_available(admit_stream(stream, ["who"], "ts", 2, 60, groups=8), str(tmp_path / "out"), str(tmp_path / "check"))
    assert spark.read.parquet(str(tmp_path / "out")).where("allowed").count() == 400
    for checkpoint in ("run/checkpoint", "check"):
        assert 1 <= spark.read.format("statestore").load(str(tmp_path / checkpoint)).count() <= 8


def test_arrival_with_nulls_and_large_numbers(spark, tmp_path):
    """Whole numbers beyond 2^53 beside nulls, zeros of both signs, null keys, events without a time."""
    big = (1 << 53) + 1
    keys = [(big, 0.0), (big, -0.0), (big + 1, 0.0), (None, None), (None, None), (None, 1.0)]
    rows = [(i, k, x, None if t else START, None if i % 2 else big + 2) for t in (0, 1) for i, (k, x) in enumerate(keys)]
    df = spark.createDataFrame(rows, "event_id long, k long, x double, ts timestamp, note long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run_available(admit_stream(stream, ["k", "x"], "ts", 1, 60), str(tmp_path / "out"), str(tmp_path / "check"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.select(*df.columns).dtypes == df.dtypes
    assert sorted(map(str, out.select(*df.columns).collect())) == sorted(map(str, df.collect()))
    for timeless in (True, False):
        passed = out.where(F.col("ts").isNull() == F.lit(timeless)).where("allowed")
        assert passed.where(f"k = {big}").count() == passed.where(f"k = {big + 1}").count() == 1
        assert passed.where("k IS NULL AND x IS NULL").count() == passed.where("x = 1").count() == 1


@pytest.mark.parametrize("kind", ["binary", "double", "date", "timestamp", "decimal(20, 3)", "boolean"])
def test_keys_of_any_type_come_back(spark, tmp_path, kind):
    values = ["1", "0", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values * 2)], "event_id long, v string")
    whole = F.when(F.col("v") == "1", START + dt.timedelta(microseconds=7)).when(F.col("v") == "0", START - dt.timedelta(days=9))
    key = whole.cast(kind) if kind in ("date", "timestamp") else F.col("v").cast(kind)
    df = df.select("event_id", key.alias("who"), F.lit(START).alias("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = _admitted(spark, stream, str(tmp_path / "run"), 1, close=True)
    want = limits.admitted(df, ["who"], "ts", "event_id", 1, 60)
    assert got.schema["who"].dataType == df.schema["who"].dataType
    assert sorted(map(str, got.select("event_id", "who").collect())) == sorted(map(str, want.select("event_id", "who").collect()))


@pytest.mark.parametrize("files", [1, 3])
def test_stream_reads_a_table_of_any_number_of_files(spark, tmp_path, files):
    df = spark.range(30).select(F.col("id").alias("event_id"), F.lit(START).alias("ts"))
    whole = tmp_path / "whole"
    df.repartition(files).write.parquet(str(whole))
    if files == 1:
        (tmp_path / "events.parquet").write_bytes(next(whole.glob("part-*")).read_bytes())
    else:
        df.repartition(files).write.parquet(str(tmp_path / "events.parquet"))
    assert reports._run(spark, reports._stream(spark, str(tmp_path), "events"), "copied").count() == 30
