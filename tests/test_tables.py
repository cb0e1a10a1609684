import pytest
from pyspark.sql import functions as F

from sheetloom.operators.ordered import preview_summary
from sheetloom.plans import recipes
from sheetloom.plans.sheet_session import NoLookupTable, NothingToRedo, NothingToUndo, SessionNotFound, SheetSession
from sheetloom.sources.tables import (
    detect_delimiter,
    normalize_headers,
    read_delimited,
    read_parquet,
    read_table,
    write_csv,
    write_parquet,
)
from sheetloom.sources.workbook import SheetNotFound, open_workbook
from sheetloom.streaming.fixes import apply_fixes, run_available
from sheetloom.streaming.limits import admit_stream
from tests.conftest import rows, values


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_read_delimited(spark, tmp_path, sep):
    lines = [["Name", " Age ", "", "Ok", "Pay"], ["Mona", "61", "x", "True", "1.5"], ["", "", "", "", ""],
             ["Otto", "N/A", "NULL", "false", "2"]]
    df = read_delimited(spark, write(tmp_path / "t.csv", "\n".join(sep.join(line) for line in lines) + "\n"))
    assert df.dtypes[:-1] == [
        ("Name", "string"), ("Age", "bigint"), ("column_2", "string"), ("Ok", "boolean"), ("Pay", "double")
    ]
    assert rows(df)[0] == ("Mona", 61, "x", True, 1.5)
    assert rows(df)[-1] == ("Otto", None, None, False, 2.0)


def test_single_column_and_quotes(spark, tmp_path):
    df = read_delimited(spark, write(tmp_path / "one.csv", "EmpID\n101\n102\n"))
    assert df.columns == ["EmpID", "_row_id"] and values(df, "EmpID") == [101, 102]
    df = read_delimited(spark, write(tmp_path / "q.csv", 'a,b\n"x, ""y""",1\n'))
    assert rows(df) == [('x, "y"', 1)]
    with pytest.raises(ValueError):
        read_delimited(spark, write(tmp_path / "empty.csv", ""))
    with pytest.raises(ValueError):
        read_table(spark, "table.txt")


def test_headers_and_delimiter():
    assert normalize_headers([" a ", "", "a", "a", "b"]) == ["a", "column_1", "a.1", "a.2", "b"]
    assert detect_delimiter("EmpID\n1\n2\n") == ","


def test_row_order_over_several_files(spark, tmp_path):
    df = spark.range(1000).select(F.col("id").alias("n"))
    folder = str(tmp_path / "parts.csv")
    df.repartitionByRange(7, "n").sortWithinPartitions("n").write.options(header=True).csv(folder)
    assert values(read_delimited(spark, folder), "n") == list(range(1000))
    folder = str(tmp_path / "parts.parquet")
    df.repartitionByRange(7, "n").sortWithinPartitions("n").write.parquet(folder)
    assert values(read_parquet(spark, folder), "n") == list(range(1000))


def test_csv_round_trip(spark, sheet, tmp_path):
    df = sheet("Name string, V double, `a b` string", [("é", 1.5, 'x "y", z'), (None, None, "₹")])
    path = str(tmp_path / "out.csv")
    write_csv(df, path)
    part = next((tmp_path / "out.csv").glob("part-*.csv"))
    assert part.read_bytes().startswith(b"\xef\xbb\xbf")
    assert rows(read_delimited(spark, path)) == rows(df)
    write_parquet(df, str(tmp_path / "out.parquet"))
    assert rows(read_table(spark, str(tmp_path / "out.parquet"))) == rows(df)


def test_nan_is_blank(spark, tmp_path):
    path = str(tmp_path / "n.parquet")
    spark.createDataFrame([(float("nan"),), (1.0,)], "v double").coalesce(1).write.parquet(path)
    assert values(read_parquet(spark, path), "v") == [None, 1.0]


def test_workbook(spark, tmp_path):
    write(tmp_path / "Feb.csv", "A\n2\n3\n")
    write(tmp_path / "Jan.csv", "A\n1\n")
    book = open_workbook(spark, str(tmp_path))
    assert book.names == ["Feb", "Jan"] and book.active == "Feb"
    assert values(book.switch("Jan"), "A") == [1]
    with pytest.raises(SheetNotFound):
        book.switch("Mar")
    assert open_workbook(spark, str(tmp_path / "Jan.csv")).names == ["Sheet1"]
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError):
        open_workbook(spark, str(tmp_path / "none"))


def test_preview(messy):
    shown = preview_summary(messy, 4)
    assert shown["row_count"] == 10 and shown["columns"] == ["Tool", "Weight", "Shelf"]
    assert shown["rows"][2] == {"Tool": "Saw", "Weight": "", "Shelf": "B2"}


def test_undo_redo_reset(spark, sheet, tmp_path):
    two, three = sheet("A long", [1, 2]), sheet("A long", [1, 2, 3])
    session = SheetSession.create(spark, two, root=str(tmp_path / "s"))
    with pytest.raises(NothingToUndo):
        session.undo()
    with pytest.raises(NothingToRedo):
        session.redo()
    assert session.status() == {"history": [], "can_undo": False, "can_redo": False}
    session.update(three, "add row", "one more")
    assert session.working.count() == 3 and session.status()["can_undo"]
    assert session.undo().count() == 2
    assert session.redo().count() == 3
    assert session.reset().count() == 2 and session.status()["history"] == []
    assert session.undo().count() == 3
    session.update(two)
    assert not session.status()["can_redo"]
    again = SheetSession.open(spark, str(tmp_path / "s"))
    assert again.working.count() == 2 and again.status() == session.status()
    with pytest.raises(SessionNotFound):
        SheetSession.open(spark, str(tmp_path / "nowhere"))


def test_version_retention(spark, sheet, tmp_path):
    session = SheetSession.create(spark, sheet("A long", [0]), root=str(tmp_path / "s"))
    session.retention = 4
    for i in range(1, 7):
        session.update(sheet("A long", [i]))
    undone = 0
    while session.status()["can_undo"]:
        session.undo()
        undone += 1
    assert undone == 4
    assert session.vacuum() == [1] and values(session.original, "A") == [0]


def test_lookup_sheets_and_steps(spark, sheet, tmp_path):
    jan, feb = sheet("A long", [1]), sheet("A long", [2, 3])
    session = SheetSession.create(spark, sheets={"Jan": jan, "Feb": feb}, root=str(tmp_path / "s"))
    assert session.sheet_names() == {"sheets": ["Jan", "Feb"], "active_sheet": "Jan"}
    with pytest.raises(NoLookupTable):
        session.lookup
    session.set_lookup(sheet("Key long, Value string", [(1, "x")]))
    assert values(session.lookup, "Value") == ["x"]
    for i in range(52):
        session.log_step("rank", {"column": "A", "new_column": str(i)}) if i > 49 else None
    session.log_step("drop_rows", {"rows": [1]})
    assert [s["params"]["new_column"] for s in session.steps] == ["50", "51"]
    assert session.switch_sheet("Feb").count() == 2 and session.steps == []
    with pytest.raises(SheetNotFound):
        session.switch_sheet("Mar")
    whole, newest = recipes.StepLog(), recipes.StepLog(limit=20)
    for i in range(60):
        whole.record("if", {"i": i})
        newest.record("if", {"i": i})
    assert [s["params"]["i"] for s in whole.steps] == list(range(60))
    assert [s["params"]["i"] for s in newest.steps] == list(range(40, 60))


def test_recipe(sheet):
    df = sheet("Name string, Score long", [(" Mona  Lind", 3), ("Otto", 8)])
    steps = [
        {"action": "quick_fix", "params": {"fix_id": "trim_spaces"}},
        {"action": "if", "params": {"column": "Score", "op": "<", "value": 5, "true_value": "low",
                                    "false_value": "high", "new_column": "Level"}},
    ]
    replay = recipes.apply_recipe(df, steps)
    assert rows(replay.df) == [("Mona Lind", 3, "low"), ("Otto", 8, "high")]
    assert len(replay.applied) == 2 and replay.skipped == []
    assert recipes.apply_recipe(df, []).df is df


def test_recipe_skips_and_continues(sheet):
    df, lookup = sheet("Key long", [1, 2]), sheet("Key long, Value string", [(1, "x")])
    look = {"action": "vlookup", "params": {"key_column": "Key", "lookup_key_column": "Key", "value_columns": ["Value"]}}
    steps = [
        {"action": "not_a_real_action", "params": {}},
        {"action": "rank", "params": {"column": "DoesNotExist", "new_column": "R"}},
        {"action": "concatenate", "params": {}},
        {"action": "quick_fix", "params": {"fix_id": "nope"}},
        look,
        {"action": "serial_number", "params": {"new_column": "Sr No", "start": 1}},
    ]
    replay = recipes.apply_recipe(df, steps)
    assert [s["step"] for s in replay.skipped] == [1, 2, 3, 4, 5]
    assert "lookup" in replay.skipped[-1]["reason"]
    assert values(replay.df, "Sr No") == [1, 2]
    assert values(recipes.apply_recipe(df, [look], lookup).df, "Value") == ["x", None]


def test_recipe_pivot_then_rank(sales):
    steps = [
        {"action": "pivot", "params": {"index_cols": ["Port"], "values_col": "Tons"}},
        {"action": "rank", "params": {"column": "Tons", "new_column": "R"}},
    ]
    assert rows(recipes.apply_recipe(sales, steps).df) == [("Aden", 44, 1.0), ("Bergen", 19, 2.0)]


def test_recipe_json(spark, tmp_path):
    steps = [{"action": "rank", "params": {"column": "A", "new_column": "R"}}]
    recipes.save_recipe(spark, str(tmp_path / "r"), "monthly", steps)
    loaded = recipes.load_recipe(spark, str(tmp_path / "r"))
    assert loaded["name"] == "monthly" and loaded["steps"] == steps
    assert recipes.recipe_frame(spark, loaded).first()["label"] == "RANK"
    for name, bad in [(" ", steps), ("x", [])]:
        with pytest.raises(ValueError):
            recipes.save_recipe(spark, str(tmp_path / "r2"), name, bad)


def test_stream(spark, tmp_path):
    data = [(i, "a", f"2024-01-01 00:00:{i:02d}", f" n{i}! ") for i in range(6)] + [(6, "b", "2024-01-01 00:00:01", "x")]
    df = spark.createDataFrame(data, "event_id long, who string, ts string, note string")
    df = df.withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run_available(admit_stream(stream, ["who"], "ts", 5, 60), str(tmp_path / "out"), str(tmp_path / "c1"))
    out = spark.read.parquet(str(tmp_path / "out"))
    counts = {(r["who"], r["allowed"]): r["count"] for r in out.groupBy("who", "allowed").count().collect()}
    assert counts == {("a", True): 5, ("a", False): 1, ("b", True): 1}
    cleaned = apply_fixes(stream, ["trim_spaces", "remove_special_chars"])
    run_available(cleaned, str(tmp_path / "clean"), str(tmp_path / "c2"))
    assert {r["note"] for r in spark.read.parquet(str(tmp_path / "clean")).collect()} == {*(f"n{i}" for i in range(6)), "x"}
    with pytest.raises(ValueError):
        apply_fixes(stream, ["clean_currency"])


def test_stream_keeps_counting_over_batches(spark, tmp_path):
    schema = "event_id long, who string, ts timestamp"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for batch in range(3):
        df = spark.createDataFrame([(batch * 10 + i, "a") for i in range(3)], "event_id long, who string")
        df = df.withColumn("ts", F.lit("2024-01-01 00:00:05").cast("timestamp"))
        df.write.mode("append").parquet(str(tmp_path / "in"))
        run_available(admit_stream(stream, ["who"], "ts", 5, 60), str(tmp_path / "out"), str(tmp_path / "c"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 9 and out.where("allowed").count() == 5
