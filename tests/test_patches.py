import pytest
from conftest import rows
from pyspark.sql import functions as F

from sheetloom.operators import versions
from sheetloom.plans import sheet_session
from sheetloom.plans.sheet_session import SheetSession
from sheetloom.rows import ROW_ID, col

ORES = [("tin", 4, "a"), ("zinc", None, "b"), (None, 9, "c"), ("lead", 1, None)]


@pytest.fixture
def session(spark, sheet):
    return SheetSession.create(spark, sheet("Ore string, Tons long, Pit string", ORES))


def written(session):
    return [session._table(v).columns for v in range(session._state["next"])]


def test_a_change_of_one_column_writes_one_column(session):
    session.update(session.working.withColumn("Tons", F.coalesce("Tons", F.lit(0))), changed=["Tons"])
    session.update(session.working.withColumn("Rich", F.col("Tons") > 3), changed=[])
    session.update(session.working.where("Ore is not null").drop("Pit"), changed=[])
    assert written(session) == [[ROW_ID, "Ore", "Tons", "Pit"], [ROW_ID, "Tons"], [ROW_ID, "Rich"], [ROW_ID]]
    assert session.working.columns == [ROW_ID, "Ore", "Tons", "Rich"]
    assert rows(session.working) == [("tin", 4, True), ("zinc", 0, False), ("lead", 1, False)]
    again = SheetSession.open(session.spark, session.root)
    assert rows(again.undo()) == [("tin", 4, "a", True), ("zinc", 0, "b", False), (None, 9, "c", True), ("lead", 1, None, False)]
    assert rows(again.undo())[1] == ("zinc", 0, "b") and rows(again.undo()) == ORES
    assert rows(again.redo())[1] == ("zinc", 0, "b")
    assert len(written(again)) == 4  # undo and redo write nothing


def test_new_types_new_rows_and_whole_changes(session):
    session.update(session.working.withColumn("Tons", F.col("Tons").cast("string")), changed=[])
    assert written(session)[-1] == [ROW_ID, "Tons"] and rows(session.working)[0] == ("tin", "4", "a")
    more = session.working.unionByName(session.working.withColumn(ROW_ID, col(ROW_ID) + 10))
    session.update(more, changed=[])
    assert written(session)[-1] == [ROW_ID, "Ore", "Tons", "Pit"] and session.working.count() == 8
    every = session.working.select(ROW_ID, *[F.upper(c).alias(c) for c in ("Ore", "Tons", "Pit")])
    session.update(every, changed=["Ore", "Tons", "Pit"])
    assert rows(session.working)[5] == ("ZINC", None, "B")
    session.update(session.working.limit(0), changed=[])
    assert rows(session.working) == [] and session.working.columns == [ROW_ID, "Ore", "Tons", "Pit"]
    with pytest.raises(ValueError):
        session.update(session.working, changed=["Depth"])


def test_patches_are_folded_and_bases_outlive_a_vacuum(session, monkeypatch):
    monkeypatch.setattr(sheet_session, "FOLD", 2)
    session.retention = 1
    for n in range(1, 6):
        session.update(session.working.withColumn("Tons", F.lit(n).cast("long")), changed=["Tons"])
    whole = [c == [ROW_ID, "Ore", "Tons", "Pit"] for c in written(session)]
    assert whole == [True, False, False, True, False, False]
    assert session.vacuum() == [1, 2]  # 3 is whole and bears 4 and 5; 0 is the original
    assert {r[1] for r in rows(session.working)} == {5} and {r[1] for r in rows(session.undo())} == {4}


def test_changed_columns(session):
    before = session.working
    after = before.withColumn("Pit", F.coalesce("Pit", F.lit("z"))).withColumn("Note", F.lit(None).cast("string")).where("Tons > 0")
    assert versions.changed_columns(before, after) == ["Pit", "Note"]
    assert versions.changed_columns(before, before) == []
