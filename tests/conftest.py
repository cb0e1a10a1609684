import pytest

from sheetloom import get_session
from sheetloom.rows import ROW_ID


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_session(
        "tests",
        **{
            "spark.master": "local[4]",
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sheet(spark):
    """``sheet("Name string, Age long", rows)``: a table with row ids 0, 1, 2, ..."""

    def make(schema, rows):
        rows = [r if isinstance(r, tuple) else (r,) for r in rows]
        return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"{ROW_ID} long, {schema}")

    return make


@pytest.fixture(scope="session")
def messy(sheet):
    return sheet(
        "Tool string, Weight long, Shelf string",
        [
            ("Hammer", 5, "A1"), (" hammer", 5, "a1"), ("Saw", None, "B2"), ("Torque wrench", 12, "C3"), (None, 7, None),
            ("Saw", None, "B2"), ("Level", 3, "   "), ("Clamp", 70, "K9"), ("Vice", 71, "D4"), ("Hammer", 5, "A1"),
        ],
    )


@pytest.fixture(scope="session")
def sales(sheet):
    return sheet(
        "Port string, Cargo string, Tons long",
        [("Bergen", "ore", 7), ("Aden", "oil", 31), ("Bergen", "oil", 12), ("Aden", "ore", 4), ("Aden", "oil", 9)],
    )


def values(df, column):
    """One column in row order."""
    return [r[column] for r in df.orderBy(ROW_ID).collect()]


def rows(df):
    """All rows in row order, without the id."""
    names = [c for c in df.columns if c != ROW_ID]
    return [tuple(r[c] for c in names) for r in df.orderBy(ROW_ID).collect()]
