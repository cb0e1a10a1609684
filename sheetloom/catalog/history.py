"""What a session keeps beside its table: versions compared, lookup table, step log, own fixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetloom.catalog.inputs import MESSY_ORDERS, Query, derived, plain, table
from sheetloom.operators import fixes, versions
from sheetloom.operators.changes import rewrite
from sheetloom.operators.formulas import if_column
from sheetloom.operators.lookups import vlookup
from sheetloom.operators.missing import fill_missing
from sheetloom.plans.recipes import apply_recipe
from sheetloom.plans.sheet_session import SheetSession
from sheetloom.rows import ROW_ID, col, data_columns, text_columns

EDITS = {"status": {"method": "constant", "value": "none"}, "price": {"method": "drop_rows"}}


def _versions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Messy orders, and the same after fills, a formula, a fix and lost rows."""
    before = derived(spark, sf, MESSY_ORDERS, "o_orderkey")
    after = fill_missing(before, EDITS)
    after = if_column(after, "o_custkey", ">", 500, "late", "early", "Part")
    return before, fixes.apply_fix(after, "trim_spaces")


def version_counts(spark: SparkSession, sf: str) -> DataFrame:
    return versions.compare_versions(*_versions(spark, sf))


def version_cells(spark: SparkSession, sf: str) -> DataFrame:
    return versions.changed_cells(*_versions(spark, sf))


M = plain(MESSY_ORDERS)
EDITED = f"""
SELECT o_orderkey AS id, status AS s0, coalesce(status, 'none') AS s1, priority AS p0, trim(priority) AS p1,
       CASE WHEN o_custkey > 500 THEN 'late' ELSE 'early' END AS part, price IS NULL AS gone FROM ({M})
"""
CELLS = f"""
WITH e AS (SELECT * FROM ({EDITED}) WHERE NOT gone)
SELECT id AS row_id, 'status' AS "column", s0 AS old_value, s1 AS new_value FROM e WHERE s0 IS DISTINCT FROM s1
UNION ALL SELECT id, 'priority', p0, p1 FROM e WHERE p0 IS DISTINCT FROM p1
UNION ALL SELECT id, 'Part', NULL, part FROM e
"""
NAMES = ("o_orderkey", "o_custkey", "price", "priority", "status", "remark", "grade", "Part")


def _counts_sql() -> str:
    lines = [
        f"SELECT 'rows_before' AS metric, NULL AS \"column\", count(*) AS n FROM ({EDITED})",
        f"SELECT 'rows_after', NULL, count(*) FROM ({EDITED}) WHERE NOT gone",
        "SELECT 'rows_added', NULL, 0",
        f"SELECT 'rows_gone', NULL, count(*) FROM ({EDITED}) WHERE gone",
        "SELECT 'rows_changed', NULL, count(DISTINCT row_id) FROM cells",
    ]
    tests = {
        "cells_filled": "old_value IS NULL",
        "cells_cleared": "new_value IS NULL",
        "cells_changed": "old_value IS NOT NULL AND new_value IS NOT NULL",
    }
    for name in NAMES:
        lines += [f"SELECT '{m}', '{name}', count(*) FROM cells WHERE \"column\" = '{name}' AND {t}" for m, t in tests.items()]
    return f"WITH cells AS ({CELLS}) " + " UNION ALL ".join(lines)


def session_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """A lookup table kept in a session, found again when the session is reopened."""
    root = SheetSession.create(spark, table(spark, sf, "orders", "o_orderkey")).root
    SheetSession.open(spark, root).set_lookup(table(spark, sf, "customer", "c_custkey"))
    session = SheetSession.open(spark, root)
    found = vlookup(session.working, session.lookup, "o_custkey", "c_custkey", ["c_name", "c_mktsegment"])
    return found.select("o_orderkey", "c_name", "c_mktsegment")


def session_patches(spark: SparkSession, sf: str) -> DataFrame:
    """A fill, a fix, lost rows and a formula kept as patches; the last is undone, the others read again."""
    session = SheetSession.create(spark, derived(spark, sf, MESSY_ORDERS, "o_orderkey"))
    session.update(fill_missing(session.working, {"status": EDITS["status"]}), changed=["status"])
    trimmed = fixes.apply_fix(session.working, "trim_spaces")
    session.update(trimmed, changed=versions.changed_columns(session.working, trimmed))
    session.update(fill_missing(session.working, {"price": EDITS["price"]}), changed=[])
    session.update(if_column(session.working, "o_custkey", ">", 500, "late", "early", "Part"), changed=[])
    session.undo()
    session.redo()
    session.update(if_column(session.working, "o_custkey", ">", 900, "late", "early", "Part"), changed=["Part"])
    session.undo()
    return SheetSession.open(spark, session.root).working.select("o_orderkey", "status", "priority", "price", "Part")


LOGGED = [
    ("if", {"column": "price", "op": ">=", "value": 250000, "true_value": "Large", "false_value": "Small", "new_column": "Size"}),
    ("delete_rows", {"row_ids": [1, 2]}),
    ("concatenate", {"columns": ["status", "Size"], "separator": "/", "new_column": "Code"}),
    ("serial_number", {"new_column": "No", "start": 5}),
]


def session_steps(spark: SparkSession, sf: str) -> DataFrame:
    """The logged steps of a session, replayed on its original; edits by row position are not logged."""
    root = SheetSession.create(spark, derived(spark, sf, MESSY_ORDERS, "o_orderkey")).root
    for action, params in LOGGED:
        SheetSession.open(spark, root).log_step(action, params)
    session = SheetSession.open(spark, root)
    replay = apply_recipe(session.original, session.steps)
    return replay.df.select("o_orderkey", "Size", "Code", "No").withColumn("steps", F.lit(len(session.steps)))


def shout(df: DataFrame, log=None) -> DataFrame:
    """All text in capitals."""
    return rewrite(df, {c: F.upper(col(c)) for c in text_columns(df)}, log)


def registered_fix(spark: SparkSession, sf: str) -> DataFrame:
    """A fix of one's own, registered and applied by its id like a built-in one."""
    known = list(fixes.REGISTRY)
    try:
        fixes.register_fix("shout", "All text in capitals", ["shout", "upper case"], shout)
        shouted = fixes.apply_fix(table(spark, sf, "part", "p_partkey"), "shout")
    finally:
        fixes.REGISTRY[:] = known  # other queries list the built-in ones
    return shouted.select(*[col(c) for c in data_columns(shouted) if c != ROW_ID])


QUERIES = {
    "version_counts": Query(version_counts, _counts_sql()),
    "version_cells": Query(version_cells, CELLS),
    "session_lookup": Query(
        session_lookup,
        "SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
    ),
    "session_patches": Query(
        session_patches,
        f"""SELECT o_orderkey, coalesce(status, 'none') AS status, trim(priority) AS priority, price,
                   CASE WHEN o_custkey > 500 THEN 'late' ELSE 'early' END AS "Part" FROM ({M}) WHERE price IS NOT NULL""",
    ),
    "session_steps": Query(
        session_steps,
        f"""SELECT o_orderkey, "Size", coalesce(status, '') || '/' || "Size" AS "Code",
                   4 + row_number() OVER (ORDER BY o_orderkey) AS "No", 3 AS steps
            FROM (SELECT *, CASE WHEN price >= 250000 THEN 'Large' ELSE 'Small' END AS "Size" FROM ({M}))""",
    ),
    "registered_fix": Query(
        registered_fix,
        """SELECT p_partkey, upper(p_name) AS p_name, upper(p_brand) AS p_brand, upper(p_type) AS p_type, p_size,
                  p_retailprice FROM part""",
    ),
}
