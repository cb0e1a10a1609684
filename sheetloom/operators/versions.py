"""What differs between two versions of a table, cell by cell.

Rows are matched by ``_row_id``.  Only digests of the cells travel to find the
differences, so wide texts are shuffled for the changed rows alone.  A cell
counts by its text, as a sheet shows it: ``7`` as a number and ``'7'`` as text
are the same cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetloom.rows import ROW_ID, col, data_columns, require_row_id


def _names(before: DataFrame, after: DataFrame) -> list[str]:
    require_row_id(before)
    require_row_id(after)
    return data_columns(before) + [c for c in data_columns(after) if c not in before.columns]


def _text(df: DataFrame, name: str) -> Column:
    return col(name).cast("string") if name in df.columns else F.lit(None).cast("string")


def _digests(df: DataFrame, names: list[str], tag: str) -> DataFrame:
    cells = []
    for i, name in enumerate(names):
        text = _text(df, name)
        digest = F.struct(F.xxhash64(text).alias("h"), F.crc32(F.encode(text, "UTF-8")).alias("c"))
        cells.append(F.when(text.isNotNull(), digest).alias(f"{tag}{i}"))
    return df.select(col(ROW_ID).alias(f"{tag}_id"), *cells)


def _matched(before: DataFrame, after: DataFrame, names: list[str], how: str) -> DataFrame:
    old, new = _digests(before, names, "old"), _digests(after, names, "new")
    return old.join(new, F.col("old_id") == F.col("new_id"), how)


def compare_versions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Counts ``(metric, column, n)``: one join and one aggregate, whatever the number of columns.

    Metrics of the table have a null column: ``rows_before``, ``rows_after``,
    ``rows_added``, ``rows_gone``, ``rows_changed``.  Per column, over the rows
    that both versions have: ``cells_filled`` (blank before), ``cells_cleared``
    (blank now) and ``cells_changed`` (another value).  A column of one version
    only is blank in the other.  Empty tables give zeros.
    """
    names = _names(before, after)
    both = F.col("old_id").isNotNull() & F.col("new_id").isNotNull()
    differs = F.lit(False)
    per_column = []
    for i, name in enumerate(names):
        old, new = F.col(f"old{i}"), F.col(f"new{i}")
        differs = differs | ~old.eqNullSafe(new)
        per_column += [
            ("cells_filled", name, both & old.isNull() & new.isNotNull()),
            ("cells_cleared", name, both & old.isNotNull() & new.isNull()),
            ("cells_changed", name, both & F.coalesce(old != new, F.lit(False))),
        ]
    metrics = [
        ("rows_before", None, F.col("old_id").isNotNull()),
        ("rows_after", None, F.col("new_id").isNotNull()),
        ("rows_added", None, F.col("old_id").isNull()),
        ("rows_gone", None, F.col("new_id").isNull()),
        ("rows_changed", None, both & differs),
        *per_column,
    ]
    counts = _matched(before, after, names, "full").agg(
        *[F.count_if(test).alias(f"n{i}") for i, (_, _, test) in enumerate(metrics)]
    )
    lines = [
        F.struct(F.lit(metric).alias("metric"), F.lit(name).cast("string").alias("column"), F.col(f"n{i}").alias("n"))
        for i, (metric, name, _) in enumerate(metrics)
    ]
    return counts.select(F.inline(F.array(*lines)))


def changed_columns(before: DataFrame, after: DataFrame) -> list[str]:
    """Columns of ``after`` with another value in any row that both have, or that ``before`` lacks."""
    counts = compare_versions(before, after).where(col("column").isNotNull() & (F.col("n") > 0))
    differing = {r["column"] for r in counts.select("column").distinct().collect()}
    return [c for c in data_columns(after) if c in differing or c not in before.columns]


def changed_cells(before: DataFrame, after: DataFrame) -> DataFrame:
    """Every differing cell of the rows in both versions ``(row_id, column, old_value, new_value)``, as text.

    Rows added or gone are not listed; :func:`compare_versions` counts them.
    """
    names = _names(before, after)
    schema = "row_id long, column string, old_value string, new_value string"
    if not names:
        return before.sparkSession.createDataFrame([], schema)
    differing = [
        F.when(~F.col(f"old{i}").eqNullSafe(F.col(f"new{i}")), F.lit(i)) for i in range(len(names))
    ]
    places = _matched(before, after, names, "inner").select(
        F.col("old_id").alias("id"), F.array_compact(F.array(*differing)).alias("at")
    )
    places = places.where(F.size("at") > 0)

    def cells(df: DataFrame, tag: str) -> DataFrame:
        texts = F.array(*[_text(df, n) for n in names])
        rows = df.select(col(ROW_ID).alias(f"{tag}_row"), texts.alias(tag))
        return rows

    wide = places.join(cells(before, "old"), F.col("id") == F.col("old_row")).join(
        cells(after, "new"), F.col("id") == F.col("new_row")
    )
    place = wide.select("id", "old", "new", F.explode("at").alias("i"))
    return place.select(
        F.col("id").alias("row_id"),
        F.element_at(F.array(*[F.lit(n) for n in names]), F.col("i") + 1).alias("column"),
        F.element_at("old", F.col("i") + 1).alias("old_value"),
        F.element_at("new", F.col("i") + 1).alias("new_value"),
    )
