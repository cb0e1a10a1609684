"""Exact duplicates, unique values, and removal of rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetloom.functions.cells import is_missing
from sheetloom.rows import ROW_ID, col, data_columns, require_columns, require_row_id


def remove_duplicates(df: DataFrame) -> DataFrame:
    """Keep the first of equal rows; blanks are equal to each other.

    A hash aggregate with map-side combine: copies of one row shrink to a
    single record per task before the shuffle.
    """
    require_row_id(df)
    columns = data_columns(df)
    first = df.groupBy(*[col(c) for c in columns]).agg(F.min(ROW_ID).alias(ROW_ID))
    return first.select(*[col(c) for c in df.columns])


def duplicate_count(df: DataFrame) -> DataFrame:
    """One row: how many rows repeat an earlier one."""
    groups = df.groupBy(*[col(c) for c in data_columns(df)]).agg(F.count("*").alias("__n"))
    return groups.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_rows"))


def unique_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-null values in order of first appearance, with that row's id."""
    require_columns(df, column)
    require_row_id(df)
    return (
        df.where(col(column).isNotNull())
        .groupBy(col(column))
        .agg(F.min(ROW_ID).alias(ROW_ID))
        .orderBy(ROW_ID)
    )


def drop_rows(df: DataFrame, rows: DataFrame | Iterable[int]) -> DataFrame:
    """Drop rows by id; ids that do not exist are ignored.

    ``rows`` may be a table with ``_row_id`` (a detector's output) of any size.
    """
    require_row_id(df)
    if not isinstance(rows, DataFrame):
        rows = df.sparkSession.createDataFrame([(int(i),) for i in rows], f"{ROW_ID} long")
    ids = rows.select(F.col(ROW_ID).alias("__drop"))
    return df.join(ids, F.col(ROW_ID) == F.col("__drop"), "left_anti")


def remove_empty_rows(df: DataFrame) -> DataFrame:
    """Drop rows in which every cell is blank."""
    columns = data_columns(df)
    if not columns:
        return df
    empty = is_missing(df, columns[0])
    for c in columns[1:]:
        empty = empty & is_missing(df, c)
    return df.where(~empty)


def drop_missing_rows(df: DataFrame, *columns: str) -> DataFrame:
    """Drop rows that are blank in any of the given columns."""
    require_columns(df, *columns)
    for c in columns:
        df = df.where(~is_missing(df, c))
    return df
