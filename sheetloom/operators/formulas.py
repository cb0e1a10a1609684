"""Row-wise formulas: IF, CONCATENATE, LEFT / RIGHT / MID / LEN."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetloom.functions.cells import as_text
from sheetloom.functions.conditions import condition
from sheetloom.rows import require_columns


def if_column(
    df: DataFrame,
    column: str,
    op: str,
    value: Any,
    true_value: Any,
    false_value: Any,
    new_column: str,
    numeric: bool | None = None,
) -> DataFrame:
    """``new_column = true_value if (column op value) else false_value``.

    Two results of different types meet as text.
    """
    if not new_column.strip():
        raise ValueError("the new column needs a name")
    meets = condition(df, column, op, value, numeric=numeric)
    number = (int, float)
    mixed = {bool, str} & {type(true_value), type(false_value)} and type(true_value) is not type(false_value)
    if mixed or not all(isinstance(v, (*number, str, type(None))) for v in (true_value, false_value)):
        true_value, false_value = (None if v is None else str(v) for v in (true_value, false_value))
    return df.withColumn(new_column, F.when(meets, F.lit(true_value)).otherwise(F.lit(false_value)))


def concatenate(df: DataFrame, columns: list[str], separator: str, new_column: str) -> DataFrame:
    """Join the cells of two or more columns as text; a blank is ``""``."""
    require_columns(df, *columns)
    if len(columns) < 2:
        raise ValueError("CONCATENATE needs at least two columns")
    parts = [F.coalesce(as_text(df, c), F.lit("")) for c in columns]
    return df.withColumn(new_column, F.concat_ws(separator, *parts))


def text_extract(
    df: DataFrame,
    column: str,
    mode: str,
    new_column: str,
    n: int | None = None,
    start: int | None = None,
    length: int | None = None,
) -> DataFrame:
    """LEFT(n), RIGHT(n), MID(start, length) with 0-based start, or LEN."""
    require_columns(df, column)
    text = as_text(df, column)
    mode = mode.lower()
    if mode in ("left", "right"):
        if not n or n < 1:
            raise ValueError(f"{mode.upper()} needs a positive n")
        part = F.left(text, F.lit(n)) if mode == "left" else F.right(text, F.lit(n))
    elif mode == "mid":
        if start is None or start < 0 or not length or length < 1:
            raise ValueError("MID needs a start of 0 or more and a positive length")
        part = F.substring(text, start + 1, length)
    elif mode == "len":
        part = F.length(text)
    else:
        raise ValueError(f"mode {mode!r} is not supported; use left, right, mid or len")
    return df.withColumn(new_column, part)
