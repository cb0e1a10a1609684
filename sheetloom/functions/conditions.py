"""The eight comparison operators of IF, COUNTIF, SUMIF and AVERAGEIF."""

from __future__ import annotations

import operator
from typing import Any

from pyspark.errors import SparkRuntimeException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetloom.functions.cells import as_text, text_to_number, to_number
from sheetloom.rows import col, is_numeric, is_text, require_columns

COMPARISONS = {
    ">": operator.gt,
    "<": operator.lt,
    ">=": operator.ge,
    "<=": operator.le,
    "==": operator.eq,
    "!=": operator.ne,
}
OPERATORS = (*COMPARISONS, "contains", "not_contains")


def mostly_numbers(df: DataFrame, name: str) -> bool:
    """True if more than half of all rows parse as numbers (one scan)."""
    if is_numeric(df, name):
        return True
    if not is_text(df, name):
        return False
    share = df.agg(F.avg(F.when(text_to_number(col(name)).isNotNull(), 1.0).otherwise(0.0))).first()[0]
    return share is not None and share > 0.5


def _require_pattern(df: DataFrame, pattern: str) -> None:
    """A pattern that does not compile is a bad argument, found before any job."""
    try:
        df.sparkSession.range(1).select(F.lit("").rlike(f"(?i){pattern}")).collect()
    except SparkRuntimeException as error:
        raise ValueError(f"{pattern!r} is not a valid pattern") from error


def condition(df: DataFrame, name: str, op: str, value: Any, numeric: bool | None = None) -> Column:
    """A never-null BOOLEAN column for ``name op value``.

    A blank cell matches nothing, so the negated operators are true on it.
    ``numeric`` states how to compare a text column and saves the scan that
    would otherwise decide it.
    """
    require_columns(df, name)
    if op not in OPERATORS:
        raise ValueError(f"operator {op!r} is not supported; use one of {', '.join(OPERATORS)}")
    if op in ("contains", "not_contains"):
        _require_pattern(df, str(value))
        found = F.coalesce(as_text(df, name).rlike(f"(?i){value}"), F.lit(False))
        return ~found if op == "not_contains" else found
    on_null = F.lit(op == "!=")
    compare = COMPARISONS[op]
    if numeric if numeric is not None else mostly_numbers(df, name):
        try:
            number = float(value)
        except (TypeError, ValueError):
            if op in ("==", "!="):
                return on_null
            raise ValueError(f"{name!r} holds numbers and cannot be ordered against {value!r}") from None
        return F.coalesce(compare(to_number(df, name), F.lit(number)), on_null)
    return F.coalesce(compare(as_text(df, name), F.lit(str(value))), on_null)
