"""SUM / AVERAGE / COUNT / COUNTA / MIN / MAX / MEDIAN and the *IF forms."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetloom.functions.cells import to_number
from sheetloom.functions.conditions import condition
from sheetloom.operators.medians import exact_medians
from sheetloom.rows import col, require_columns

FUNCTIONS = ("sum", "average", "count", "counta", "min", "max", "median", "countif", "sumif", "averageif")
CONDITIONAL = ("countif", "sumif", "averageif")


def aggregate(
    df: DataFrame,
    column: str,
    func: str,
    condition_column: str | None = None,
    condition_op: str | None = None,
    condition_value: Any = None,
) -> DataFrame:
    """A one-row table with the column ``result``.

    Only cells that are numbers count, except for COUNTA (non-null cells) and
    COUNTIF (rows that meet the condition).  With no numbers the result is 0.
    """
    func = func.lower()
    if func not in FUNCTIONS:
        raise ValueError(f"{func!r} is not supported; use one of {', '.join(FUNCTIONS)}")
    require_columns(df, column)
    number = to_number(df, column)
    meets = None
    if func in CONDITIONAL:
        if not condition_column or not condition_op or condition_value is None or str(condition_value) == "":
            raise ValueError(f"{func!r} needs a condition column, operator and value")
        meets = condition(df, condition_column, condition_op, condition_value)

    if func == "median":
        stats, _ = exact_medians(df, {"m": number})
        value = stats["m"][1]
        return df.sparkSession.range(1).select(F.lit(0.0 if value is None else value).alias("result"))
    zero = F.lit(0.0)
    result = {
        "sum": lambda: F.coalesce(F.sum(number), zero),
        "average": lambda: F.coalesce(F.avg(number), zero),
        "count": lambda: F.count(number),
        "counta": lambda: F.count(col(column)),
        "min": lambda: F.coalesce(F.min(number), zero),
        "max": lambda: F.coalesce(F.max(number), zero),
        "countif": lambda: F.count_if(meets),
        "sumif": lambda: F.coalesce(F.sum(F.when(meets, number)), zero),
        "averageif": lambda: F.coalesce(F.avg(F.when(meets, number)), zero),
    }[func]()
    return df.agg(result.alias("result"))


def aggregate_value(df: DataFrame, column: str, func: str, **condition_args: Any) -> float | int:
    """The same as a Python number (runs the query)."""
    return aggregate(df, column, func, **condition_args).first()["result"]
