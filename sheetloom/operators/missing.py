"""Missing-value report and fills."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetloom.functions.cells import as_text, double_to_text, is_missing, round_half_even, text_to_number, to_number
from sheetloom.operators.medians import exact_medians
from sheetloom.operators.ordered import OrderIndex, directional_fill
from sheetloom.rows import col, data_columns, field_type, is_fractional, is_numeric, is_text

NUMERIC_TEXT_SHARE = 0.7
METHODS = ("mean", "median", "mode", "constant", "ffill", "bfill", "drop_rows")
STATISTICS = ("mean", "median", "mode", "constant")


def report_aggregates(df: DataFrame) -> list[Column]:
    """What the report needs from the table; one row whatever its size."""
    aggs: list[Column] = [F.count("*").alias("__rows")]
    for i, c in enumerate(data_columns(df)):
        aggs.append(F.count_if(is_missing(df, c)).alias(f"__m{i}"))
        if is_text(df, c):
            aggs.append(F.count(text_to_number(col(c))).alias(f"__n{i}"))
    return aggs


def report_lines(df: DataFrame) -> Column:
    """The report as an array of structs over :func:`report_aggregates`."""
    rows = F.col("__rows")
    lines = []
    for i, c in enumerate(data_columns(df)):
        missing = F.col(f"__m{i}")
        if is_text(df, c):
            numeric = F.coalesce(F.try_divide(F.col(f"__n{i}"), rows) > NUMERIC_TEXT_SHARE, F.lit(False))
        else:
            numeric = F.lit(is_numeric(df, c))
        pct = F.when(rows > 0, round_half_even(F.try_divide(missing, rows) * 100, 1)).otherwise(0.0)
        lines.append(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(c).alias("column"),
                F.lit(field_type(df, c).simpleString()).alias("dtype"),
                numeric.alias("is_numeric"),
                missing.alias("missing_count"),
                pct.alias("missing_pct"),
                F.when(missing == 0, None).when(numeric, "median").otherwise("mode").alias("suggested_method"),
            )
        )
    if not lines:
        raise ValueError("the table has no columns")
    return F.array(*lines)


def missing_report(df: DataFrame) -> DataFrame:
    """One row per column, most missing first, with a suggested fill method.

    One aggregate over the table; only its single row is unpivoted.
    """
    report = df.agg(*report_aggregates(df)).select(F.inline(report_lines(df)))
    return report.orderBy(F.col("missing_count").desc(), "position")


def missing_totals(df: DataFrame) -> DataFrame:
    """One row (total_rows, total_missing_cells)."""
    cells = [F.count_if(is_missing(df, c)) for c in data_columns(df)]
    return df.agg(F.count("*").alias("total_rows"), sum(cells, F.lit(0)).alias("total_missing_cells"))


def top_missing(df: DataFrame, n: int = 10) -> DataFrame:
    """The n columns with the most missing cells, complete columns left out."""
    report = missing_report(df).where(F.col("missing_count") > 0)
    return report.orderBy(F.col("missing_count").desc(), "position").limit(n)


def fill_missing(df: DataFrame, strategies: dict[str, dict[str, Any]], index: OrderIndex | None = None) -> DataFrame:
    """Apply ``{column: {"method": ..., "value": ...}}`` in the given order.

    Unknown columns and methods are ignored.  Neighbouring steps of one kind
    share their work: statistics one job, directional fills one shuffle.  An
    ``index`` of the row order serves the fills up to the first dropped row.
    """
    steps = [
        (c, spec["method"], spec.get("value", ""))
        for c, spec in strategies.items()
        if c in df.columns and (spec or {}).get("method") in METHODS
    ]
    i = 0
    while i < len(steps):
        kind = _kind(steps[i][1])
        j = i
        while j < len(steps) and _kind(steps[j][1]) == kind:
            j += 1
        batch = steps[i:j]
        if kind == "statistic":
            df = _fill_statistics(df, batch)
        elif kind == "direction":
            down = [c for c, m, _ in batch if m == "ffill"]
            up = [c for c, m, _ in batch if m == "bfill"]
            df = directional_fill(df, down, up, index)
        else:
            df, index = OrderIndex.plain(df), None
            for c, _, _ in batch:
                df = df.where(~is_missing(df, c))
        i = j
    return df


def _kind(method: str) -> str:
    if method in STATISTICS:
        return "statistic"
    return "rows" if method == "drop_rows" else "direction"


def column_mode(df: DataFrame, name: str) -> Any:
    """The most frequent non-missing value, the smallest of equals.

    A plain grouped count, so frequent and numerous values both stay
    distributed; only the winning row reaches the driver.
    """
    counts = df.where(~is_missing(df, name)).groupBy(col(name).alias("v")).agg(F.count("*").alias("n"))
    row = counts.orderBy(F.col("n").desc(), "v").first()
    return None if row is None else row["v"]


def _fill_statistics(df: DataFrame, batch: list[tuple[str, str, Any]]) -> DataFrame:
    medians = {c: to_number(df, c) for c, m, _ in batch if m == "median"}
    extra = {f"missing{i}": F.count_if(is_missing(df, c)) for i, (c, _, _) in enumerate(batch)}
    extra |= {f"mean{i}": F.avg(to_number(df, c)) for i, (c, m, _) in enumerate(batch) if m == "mean"}
    median_of, found = exact_medians(df, medians, extra)
    cells = {}
    for i, (c, method, value) in enumerate(batch):
        if not found[f"missing{i}"]:
            continue
        if method == "mean":
            value = found[f"mean{i}"]
        elif method == "median":
            value = median_of[c][1]
        elif method == "mode":
            value = column_mode(df, c)
            value = "" if value is None else value
        if value is None:
            continue
        cells[c] = _filled(df, c, value)
    return df.withColumns(cells) if cells else df


def _filled(df: DataFrame, name: str, value: Any) -> Column:
    """The column with ``value`` in its blanks; the type widens only if it must."""
    blank = is_missing(df, name)
    is_number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if is_text(df, name):
        filler = double_to_text(F.lit(value)) if isinstance(value, float) else F.lit(str(value))
        return F.when(blank, filler).otherwise(col(name))
    if is_numeric(df, name) and is_number:
        if isinstance(value, float) and not is_fractional(df, name):
            return F.when(blank, F.lit(value)).otherwise(col(name).cast("double"))
        return F.when(blank, F.lit(value).cast(field_type(df, name))).otherwise(col(name))
    if isinstance(value, str) or is_number:
        return F.when(blank, F.lit(str(value))).otherwise(as_text(df, name))
    return F.when(blank, F.lit(value)).otherwise(col(name))
