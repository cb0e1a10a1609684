"""Pivot tables, with and without a columns field.

Headers beyond what a table can have as columns are a table of their own:
:func:`pivot_headers` numbers them, :func:`pivot_long` has a row per header,
:func:`pivot_page` spreads one run of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetloom.functions.cells import to_number
from sheetloom.operators.medians import grouped_median
from sheetloom.operators.ordered import serial_number
from sheetloom.rows import ROW_ID, col, field_type, quoted, require_columns
from sheetloom.session import materialize

FUNCTIONS = ("sum", "mean", "count", "min", "max", "median", "nunique")
# Groups whose result is null (no value at all) vanish for these.
NULLABLE = ("mean", "min", "max", "median")


def _aggregate(df: DataFrame, values_col: str, agg_func: str):
    counted = isinstance(field_type(df, values_col), T.NumericType)
    number = col(values_col) if counted else to_number(df, values_col)
    return {
        "sum": lambda: F.coalesce(F.sum(number), F.lit(0)),
        "mean": lambda: F.avg(number),
        "count": lambda: F.count(col(values_col)),
        "min": lambda: F.min(col(values_col)),
        "max": lambda: F.max(col(values_col)),
        "nunique": lambda: F.count_distinct(col(values_col)),
    }[agg_func]()


def pivot_table(
    df: DataFrame,
    index_cols: list[str],
    values_col: str,
    agg_func: str = "sum",
    columns_col: str | None = None,
) -> DataFrame:
    """Group by ``index_cols``; spread over the values of ``columns_col`` if given.

    Rows with a null key are dropped, groups without a result vanish, missing
    combinations become 0, rows and headers are sorted.
    """
    index_cols = list(index_cols)
    keys = index_cols + ([columns_col] if columns_col else [])
    rows, agg_func = _useful_rows(df, keys, values_col, agg_func)
    if columns_col is None:
        return _grouped(rows, index_cols, values_col, agg_func).orderBy(*[col(k) for k in index_cols])
    return _wide(rows, index_cols, values_col, agg_func, columns_col, _headers(rows, columns_col))


def _useful_rows(df: DataFrame, keys: list[str], values_col: str, agg_func: str) -> tuple[DataFrame, str]:
    """(rows that take part, the function's own name)."""
    if not keys:
        raise ValueError("a pivot table needs at least one index column")
    agg_func = agg_func.lower()
    if agg_func not in FUNCTIONS:
        raise ValueError(f"{agg_func!r} is not supported; use one of {', '.join(FUNCTIONS)}")
    require_columns(df, *keys, values_col)
    rows = df
    for k in keys:
        rows = rows.where(col(k).isNotNull())
    if agg_func in NULLABLE:
        # groups of nothing but blanks have no result, and would be dropped later
        useful = to_number(df, values_col) if agg_func in ("mean", "median") else col(values_col)
        rows = rows.where(useful.isNotNull())
    return rows, agg_func


def _wide(
    rows: DataFrame, index_cols: list[str], values_col: str, agg_func: str, columns_col: str, headers: list
) -> DataFrame:
    order = [col(k) for k in index_cols]
    if agg_func == "median":
        long = grouped_median(rows, [*index_cols, columns_col], to_number(rows, values_col), "__m")
        wide = long.groupBy(*order).pivot(quoted(columns_col), headers).agg(F.first("__m"))
    else:
        wide = rows.groupBy(*order).pivot(quoted(columns_col), headers).agg(_aggregate(rows, values_col, agg_func))
    names = [str(h) for h in headers]
    wide = wide.toDF(*index_cols, *names)
    types = {f.name: f.dataType for f in wide.schema.fields}
    filled = [F.coalesce(col(n), F.lit(0).cast(types[n])).alias(n) for n in names]
    return wide.select(*order, *filled).orderBy(*order)


def pivot_headers(df: DataFrame, columns_col: str) -> DataFrame:
    """The headers a pivot would have ``(header, position)``, in order from 1; any number of them.

    They are sorted into ranges and numbered by range counts, so no task and
    no driver holds the list.  Nulls are no header.
    """
    require_columns(df, columns_col)
    found = df.where(col(columns_col).isNotNull()).select(col(columns_col).alias("header")).distinct().orderBy("header")
    ranged = materialize(found.withColumn(ROW_ID, F.monotonically_increasing_id()), "headers")
    return serial_number(ranged, "position").select("header", F.col("position").cast("long").alias("position"))


def pivot_long(df: DataFrame, index_cols: list[str], values_col: str, agg_func: str, columns_col: str) -> DataFrame:
    """The pivot table with a row per index and header ``(*index_cols, header_position, header, value)``.

    No limit on headers.  Combinations without rows are absent, where the wide
    form has a 0; the rest is as in :func:`pivot_table`.
    """
    index_cols = list(index_cols)
    clash = {"header_position", "header", "value"} & set(index_cols)
    if clash or columns_col in index_cols:
        raise ValueError(f"these names are taken: {', '.join(sorted(clash) or [columns_col])}")
    rows, agg_func = _useful_rows(df, [*index_cols, columns_col], values_col, agg_func)
    name = values_col if values_col not in (*index_cols, columns_col) else f"{values_col}_{agg_func}"
    long = _grouped(rows, [*index_cols, columns_col], values_col, agg_func)
    numbered = pivot_headers(rows, columns_col).select(F.col("header").alias("__h"), F.col("position").alias("__p"))
    return long.join(numbered, col(columns_col) == F.col("__h")).select(
        *[col(k) for k in index_cols], F.col("__p").alias("header_position"), F.col("__h").alias("header"), col(name).alias("value")
    )


def pivot_page(
    df: DataFrame,
    index_cols: list[str],
    values_col: str,
    agg_func: str,
    columns_col: str,
    page: int = 0,
    page_size: int = 1_000,
) -> DataFrame:
    """The wide pivot table of one run of headers: ``page_size`` of them from number ``page * page_size + 1``.

    Index rows without any value on the page are left out; a page behind the
    last has no header and no row.
    """
    index_cols = list(index_cols)
    rows, agg_func = _useful_rows(df, [*index_cols, columns_col], values_col, agg_func)
    wanted = F.col("position").between(page * page_size + 1, (page + 1) * page_size)
    found = pivot_headers(rows, columns_col).where(wanted).orderBy("position").collect()  # at most page_size rows
    headers = [r["header"] for r in found]
    if not headers:
        return rows.select(*[col(k) for k in index_cols]).limit(0)
    on_page = rows.where(col(columns_col).between(headers[0], headers[-1]))
    return _wide(on_page, index_cols, values_col, agg_func, columns_col, headers)


def _grouped(rows: DataFrame, keys: list[str], values_col: str, agg_func: str) -> DataFrame:
    name = values_col if values_col not in keys else f"{values_col}_{agg_func}"
    if agg_func == "median":
        return grouped_median(rows, keys, to_number(rows, values_col), name)
    return rows.groupBy(*[col(k) for k in keys]).agg(_aggregate(rows, values_col, agg_func).alias(name))


def _headers(rows: DataFrame, columns_col: str) -> list:
    """Sorted header values; refused beyond Spark's own pivot limit."""
    limit = int(rows.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    found = rows.select(col(columns_col).alias("h")).distinct().orderBy("h").limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"{columns_col!r} has more than {limit} values, too many for pivot columns; use pivot_long or pivot_page")
    return [r["h"] for r in found]

