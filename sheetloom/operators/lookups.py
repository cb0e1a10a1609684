"""VLOOKUP, INDEX/MATCH and HLOOKUP as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetloom.functions.cells import as_text, text_to_number
from sheetloom.rows import ROW_ID, col, data_columns, field_type, require_columns, require_row_id


def _kind(dtype: T.DataType) -> str:
    if isinstance(dtype, (T.StringType, T.NullType)):
        return "text"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, T.NumericType):
        return "number"
    return dtype.simpleString()


def first_per_key(lookup_df: DataFrame, key: str, values: list[str]) -> DataFrame:
    """One lookup row per key, the first in row order, as ``__key, __v0, ...``.

    An aggregate, not a window: a frequent key is reduced inside each task
    before anything is shuffled.
    """
    row = F.struct(*[col(v).alias(f"__v{i}") for i, v in enumerate(values)], F.lit(True).alias("__hit"))
    grouped = lookup_df.groupBy(col(key).alias("__key")).agg(F.min_by(row, F.col(ROW_ID)).alias("__row"))
    return grouped.select("__key", "__row.*")


def vlookup(
    df: DataFrame,
    lookup_df: DataFrame,
    key_column: str,
    lookup_key_column: str,
    value_columns: list[str],
    how: str = "left",
) -> DataFrame:
    """Pull ``value_columns`` from the lookup table where the keys are equal.

    Null keys match null keys.  A value column that exists in the sheet gets
    the suffix ``_lookup``.  The join strategy is left to the planner, which
    knows the size of the lookup table; adaptive execution splits hot keys.
    """
    require_columns(df, key_column)
    require_columns(lookup_df, lookup_key_column, *value_columns)
    if how not in ("left", "inner"):
        raise ValueError("how must be 'left' or 'inner'")
    if _kind(field_type(df, key_column)) != _kind(field_type(lookup_df, lookup_key_column)):
        raise ValueError(f"keys {key_column!r} and {lookup_key_column!r} differ in type")
    require_row_id(lookup_df)
    table = first_per_key(lookup_df, lookup_key_column, value_columns)
    joined = df.join(table, col(key_column).eqNullSafe(F.col("__key")), how)
    taken = set(df.columns)
    pulled = []
    for i, name in enumerate(value_columns):
        out = f"{name}_lookup" if name in taken else name
        taken.add(out)
        pulled.append(F.col(f"__v{i}").alias(out))
    return joined.select(*[col(c) for c in df.columns], *pulled)


index_match = vlookup


def lookup_match_count(df: DataFrame, lookup_df: DataFrame, key_column: str, lookup_key_column: str) -> DataFrame:
    """One row (matched, total): how many sheet rows find their key."""
    keys = lookup_df.select(col(lookup_key_column).alias("__key")).distinct().withColumn("__hit", F.lit(1))
    joined = df.select(col(key_column).alias("__k")).join(keys, F.col("__k").eqNullSafe(F.col("__key")), "left")
    return joined.agg(F.count("__hit").alias("matched"), F.count("*").alias("total"))


def hlookup(
    df: DataFrame,
    lookup_df: DataFrame,
    key_column: str,
    lookup_key_row_index: int,
    value_row_index: int,
) -> DataFrame:
    """Lookup in a table whose keys run across a row.

    The two rows are turned into a (key, value) table with one row per lookup
    column, which is then looked up as usual; values are text.
    """
    require_columns(df, key_column)
    require_row_id(lookup_df)
    names = data_columns(lookup_df)
    if not names:
        raise ValueError("the lookup table has no columns")

    def as_column(index: int, label: str) -> DataFrame:
        if index < 0:
            raise ValueError(f"lookup row {index} is out of range")
        row = lookup_df.orderBy(ROW_ID).offset(index).limit(1)
        cells = F.array(*[as_text(lookup_df, c) for c in names])
        line = row.select(cells.alias("__cells")).first()  # one row, one cell per column
        if line is None:
            raise ValueError(f"lookup row {index} is out of range")
        data = list(enumerate(line["__cells"]))
        return lookup_df.sparkSession.createDataFrame(data, f"{ROW_ID} long, {label} string")

    keys = as_column(lookup_key_row_index, "__hkey")
    values = as_column(value_row_index, "__hvalue").withColumnRenamed(ROW_ID, "__pos")
    tall = keys.join(values, F.col(ROW_ID) == F.col("__pos")).drop("__pos")
    if _kind(field_type(df, key_column)) == "number":
        tall = tall.withColumn("__hkey", text_to_number(F.col("__hkey")))
        tall = tall.withColumn("__hkey", F.col("__hkey").try_cast(field_type(df, key_column)))
    elif _kind(field_type(df, key_column)) != "text":
        tall = tall.withColumn("__hkey", F.col("__hkey").try_cast(field_type(df, key_column)))
    found = vlookup(df, tall, key_column, "__hkey", ["__hvalue"])
    return found.withColumnRenamed("__hvalue", "Lookup Value")
