"""Row identity, and range buckets for order-dependent operators.

Spark tables have no row order, so a sheet carries ``_row_id``: unique, ordered
like the source rows, gaps allowed.  Operators that need a global order (rank,
serial number, forward fill, ...) never use an unpartitioned window; they cut
the order into range buckets of about equal size, work inside each bucket, and
combine one small row per bucket.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetloom.session import shuffle_partitions

ROW_ID = "_row_id"
BUCKET = "__bucket"
MAX_BUCKETS = 20_000
ROWS_PER_BUCKET = 1_000_000
SAMPLE_PER_BUCKET = 200


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """A column by its exact header (headers may hold dots and spaces)."""
    return F.col(quoted(name))


def data_columns(df: DataFrame) -> list[str]:
    """The sheet's own columns, without the hidden row id."""
    return [c for c in df.columns if c != ROW_ID]


def field_type(df: DataFrame, name: str) -> T.DataType:
    return next(f.dataType for f in df.schema.fields if f.name == name)


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(field_type(df, name), T.StringType)


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(field_type(df, name), (T.NumericType, T.BooleanType))


def is_fractional(df: DataFrame, name: str) -> bool:
    return isinstance(field_type(df, name), (T.DoubleType, T.FloatType))


def text_columns(df: DataFrame) -> list[str]:
    return [c for c in data_columns(df) if is_text(df, c)]


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"column(s) not found: {', '.join(map(str, missing))}")


def require_row_id(df: DataFrame) -> None:
    if ROW_ID not in df.columns:
        raise ValueError(f"this operator depends on row order; add {ROW_ID} with with_row_id()")


def with_row_id(df: DataFrame, order_by: str | None = None) -> DataFrame:
    """Attach ``_row_id``.

    ``order_by`` names a unique integer key whose order is the row order.
    Without it the physical order of the input is used; write the result to a
    table before filtering rows by id, so that a later run sees the same ids.
    """
    if order_by is None:
        return df.withColumn(ROW_ID, F.monotonically_increasing_id())
    require_columns(df, order_by)
    return df.withColumn(ROW_ID, col(order_by).cast("long"))


def denan(df: DataFrame) -> DataFrame:
    """NaN means "blank" in a sheet: turn it into NULL once, at load."""
    fractional = {c: F.nanvl(col(c), F.lit(None)) for c in df.columns if is_fractional(df, c)}
    return df.withColumns(fractional) if fractional else df


# --------------------------------------------------------------------------
# range buckets
# --------------------------------------------------------------------------


def bucket_count(df: DataFrame) -> int:
    """Buckets follow the session's shuffle parallelism, and stay bounded."""
    return max(2, min(MAX_BUCKETS, 4 * shuffle_partitions(df.sparkSession)))


def buckets_for(df: DataFrame, rows: int) -> int:
    """At least :func:`bucket_count`, more where a bucket would hold over ``ROWS_PER_BUCKET`` rows."""
    return max(bucket_count(df), min(MAX_BUCKETS, rows // ROWS_PER_BUCKET + 1))


def bucket_bounds(df: DataFrame, value: Column, buckets: int | None = None) -> tuple[int, list[float]]:
    """(non-null count, ascending distinct cut points).

    The cut points come from a sample of bounded size: they decide how even
    the buckets are, never the result, and a sketch of every row would be a
    heavy thing to merge from very many tasks.
    """
    source = df.select(value.cast("double").alias("v"))
    count = source.agg(F.count("v")).first()[0]
    n = buckets or buckets_for(df, count)
    share = SAMPLE_PER_BUCKET * n / max(count, 1)
    if share < 1:
        source = source.where("v IS NOT NULL").sample(fraction=share, seed=17)
    cuts = source.agg(F.percentile_approx("v", [i / n for i in range(1, n)], 10 * n)).first()[0]
    return count, sorted(set(cuts or []))


def add_bucket(df: DataFrame, value: Column, bounds: list[float]) -> DataFrame:
    """Add ``__bucket``: how many cut points are <= value (null for null)."""
    source = "__bucket_source"
    out = df.withColumn(source, value.cast("double"))
    if not bounds:
        return out.withColumn(BUCKET, F.when(F.col(source).isNotNull(), F.lit(0))).drop(source)
    cut = Bucketizer(
        splits=[float("-inf"), *bounds, float("inf")],
        inputCol=source,
        outputCol=BUCKET,
        handleInvalid="keep",
    )
    return cut.transform(out).withColumn(BUCKET, F.col(BUCKET).cast("int")).drop(source)


def running_before(order: Column) -> "Window":
    """Everything before the current row of a one-row-per-bucket table."""
    return Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
