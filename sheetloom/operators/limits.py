"""Fixed-window rate limits over an event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetloom.rows import col, field_type, require_columns


def window_start(df: DataFrame, ts: str, seconds: int) -> Column:
    """Start of the fixed window, in seconds since the epoch.

    A timestamp without a zone counts from the epoch's own wall clock, whatever the session's zone.
    """
    at = col(ts)
    if isinstance(field_type(df, ts), T.TimestampNTZType):
        whole = F.unix_date(at.cast("date")).cast("long") * 86_400 + F.hour(at) * 3_600 + F.minute(at) * 60 + F.second(at)
    else:
        whole = F.floor(F.unix_micros(at.cast("timestamp")) / F.lit(1_000_000))
    return (F.floor(whole / F.lit(seconds)) * seconds).cast("long")


def event_time(df: DataFrame, ts: str) -> Column:
    """The event's instant, on the clock that :func:`window_start` counts by."""
    at = col(ts)
    if not isinstance(field_type(df, ts), T.TimestampNTZType):
        return at.cast("timestamp")
    second = F.extract(F.lit("SECOND"), at)
    return F.make_timestamp(F.year(at), F.month(at), F.dayofmonth(at), F.hour(at), F.minute(at), second, F.lit("UTC"))


def _window(df: DataFrame, ts: str, seconds: int) -> DataFrame:
    return df.withColumn("window_start", window_start(df, ts, seconds))


def admitted(
    df: DataFrame, keys: list[str], ts: str, event_id: str, max_requests: int, window_seconds: int
) -> DataFrame:
    """The events that pass: the first ``max_requests`` of every key and window.

    The row-number limit is applied in each task before the shuffle, so even
    a key with most of the events sends only a few rows per task.
    """
    require_columns(df, *keys, ts, event_id)
    group = Window.partitionBy(*[col(k) for k in keys], "window_start").orderBy(col(ts), col(event_id))
    numbered = _window(df, ts, window_seconds).withColumn("__nth", F.row_number().over(group))
    return numbered.where(F.col("__nth") <= max_requests).drop("__nth")


def rate_limit(
    df: DataFrame, keys: list[str], ts: str, event_id: str, max_requests: int, window_seconds: int
) -> DataFrame:
    """Every event with ``window_start`` and ``allowed``.

    Windows over the limit are found by their last admitted event; all events
    are then compared with it.  No task orders a whole group.
    """
    last = admitted(df, keys, ts, event_id, max_requests, window_seconds)
    names = {k: f"__k{i}" for i, k in enumerate(keys)}
    edge = (
        last.groupBy(*[col(k).alias(n) for k, n in names.items()], F.col("window_start").alias("__w"))
        .agg(F.count("*").alias("__n"), F.max(F.struct(col(ts).alias("t"), col(event_id).alias("e"))).alias("__last"))
        .where(F.col("__n") == max_requests)
        .drop("__n")
    )
    events = _window(df, ts, window_seconds)
    same = F.col("window_start") == F.col("__w")
    for k, n in names.items():
        same = same & col(k).eqNullSafe(F.col(n))
    position = F.struct(col(ts).alias("t"), col(event_id).alias("e"))
    allowed = F.coalesce(position <= F.col("__last"), F.lit(True))
    return events.join(edge, same, "left").select(
        *[col(c) for c in df.columns], "window_start", allowed.alias("allowed")
    )


def window_usage(df: DataFrame, keys: list[str], ts: str, max_requests: int, window_seconds: int) -> DataFrame:
    """Per key and window: events, how many pass, how many are refused."""
    counts = _window(df, ts, window_seconds).groupBy(*[col(k) for k in keys], "window_start").agg(
        F.count("*").alias("events")
    )
    passed = F.least(F.col("events"), F.lit(max_requests).cast("long"))
    return counts.withColumn("allowed", passed).withColumn("refused", F.col("events") - passed)
