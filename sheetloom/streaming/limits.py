"""Fixed-window rate limits on a stream of events.

Stateful operators hold many keys and windows in one state: a group of them is
one call of Python and one entry of the state store, however few events a key has.
"""

from __future__ import annotations

import pickle
from bisect import insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sheetloom.operators.limits import event_time, window_start
from sheetloom.rows import col, field_type, require_columns
from sheetloom.streaming.fixes import run_available

#: The parts into which a key's window is split, so that a hot key is in no single group.
SALTS = 16
#: The groups to which keys, windows and salts are dealt; as many tasks can work side by side.
GROUPS = 256
#: Marks bear this time; no event does.
END_OF_TIME = "9999-12-31 00:00:00"
#: The end of the window of events without a time.
NEVER = (1 << 63) - 1


def _cell_text(df: DataFrame, name: str) -> Column:
    """A key's cell as text that :func:`_cell` turns back."""
    kind, cell = field_type(df, name), col(name)
    if isinstance(kind, T.BinaryType):
        return F.hex(cell)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(cell).cast("string")
    return (cell + F.lit(0).cast(kind) if isinstance(kind, T.FractionalType) else cell).cast("string")  # one zero


def _cell(text: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BinaryType):
        return F.unhex(text)
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(text.cast("long"))
    return text.cast(kind)


def _key_text(df: DataFrame, keys: list[str]) -> Column:
    """All cells of a key, nulls among them, as one text: in pandas, null numbers would become NaN."""
    return F.to_json(F.array(*[_cell_text(df, k) for k in keys]))


def _kept(state: GroupState) -> dict:
    return pickle.loads(bytes(state.get[0])) if state.exists else {}


def _keep(state: GroupState, kept: dict, next_ms: int) -> None:
    """Hold what is still open until the first of its windows ends."""
    if kept:
        state.update((pickle.dumps(kept),))
        state.setTimeoutTimestamp(next_ms)
    elif state.exists:
        state.remove()


def admit_stream(
    events: DataFrame,
    keys: list[str],
    ts: str,
    max_requests: int,
    window_seconds: int,
    lateness: str = "10 minutes",
    groups: int = GROUPS,
) -> DataFrame:
    """Every event, as it arrives, with ``window_start`` and ``allowed``.

    The n-th event to arrive in a window passes iff n <= max_requests.  A key
    and window is one counter; it is dropped once the watermark has passed the
    window, and events later than that are ignored.  Events without a time
    share a window that does not end.  Keys and windows are dealt to `groups`
    states, a number that stays with the checkpoint.
    """
    source = events.withColumn("window_start", window_start(events, ts, window_seconds))
    source = source.withColumn(ts, col(ts).cast("timestamp")).withWatermark(ts, lateness)
    out = [*source.schema.fields, T.StructField("allowed", T.BooleanType())]
    # whole numbers go through pandas as text, since nulls would make floats of them
    texts = {f.name for f in source.schema.fields if isinstance(f.dataType, T.IntegralType)}
    end_ms = F.coalesce((F.col("window_start") + window_seconds) * 1000, F.lit(NEVER))
    dealt = source.select(
        *[col(c).cast("string").alias(c) if c in texts else col(c) for c in source.columns],
        _key_text(source, keys).alias("__key"),
        end_ms.alias("__end_ms"),
    ).withColumn("__group", F.pmod(F.xxhash64("__key", "__end_ms"), F.lit(groups)))
    schema = T.StructType([T.StructField(f.name, T.StringType()) if f.name in texts else f for f in out])

    def count(_key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = _kept(state)
        if not state.hasTimedOut:
            for pdf in batches:
                allowed = []
                for place in zip(pdf["__key"], pdf["__end_ms"]):
                    seen[place] = nth = seen.get(place, 0) + 1
                    allowed.append(nth <= max_requests)
                yield pdf.assign(allowed=allowed)[schema.names]
        now_ms = state.getCurrentWatermarkMs()  # events of windows that end before it are late from now on
        seen = {place: n for place, n in seen.items() if place[1] > now_ms}
        _keep(state, seen, min((end for _, end in seen), default=0))

    counted = dealt.groupBy("__group").applyInPandasWithState(
        count, schema, "seen binary", "append", GroupStateTimeout.EventTimeTimeout
    )
    return counted.select(*[col(f.name).cast(f.dataType).alias(f.name) if f.name in texts else col(f.name) for f in out])


def count_stream(
    events: DataFrame,
    keys: list[str],
    ts: str,
    max_requests: int,
    window_seconds: int,
    lateness: str = "10 minutes",
) -> DataFrame:
    """Per key and closed window: events, allowed, refused.

    Built-in windowed aggregation; in append mode a window appears when the
    watermark has passed its end.
    """
    source = events.withColumn(ts, col(ts).cast("timestamp")).withWatermark(ts, lateness)
    counts = source.groupBy(*[col(k) for k in keys], F.window(col(ts), f"{window_seconds} seconds")).agg(
        F.count("*").alias("events")
    )
    passed = F.least(F.col("events"), F.lit(max_requests).cast("long"))
    return counts.select(
        *[col(k) for k in keys],
        F.unix_seconds(F.col("window.start")).alias("window_start"),
        "events",
        passed.alias("allowed"),
        (F.col("events") - passed).alias("refused"),
    )


def _first_of_salt(
    events: DataFrame, marks: DataFrame, keys: list[str], ts: str, event_id: str, max_requests: int, window_seconds: int,
    lateness: str, groups: int,
) -> DataFrame:
    """Per key, closed window and salt the first ``max_requests`` events: ``__k0...``, ``window_start``, ``__us``, ``__id``.

    Some more may come along, where a group has several salts.  `marks` (``at timestamp``) only move the watermark.
    """
    slim = events.where(col(ts).isNotNull() & col(event_id).isNotNull()).select(
        _key_text(events, keys).alias("__key"),
        window_start(events, ts, window_seconds).alias("window_start"),
        F.pmod(F.xxhash64(col(event_id), col(ts)), F.lit(SALTS)).alias("__salt"),
        event_time(events, ts).alias("__at"),
        col(event_id).alias("__id"),
    )
    timed = slim.unionByName(marks.select(F.col("at").alias("__at")), allowMissingColumns=True)
    # the condition names the event time, so it stays above the watermark, which marks must reach
    timed = timed.withWatermark("__at", lateness).where(F.col("__at") < F.lit(END_OF_TIME).cast("timestamp"))
    timed = timed.withColumn("__us", F.unix_micros("__at"))
    timed = timed.withColumn("__group", F.pmod(F.xxhash64("__key", "window_start", "__salt"), F.lit(groups)))
    out_schema = T.StructType([timed.schema[c] for c in ("__key", "window_start", "__us", "__id")])

    def keep_first(_key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = _kept(state)  # (key, window): its first events, as (time, id) in order
        if not state.hasTimedOut:
            for pdf in batches:
                for place, event in zip(zip(pdf["__key"], pdf["window_start"]), zip(pdf["__us"], pdf["__id"])):
                    first = kept.setdefault(place, [])
                    if len(first) < max_requests or first and event < first[-1]:
                        insort(first, event)
                        del first[max_requests:]
        close_ms = {start: (start + window_seconds) * 1000 + 1 for _, start in kept}
        now_ms = state.getCurrentWatermarkMs()
        closed = [place for place in kept if close_ms[place[1]] < now_ms]
        if closed:
            rows = [(*place, *event) for place in closed for event in kept.pop(place)]
            yield pd.DataFrame(rows, columns=out_schema.names)
        _keep(state, kept, min((close_ms[start] for _, start in kept), default=0))

    firsts = timed.groupBy("__group").applyInPandasWithState(
        keep_first, out_schema, "kept binary", "append", GroupStateTimeout.EventTimeTimeout
    )
    cells = F.from_json("__key", "array<string>")
    typed = [_cell(cells[i], field_type(events, k)).alias(f"__k{i}") for i, k in enumerate(keys)]
    return firsts.select(*typed, "window_start", "__us", "__id")


def run_admission(
    events: DataFrame,
    keys: list[str],
    ts: str,
    event_id: str,
    max_requests: int,
    window_seconds: int,
    root: str,
    lateness: str = "10 minutes",
    close: bool = False,
    groups: int = GROUPS,
) -> None:
    """Take in what the stream has; :func:`admitted_events` then gives the events that pass in the windows closed so far.

    A window passes its first ``max_requests`` events by time and id, whatever
    the order of arrival, once the watermark is beyond its end.  A key's window
    has `SALTS` parts, each of which holds that many events at most, and all of
    which close in one micro-batch; parts are dealt to `groups` states, a number
    that stays with `root`.  `close` ends the stream: a mark moves the watermark
    to the end of time, so the newest windows close too, and everything that
    comes after it is late.

    Late events, and events without a time or an id, take no part; null keys
    are a key.  `root` holds the query's checkpoint, its marks and its output;
    going on with it goes on with the windows still open.
    """
    require_columns(events, *keys, ts, event_id)
    spark = events.sparkSession
    end = spark.range(1).select(F.lit(END_OF_TIME).cast("timestamp").alias("at"))
    end.where(F.lit(False)).write.mode("ignore").parquet(f"{root}/marks")
    marks = spark.readStream.schema(end.schema).parquet(f"{root}/marks")
    first = _first_of_salt(events, marks, keys, ts, event_id, max_requests, window_seconds, lateness, groups)
    # names and types by which admitted_events reads the output
    names = spark.createDataFrame([], T.StructType([T.StructField(k, first.schema[f"__k{i}"].dataType) for i, k in enumerate(keys)]))
    names.write.mode("ignore").parquet(f"{root}/keys")

    def drain() -> None:
        run_available(first, f"{root}/first", f"{root}/checkpoint")

    drain()
    if close:
        end.write.mode("append").parquet(f"{root}/marks")
        drain()


def admitted_events(spark: SparkSession, root: str, ts: str, event_id: str, max_requests: int) -> DataFrame:
    """The events that pass in the closed windows: the keys, ``window_start``, their time and id."""
    keys = spark.read.parquet(f"{root}/keys").columns
    inner = [f"__k{i}" for i in range(len(keys))]
    order = Window.partitionBy(*inner, "window_start").orderBy("__us", "__id")
    ranked = spark.read.parquet(f"{root}/first").withColumn("__nth", F.row_number().over(order))
    return ranked.where(F.col("__nth") <= max_requests).select(
        *[F.col(n).alias(k) for n, k in zip(inner, keys, strict=True)],
        "window_start",
        F.timestamp_micros("__us").alias(ts),
        F.col("__id").alias(event_id),
    )
