"""Operators that depend on row order or global order: rank, serial number, fills.

All of them work inside range buckets, so no task ever sees the whole table.
What crosses buckets (row counts, and the row ids of the last filled cells) is
counted once, by a job over the few columns it needs, and comes to the driver as
at most ``rows.MAX_BUCKETS`` numbers for each count, which is why it may be
broadcast.  The step itself then reads its input once, so a chain of steps reads
the table as often as it has steps.

An :class:`OrderIndex` holds the cut of the row order for several steps.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetloom.functions.cells import is_missing, to_number
from sheetloom.rows import (
    BUCKET,
    ROW_ID,
    add_bucket,
    bucket_bounds,
    bucket_count,
    col,
    data_columns,
    require_columns,
    require_row_id,
)
from sheetloom.session import materialize


class OrderIndex:
    """The row order cut into ranges: cut points and the rows before each range.

    It holds as long as no row goes or comes, whatever becomes of the columns.
    With ``write`` the table is written first, and ``table`` is what was
    written: its counts then read one column of a file, not the plan behind it.

    Steps that are given an index leave the range of a row as a hidden column,
    so that neighbouring steps share one shuffle; :meth:`plain` drops it.
    """

    def __init__(self, df: DataFrame, write: bool = False) -> None:
        require_row_id(df)
        self.table = materialize(df, "ordered") if write else df
        ids = self.table.select(ROW_ID)
        self.rows, self.bounds = bucket_bounds(ids, F.col(ROW_ID))
        counts = add_bucket(ids, F.col(ROW_ID), self.bounds).groupBy(BUCKET).count().collect()
        self.before: dict[int, int] = {}
        total = 0
        for row in sorted(counts):
            self.before[row[0]] = total
            total += row[1]

    def cut(self, df: DataFrame) -> DataFrame:
        """The table with the hidden column."""
        return df if BUCKET in df.columns else add_bucket(df, F.col(ROW_ID), self.bounds)

    @staticmethod
    def plain(df: DataFrame) -> DataFrame:
        return df.drop(BUCKET)


def _small(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the driver as a table to be broadcast."""
    names = [x.split()[0] for x in schema.split(", ")]
    if not rows:
        return F.broadcast(df.sparkSession.createDataFrame([], schema))
    return F.broadcast(df.sparkSession.createDataFrame(pd.DataFrame(rows, columns=names), schema))


def serial_number(df: DataFrame, new_column: str = "Sr No", start: int = 1, index: OrderIndex | None = None) -> DataFrame:
    """Dense numbers ``start, start+1, ...`` in row order, as the first column."""
    require_row_id(df)
    if new_column in df.columns:
        df = df.drop(new_column)
    given, index = index, index or OrderIndex(df)
    cut = index.cut(df)
    before = _small(df, list(index.before.items()), "__ob int, __before long")
    inside = F.row_number().over(Window.partitionBy(BUCKET).orderBy(ROW_ID))
    number = (F.col("__before") + F.col("__inside") + F.lit(start - 1)).cast("long").alias(new_column)
    numbered = cut.withColumn("__inside", inside).join(before, F.col(BUCKET) == F.col("__ob"))
    out = numbered.select(number, *[col(c) for c in cut.columns])
    return out if given else index.plain(out)


def rank_column(df: DataFrame, column: str, new_column: str, ascending: bool = False) -> DataFrame:
    """Rank over the whole column; ties share the lowest rank, non-numbers get null.

    A value that is frequent enough to be a cut point gets a bucket of its
    own.  Its rank is known from the bucket counts alone, so its rows are
    spread over salted groups instead of meeting in one task; blanks likewise.
    """
    df = OrderIndex.plain(df)
    require_columns(df, column)
    require_row_id(df)
    kept = [c for c in df.columns if c != new_column]
    value = F.col("__v")

    def placed(source: DataFrame) -> DataFrame:
        """Rows with their bucket's place in the order: a cut point's own rows come before the rest of its bucket."""
        cut = add_bucket(source.withColumn("__v", to_number(df, column)), value, bounds)
        floor_value = F.try_element_at(F.array(*[F.lit(b) for b in bounds]), F.col(BUCKET)) if bounds else F.lit(None)
        floor_value = F.when(F.col(BUCKET) > 0, floor_value)
        alone = F.coalesce(value == floor_value, F.lit(False))
        return cut.withColumn("__alone", alone).withColumn("__slot", 2 * F.col(BUCKET) + F.when(F.col("__alone"), 0).otherwise(1))

    narrow = df.select(col(column))
    _, bounds = bucket_bounds(narrow.select(to_number(df, column).alias("__v")), value)
    counts = dict(placed(narrow).where(value.isNotNull()).groupBy("__slot").count().collect())
    before, total = [], 0
    for slot in sorted(counts, reverse=not ascending):
        before.append((slot, total))
        total += counts[slot]
    spread = F.pmod(F.xxhash64(F.col(ROW_ID)), F.lit(bucket_count(df))).cast("int")
    cut = placed(df).withColumn("__salt", F.when(F.col("__alone") | value.isNull(), spread).otherwise(F.lit(0)))
    within = Window.partitionBy("__slot", "__salt").orderBy(value.asc() if ascending else value.desc())
    rank = F.when(value.isNotNull(), (F.col("__before") + F.col("__rank")).cast("double"))
    return (
        cut.withColumn("__rank", F.rank().over(within))
        .join(_small(df, before, "__os int, __before long"), F.col("__slot") == F.col("__os"), "left")
        .select(*[col(c) for c in kept], rank.alias(new_column))
        .select(*_placed(df.columns, new_column))
    )


def _placed(columns: list[str], new_column: str):
    """Keep a replaced column where it was, or append a new one."""
    names = columns if new_column in columns else [*columns, new_column]
    return [col(c) for c in names]


def directional_fill(
    df: DataFrame, forward: list[str] = (), backward: list[str] = (), index: OrderIndex | None = None
) -> DataFrame:
    """Fill missing cells from the nearest filled row above (below).

    One narrow job finds, for each range and column, the row id of the last
    (first) filled cell, and which columns lack anything at all; the others are
    left alone.  Where a range needs a cell of an earlier (later) one, the row
    that holds it sends a copy along to that range, so cells of any length
    travel with the one shuffle that all columns share.
    """
    require_columns(df, *forward, *backward)
    require_row_id(df)
    if not forward and not backward:
        return df
    given, index = index, index or OrderIndex(df)
    names = list(dict.fromkeys([*forward, *backward]))
    cut = index.cut(df)
    edges = []
    for i, c in enumerate(names):
        known = F.when(~is_missing(df, c), F.col(ROW_ID))
        edges += [F.max(known).alias(f"last{i}"), F.min(known).alias(f"first{i}"), F.count_if(is_missing(df, c)).alias(f"gaps{i}")]
    found = sorted(cut.groupBy(BUCKET).agg(*edges).collect())
    gaps = {c: sum(row[f"gaps{i}"] for row in found) for i, c in enumerate(names)}
    jobs = [(c, True) for c in forward if gaps[c]] + [(c, False) for c in backward if gaps[c]]
    if not jobs:
        return df
    carried: dict[int, dict[int, list[int]]] = {}  # row id -> range -> jobs that need its cell there
    for j, (name, down) in enumerate(jobs):
        i, held = names.index(name), None
        for row in found if down else reversed(found):
            if held is not None:
                carried.setdefault(held, {}).setdefault(row[BUCKET], []).append(j)
            edge = row[f"last{i}" if down else f"first{i}"]
            held = held if edge is None else edge
    carriers = [(r, [(b, own) for b, own in ranges.items()]) for r, ranges in carried.items()]
    blanked = cut.withColumns({c: F.when(~is_missing(df, c), col(c)) for c, _ in jobs})
    sent = F.broadcast(df.sparkSession.createDataFrame(carriers, "__r long, __to array<struct<b:int,jobs:array<int>>>"))
    own = F.array(F.struct(F.col(BUCKET).alias("b"), F.lit(None).cast("array<int>").alias("jobs")))
    sent_rows = blanked.join(sent, F.col(ROW_ID) == F.col("__r"), "left")
    sent_rows = sent_rows.withColumn("__at", F.explode(F.concat(own, F.coalesce("__to", F.array().cast("array<struct<b:int,jobs:array<int>>>")))))
    rows = sent_rows.select(*[col(c) for c in blanked.columns if c != BUCKET], F.col("__at.b").alias(BUCKET), F.col("__at.jobs").alias("__jobs"))
    so_far = {}
    for j, (name, down) in enumerate(jobs):
        # a copy counts only for the columns it was sent for; it comes before (after) all rows of the range, as its id does
        cell = F.when(F.col("__jobs").isNull() | F.array_contains("__jobs", j), col(name))
        order = F.col(ROW_ID) if down else F.col(ROW_ID).desc()
        frame = Window.partitionBy(BUCKET).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        so_far[f"__seen{j}"] = F.last(cell, ignorenulls=True).over(frame)
    filled = {name: F.col(f"__seen{j}") for j, (name, _) in enumerate(jobs)}
    out = rows.withColumns(so_far).where(F.col("__jobs").isNull()).select(*[filled[c].alias(c) if c in filled else col(c) for c in cut.columns])
    return out if given else index.plain(out)


def forward_fill(df: DataFrame, *columns: str) -> DataFrame:
    return directional_fill(df, forward=list(columns))


def backward_fill(df: DataFrame, *columns: str) -> DataFrame:
    return directional_fill(df, backward=list(columns))


def preview(df: DataFrame, n: int = 10) -> DataFrame:
    """The first n rows as text, blanks as ``""``."""
    from sheetloom.functions.cells import as_text

    require_row_id(df)
    head = df.orderBy(ROW_ID).limit(n)
    cells = [F.coalesce(as_text(head, c), F.lit("")).alias(c) for c in data_columns(head)]
    return head.select(F.col(ROW_ID), *cells)


def preview_summary(df: DataFrame, n: int = 10) -> dict:
    """Column list, first n rows and total row count, for display."""
    rows = preview(df, n).orderBy(ROW_ID).drop(ROW_ID).collect()
    return {"columns": data_columns(df), "rows": [r.asDict() for r in rows], "row_count": df.count()}
