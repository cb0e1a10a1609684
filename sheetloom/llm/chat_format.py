"""Chat formatting with collapse of cumulative snapshots.

Logs often hold a conversation once for every turn, each log a prefix of the
next.  A digest rolls along the turns of every conversation; the digest of a
whole conversation is looked up among the digests of proper prefixes of the
same length.  Conversations that are found there, and all but the first of
equal ones, are left out by anti-joins; the rest is rendered.  All native.

Only hashes travel until the maximal conversations are known.  Turns are
numbered and summed in chunks of `CHUNK` turn numbers and the chunks' totals
carried over, and long conversations are rendered in parts of `PART` turns, so
no task holds a whole conversation.

Order is by turn, then role, then a hash of the text; turns without a number
come last.  Null roles and texts count as empty.  Turns without a conversation
id make up one conversation.  Equality is that of two 64-bit sums of position
dependent hashes, and of the length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetloom.session import materialize

CHUNK = 1024
PART = 1024
LAST = 1 << 62
WIDE = "decimal(38,0)"


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & left[k].eqNullSafe(right[k])
    return out


def _carried(rows: DataFrame, totals: DataFrame, columns: list[str]) -> DataFrame:
    """`rows` with, for each of `columns`, the sum over all earlier chunks of the conversation."""
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    sums = totals.select(
        F.col("conv_id").alias("c"), F.col("chunk").alias("k"),
        *(F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"{x}_before") for x in columns),
        *(F.sum(x).over(whole).alias(f"{x}_all") for x in columns),
    )
    return rows.join(sums, rows["conv_id"].eqNullSafe(sums["c"]) & (rows["chunk"] == sums["k"])).drop("c", "k")


def prefix_digests(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each turn: conv_id, turn, role, h1 (hash of role and text), ``place`` from 1, ``n`` turns in all, and the
    digest ``d1, d2`` of the turns up to it."""
    who, what = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    number = F.coalesce(F.col(turn).cast("long"), F.lit(LAST))
    slim = turns.select(
        F.col(conv_id).alias("conv_id"), number.alias("turn"), F.floor(number / CHUNK).cast("long").alias("chunk"), who.alias("role"),
        F.xxhash64(who, what).alias("h1"), F.xxhash64(what, F.lit(1), who).alias("h2"),
    )
    inside = Window.partitionBy("conv_id", "chunk").orderBy("turn", "role", "h1")
    counts = slim.groupBy("conv_id", "chunk").agg(F.count(F.lit(1)).alias("rows"))
    placed = _carried(slim, counts, ["rows"]).withColumn("place", F.col("rows_before") + F.row_number().over(inside))
    placed = materialize(
        placed.select(
            "conv_id", "chunk", "turn", "role", "h1", "place", F.col("rows_all").alias("n"),
            F.xxhash64("place", "h1", "h2").cast(WIDE).alias("e1"), F.xxhash64("h2", "place", "h1").cast(WIDE).alias("e2"),
        ),
        "chat-turns",
    )
    totals = placed.groupBy("conv_id", "chunk").agg(F.sum("e1").alias("e1"), F.sum("e2").alias("e2"))
    upto = Window.partitionBy("conv_id", "chunk").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = _carried(placed, totals, ["e1", "e2"])
    return carried.select(
        "conv_id", "turn", "role", "h1", "place", "n",
        (F.col("e1_before") + F.sum("e1").over(upto)).cast(WIDE).alias("d1"),
        (F.col("e2_before") + F.sum("e2").over(upto)).cast(WIDE).alias("d2"),
    )


def maximal_conversations(digests: DataFrame) -> DataFrame:
    """Ids of conversations that are no proper prefix of another, the least id of equal ones; ``n_equal`` counts those."""
    ends = digests.where("place = n").groupBy("place", "d1", "d2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_equal"))
    prefixes = digests.where("place < n").select("place", "d1", "d2").distinct()
    return ends.join(prefixes, ["place", "d1", "d2"], "left_anti").select("conv_id", F.col("place").alias("n_turns"), "n_equal")


def render_turn(role: Column, text: Column) -> Column:
    """One turn in markup; markup inside a text is broken up by a space."""
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"), plain, F.lit("<|end|>\n"))


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rendered maximal conversations: conv_id, ``part`` from 0, n_turns of the part, n_equal (conversations it stands for) and
    ``chat``.  Joining a conversation's parts gives the whole."""
    digests = materialize(prefix_digests(turns, conv_id, turn, role, text), "chat-digests")
    kept = materialize(maximal_conversations(digests), "chat-maximal")
    who, what = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    named = turns.select(
        F.col(conv_id).alias("conv_id"), F.coalesce(F.col(turn).cast("long"), F.lit(LAST)).alias("turn"), who.alias("role"), what.alias("text")
    )
    named = named.withColumn("h1", F.xxhash64("role", "text")).withColumn("chunk", F.floor(F.col("turn") / CHUNK))
    ids = kept.select(F.col("conv_id").alias("c"), "n_equal")
    of_kept = named.join(ids, named["conv_id"].eqNullSafe(ids["c"])).drop("c")
    counts = of_kept.groupBy("conv_id", "chunk").agg(F.count(F.lit(1)).alias("rows"))
    inside = Window.partitionBy("conv_id", "chunk").orderBy("turn", "role", "h1")
    placed = _carried(of_kept, counts, ["rows"]).withColumn("place", F.col("rows_before") + F.row_number().over(inside))
    shown = F.struct("place", render_turn(F.col("role"), F.col("text")).alias("shown"))
    return (
        placed.groupBy("conv_id", F.floor((F.col("place") - 1) / PART).cast("long").alias("part"))
        .agg(F.count(F.lit(1)).alias("n_turns"), F.min("n_equal").alias("n_equal"), F.sort_array(F.collect_list(shown)).alias("turns"))
        .select("conv_id", "part", "n_turns", "n_equal", F.array_join(F.transform("turns", lambda t: t["shown"]), "").alias("chat"))
    )
