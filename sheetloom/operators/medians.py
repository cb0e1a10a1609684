"""Exact medians of many columns or groups together, by radix descent.

A double becomes a 64-bit key of the same order.  Each pass counts how many
values have which next 16 bits, a histogram of at most 65,536 small rows for
each column or group, and keeps the prefix under which the wanted rank lies; a
prefix that holds one value only is an answer.  Four passes settle every key,
most data takes two or three.  Values are counted where they are; what lies under
the prefixes of the first pass is written once, for the passes after it.  No task
holds a column's or a group's distinct values.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetloom.rows import col, quoted
from sheetloom.session import materialize

BITS = 16
SHIFTS = (48, 32, 16, 0)


def with_order_keys(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add, for each DOUBLE column (no NaN), a BIGINT column of the given name that orders like it; both zeros are 0.

    For positive numbers these are the bits of the number: the exponent from a
    logarithm, put right by comparison, and the fraction by exact divisions.
    Each step is a projection of its own, so that nothing is computed twice.
    """
    step = lambda frame, text: frame.selectExpr("*", *[text.format(v=quoted(v), i=i) for i, v in enumerate(columns)])
    out = step(df, "abs({v}) AS __size{i}")
    out = step(out, "greatest(least(CAST(floor(log2(__size{i})) AS INT), 1023), -1022) AS __guess{i}")
    out = step(
        out,
        """greatest(-1022, CASE WHEN __size{i} < pow(2D, __guess{i}) THEN __guess{i} - 1
                                WHEN __size{i} / 2 >= pow(2D, __guess{i}) THEN __guess{i} + 1 ELSE __guess{i} END) AS __exponent{i}""",
    )
    least_step = f"{2.0**537!r}D"  # twice: the number of subnormal steps
    out = step(
        out,
        f"""CASE WHEN __size{{i}} < {2.0**-1022!r}D THEN CAST(__size{{i}} * {least_step} * {least_step} AS BIGINT)
                 WHEN __size{{i}} = double('infinity') THEN {2047 << 52}L
                 ELSE shiftleft(CAST(__exponent{{i}} + 1023 AS BIGINT), 52) + CAST((__size{{i}} / pow(2D, __exponent{{i}}) - 1) * {2.0**52!r}D AS BIGINT)
            END AS __bits{{i}}""",
    )
    keys = [f"CASE WHEN {quoted(v)} < 0 THEN -__bits{i} ELSE __bits{i} END AS {quoted(k)}" for i, (v, k) in enumerate(columns.items())]
    return out.selectExpr(*map(quoted, df.columns), *keys)


def _cells(df: DataFrame, columns: dict[int, tuple[str, str]], *kept: str) -> DataFrame:
    """One row (__c, __v, __key) for each number; later filters stay above this, as keys are dear to compute again."""
    cells = [F.struct(F.lit(c).alias("__c"), F.col(v).alias("__v"), F.col(k).alias("__key")) for c, (v, k) in columns.items()]
    return df.select(*kept, F.inline(F.array(*cells))).where("__v IS NOT NULL AND NOT isnan(__v)")


def _histogram(cells: DataFrame, groups: list[str], parent: Column | None, shift: int) -> DataFrame:
    """Per group, parent prefix and prefix: rows ``n``, least and largest value, and the rows ``before`` under the parent."""
    parent = F.lit(0).cast("long") if parent is None else parent
    keyed = cells.select(*groups, "__v", parent.alias("__parent"), F.shiftright("__key", shift).alias("__prefix"))
    counts = keyed.groupBy(*groups, "__parent", "__prefix").agg(
        F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__low"), F.max("__v").alias("__high")
    )
    parts = ", ".join([*groups, "__parent"])
    upto = f"PARTITION BY {parts} ORDER BY __prefix ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    return counts.selectExpr("*", f"sum(__n) OVER ({upto}) - __n AS __before", f"sum(__n) OVER (PARTITION BY {parts}) AS __all")


# --------------------------------------------------------------------------
# columns
# --------------------------------------------------------------------------


@dataclass
class _Target:
    """The search for the value at one rank of one column."""

    column: int
    rank: int  # among the rows under the prefix
    prefix: int = 0
    value: float | None = None


def exact_medians(
    df: DataFrame, values: dict[str, Column], extra: dict[str, Column] | None = None
) -> tuple[dict[str, tuple[int, float | None]], dict]:
    """``{name: (count, median)}`` for several DOUBLE columns at once, and the ``extra`` aggregates.

    Every pass looks at all columns and both middle ranks.  What comes to the
    driver is two rows a column.
    """
    names = list(values)
    extras = {}
    if extra:
        row = df.agg(*[e.alias(f"e{i}") for i, e in enumerate(extra.values())]).first()
        extras = {n: row[f"e{i}"] for i, n in enumerate(extra)}
    total = dict.fromkeys(range(len(names)), 0)
    targets: list[_Target] = []
    for p, shift in enumerate(SHIFTS):
        waiting = [t for t in targets if t.value is None]
        if not names or (p and not waiting):
            break
        wanted = {c: sorted({t.prefix for t in waiting if t.column == c}) for c in (range(len(names)) if not p else {t.column for t in waiting})}
        if p < 2:  # the table itself is read twice at most
            cells = df.select(*[(values[names[c]].cast("double") + F.lit(0.0)).alias(f"__v{c}") for c in wanted])  # one zero
            cells = with_order_keys(cells, {f"__v{c}": f"__key{c}" for c in wanted})
            rows = _cells(cells, {c: (f"__v{c}", f"__key{c}") for c in wanted})
        if p:
            under = F.lit(False)
            for c, prefixes in wanted.items():
                under = under | ((F.col("__c") == c) & F.shiftright("__key", shift + BITS).isin(prefixes))
            rows = rows.where(under)
        if p == 1:
            rows = materialize(rows, "median-rows")
        found = _histogram(rows, ["__c"], F.shiftright("__key", shift + BITS) if p else None, shift)
        if not p:
            middle = (F.col("__before") <= F.expr("__all div 2")) & (F.col("__before") + F.col("__n") > F.expr("(__all - 1) div 2"))
        else:
            middle = F.lit(False)
            for t in waiting:
                here = (F.col("__c") == t.column) & (F.col("__parent") == t.prefix)
                middle = middle | (here & (F.col("__before") <= t.rank) & (F.col("__before") + F.col("__n") > t.rank))
        hits = found.where(middle).collect()
        if not p:
            for row in hits:
                total[row["__c"]] = row["__all"]
            targets = [_Target(c, r) for c, n in total.items() if n for r in sorted({(n - 1) // 2, n // 2})]
            waiting = targets
        for t in waiting:
            for row in hits:
                if (row["__c"], row["__parent"]) == (t.column, t.prefix) and row["__before"] <= t.rank < row["__before"] + row["__n"]:
                    if row["__low"] == row["__high"]:
                        t.value = row["__low"]
                    else:
                        t.prefix, t.rank = row["__prefix"], t.rank - row["__before"]
                    break
    out = {}
    for c, name in enumerate(names):
        middles = [t.value for t in targets if t.column == c]
        out[name] = (total[c], (middles[0] + middles[-1]) / 2.0 if middles else None)
    return out, extras


# --------------------------------------------------------------------------
# groups
# --------------------------------------------------------------------------


def _same(left: list[str], right: list[str]) -> Column:
    out = F.lit(True)
    for a, b in zip(left, right):
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def grouped_median(df: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """One row per group with the exact median of ``value``; groups without a number are left out.

    The groups go through the passes together.  Where each group's ranks lie is
    a written table with two rows a group, and a pass reads again only what lies
    under its prefixes.
    """
    groups = [f"__k{i}" for i in range(len(keys))]
    number = value.cast("double") + F.lit(0.0)
    source = df.select(*[col(k).alias(g) for k, g in zip(keys, groups)], number.alias("__v"))
    source = _cells(with_order_keys(source, {"__v": "__key"}), {0: ("__v", "__key")}, *groups)
    sides = F.explode(F.array(F.expr("(__all - 1) div 2"), F.expr("__all div 2"))).alias("__rank")
    reached = (F.col("__before") <= F.col("__rank")) & (F.col("__before") + F.col("__n") > F.col("__rank"))
    kept = [*groups, "__prefix", (F.col("__rank") - F.col("__before")).alias("__rank"), "__low", "__high"]
    located = _histogram(source, groups, None, SHIFTS[0]).select("*", sides).where(reached).select(*kept)
    located = materialize(located, "median-ranks")
    settled = located.where("__low = __high").select(*groups, "__low")
    waiting = located.where("__low < __high")
    for shift in SHIFTS[1:]:
        if waiting.isEmpty():
            break
        others = [f"__o{i}" for i in range(len(groups))]
        renamed = [F.col(g).alias(o) for g, o in zip(groups, others)]
        open_prefixes = waiting.select(*renamed, F.col("__prefix").alias("__up")).distinct()
        under = F.shiftright("__key", shift + BITS)
        rest = source.join(open_prefixes, _same(groups, others) & (under == F.col("__up"))).select(*groups, "__v", "__key")
        source = materialize(rest, "median-rows") if shift == SHIFTS[1] else rest
        found = _histogram(source, groups, under, shift)
        ranks = waiting.select(*renamed, F.col("__prefix").alias("__up"), "__rank")
        hits = found.join(ranks, _same(groups, others) & (F.col("__parent") == F.col("__up"))).where(reached)
        located = materialize(hits.select(*kept), "median-ranks")
        settled = settled.union(located.where("__low = __high").select(*groups, "__low"))
        waiting = located.where("__low < __high")
    medians = settled.groupBy(*groups).agg((F.sum("__low") / 2).alias(name))
    return medians.select(*[F.col(g).alias(k) for g, k in zip(groups, keys)], name)
