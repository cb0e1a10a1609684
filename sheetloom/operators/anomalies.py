"""Robust outliers: modified z-score over median and MAD.

The numbers are read out of the table once, into a written table of them alone:
the statistics and the listing pass over that.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetloom.functions.cells import round_half_even, to_number
from sheetloom.operators.medians import exact_medians
from sheetloom.rows import ROW_ID, require_columns, require_row_id
from sheetloom.session import materialize

# Iglewicz and Hoaglin's constant, default cut-off, least sample.
MAD_SCALE = 0.6745
DEFAULT_THRESHOLD = 3.5
MIN_VALUES = 10

ANOMALY_SCHEMA = f"{ROW_ID} long, column string, value double, anomaly_score double"


@dataclass(frozen=True)
class Spread:
    """Robust location and spread of one column."""

    median: float
    mad: float
    mean_deviation: float

    def score(self, value: Column) -> Column:
        """Absolute modified z-score; plain deviation where the MAD is zero."""
        if self.mad == 0:
            return F.abs(value - F.lit(self.median)) / F.lit(self.mean_deviation or 1.0)
        return F.abs(F.lit(MAD_SCALE) * (value - F.lit(self.median)) / F.lit(self.mad))


def column_spreads(df: DataFrame, columns: list[str]) -> dict[str, Spread]:
    """Statistics of all columns together; columns with too few numbers are left out."""
    return _spreads(df, {c: to_number(df, c) for c in columns})


def _spreads(df: DataFrame, numbers: dict[str, Column]) -> dict[str, Spread]:
    medians, _ = exact_medians(df, numbers)
    centre = {c: m for c, (n, m) in medians.items() if n >= MIN_VALUES}
    away = {c: F.abs(numbers[c] - F.lit(m)) for c, m in centre.items()}
    mads, _ = exact_medians(df, away)
    flat = [c for c in centre if mads[c][1] == 0]  # only these need the mean deviation
    means = df.agg(*[F.avg(away[c]) for c in flat]).first() if flat else ()
    return {c: Spread(centre[c], mads[c][1], dict(zip(flat, means)).get(c, 0.0)) for c in centre}


def detect_anomalies(
    df: DataFrame,
    columns: str | list[str],
    threshold: float = DEFAULT_THRESHOLD,
) -> DataFrame:
    """Flagged cells ``(_row_id, column, value, anomaly_score)``, worst first."""
    names = [columns] if isinstance(columns, str) else list(columns)
    require_columns(df, *names)
    require_row_id(df)
    table = materialize(df.select(F.col(ROW_ID), *[to_number(df, c).alias(f"n{i}") for i, c in enumerate(names)]), "numbers")
    spreads = _spreads(table, {c: F.col(f"n{i}") for i, c in enumerate(names)})
    if not spreads:
        return df.sparkSession.createDataFrame([], ANOMALY_SCHEMA)
    numbers = {f"__v{i}": F.col(f"n{names.index(c)}") for i, c in enumerate(spreads)}
    cells, any_flagged = [], F.lit(False)
    for tmp, (c, spread) in zip(numbers, spreads.items()):
        value, score = F.col(tmp), spread.score(F.col(tmp))
        cell = F.struct(F.lit(c).alias("column"), value.alias("value"), score.alias("score"))
        cells.append(F.when(score > threshold, cell))
        any_flagged = any_flagged | F.coalesce(score > threshold, F.lit(False))
    wide = table.select(F.col(ROW_ID), *[e.alias(tmp) for tmp, e in numbers.items()]).where(any_flagged)
    flagged = wide.select(F.col(ROW_ID), F.inline(F.array_compact(F.array(*cells))))
    return flagged.select(
        ROW_ID, "column", "value", round_half_even(F.col("score")).alias("anomaly_score")
    ).orderBy(F.col("anomaly_score").desc(), "column", ROW_ID)


def count_anomalies(
    df: DataFrame, columns: list[str], threshold: float = DEFAULT_THRESHOLD
) -> dict[str, int]:
    """Number of flagged cells per column, without listing them."""
    spreads = column_spreads(df, columns)
    if not spreads:
        return {}
    aggs = [F.count_if(s.score(to_number(df, c)) > threshold).alias(f"a{i}") for i, (c, s) in enumerate(spreads.items())]
    row = df.agg(*aggs).first()
    return {c: row[i] for i, c in enumerate(spreads)}
