"""Which fix does a problem description ask for?"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetloom.operators.fixes import REGISTRY
from sheetloom.rows import col, require_columns

ERROR_KEYWORD_WEIGHT = 5


def keyword_weight(keyword: str) -> int:
    """Error tokens are rare and decisive; phrases count by their words."""
    return ERROR_KEYWORD_WEIGHT if keyword.startswith("#") else len(keyword.split())


def _score(text: Column, keywords: tuple[str, ...]) -> Column:
    points = [F.when(F.contains(text, F.lit(k)), keyword_weight(k)).otherwise(0) for k in keywords]
    return reduce(lambda a, b: a + b, points, F.lit(0))


def match_fix(df: DataFrame, text_column: str) -> DataFrame:
    """Add ``fix_id``, ``fix_label`` and ``fix_score``; null where no keyword occurs.

    The keyword list is small and fixed, so the scores are plain expressions:
    no join and no shuffle, whatever the size of the table.
    """
    require_columns(df, text_column)
    scored = df.withColumn("__text", F.lower(F.coalesce(col(text_column), F.lit(""))))
    text = F.col("__text")
    entries = [
        F.struct(
            _score(text, fix.keywords).alias("score"),
            F.lit(-i).alias("precedence"),
            F.lit(fix.id).alias("id"),
            F.lit(fix.label).alias("label"),
        )
        for i, fix in enumerate(REGISTRY)
    ]
    scored = scored.withColumn("__best", F.greatest(*entries) if len(entries) > 1 else entries[0])
    hit = F.col("__best.score") > 0
    return scored.select(
        *[col(c) for c in df.columns],
        F.when(hit, F.col("__best.id")).alias("fix_id"),
        F.when(hit, F.col("__best.label")).alias("fix_label"),
        F.col("__best.score").alias("fix_score"),
    )
