"""Inputs of the named queries.

The provided tables are clean, so messy ones are derived from them by SQL that
both engines read the same way.  ``{orders}`` and the like stand for tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from sheetloom.rows import with_row_id

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


@dataclass(frozen=True)
class Query:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str, key: str | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return with_row_id(df, key) if key else df


def derived(spark: SparkSession, sf_dir: str, sql: str, key: str | None = None) -> DataFrame:
    """Run derivation SQL over the tables it names; ``key`` becomes the row id."""
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    df = spark.sql(sql.replace('"', "`"), **used)  # quoted names: "..." in ANSI SQL
    return with_row_id(df, key) if key else df


def plain(sql: str) -> str:
    """The same SQL with the tables' own names."""
    return sql.format(**{t: t for t in TABLES})


MESSY_ORDERS = """
SELECT o_orderkey,
       o_custkey,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL
            WHEN o_orderkey % 11 = 0 THEN '  '
            ELSE o_orderpriority END AS priority,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderstatus END AS status,
       CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS STRING)
            WHEN o_orderkey % 3 = 1 THEN o_orderstatus
            ELSE '' END AS remark,
       CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderkey % 100 END AS grade
FROM {orders}
"""

# gaps of all lengths, including blanks that are only white space
GAPPED_EVENTS = """
SELECT event_id,
       CASE WHEN event_id % 3 = 1 THEN value END AS reading,
       CASE WHEN event_id % 4 = 0 THEN event_type WHEN event_id % 4 = 1 THEN ' ' END AS kind
FROM {events}
"""

REPEATED_EVENTS = "SELECT event_id, user_id % 50 AS user_id, event_type FROM {events}"

# one value holds a third of all rows, another seventh is blank
TIED_ORDERS = """
SELECT o_orderkey,
       CASE WHEN o_orderkey % 7 = 3 THEN NULL
            WHEN o_orderkey % 3 = 0 THEN 'x'
            WHEN o_orderkey % 3 = 1 THEN '500'
            ELSE CAST(o_custkey AS STRING) END AS amount
FROM {orders}
"""
