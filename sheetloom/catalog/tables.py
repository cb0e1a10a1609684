"""Readers, writers, previews, sheet sessions and recipes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetloom.catalog.inputs import MESSY_ORDERS, Query, derived, plain, table
from sheetloom.operators.ordered import preview
from sheetloom.plans.recipes import apply_recipe, load_recipe, recipe_frame, save_recipe
from sheetloom.plans.sheet_session import SheetSession
from sheetloom.rows import ROW_ID
from sheetloom.session import scratch_path
from sheetloom.sources.tables import normalize_columns, read_delimited, write_csv
from sheetloom.sources.workbook import open_workbook

ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


def read_csv_detect(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "orders") + ".csv"
    table(spark, sf, "orders").select(ORDER_COLUMNS).write.options(header=True, sep=";").csv(path)
    return read_delimited(spark, path).drop(ROW_ID)


def normalize_headers(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return normalize_columns(raw.toDF(" Customer Key ", "  ", "Segment\t"))


def workbook_sheets(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_path(spark, "workbook")
    for name in ("nation", "orders", "region"):
        raw = table(spark, sf, name)
        if name == "orders":
            raw.select(ORDER_COLUMNS).write.parquet(f"{root}/{name}.parquet")
        else:
            raw.write.options(header=True).csv(f"{root}/{name}.csv")
    book = open_workbook(spark, root)
    counts = None
    for position, name in enumerate(book.names):
        one = book.switch(name).agg(F.count("*").alias("row_count")).select(
            F.lit(position).alias("position"), F.lit(name).alias("sheet"), "row_count"
        )
        counts = one if counts is None else counts.union(one)
    return counts


def preview_head(spark: SparkSession, sf: str) -> DataFrame:
    return preview(derived(spark, sf, MESSY_ORDERS, "o_orderkey"), 10).drop(ROW_ID)


def write_csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "customer") + ".csv"
    write_csv(table(spark, sf, "customer", "c_custkey"), path)
    return read_delimited(spark, path).drop(ROW_ID)


def snapshot_undo_redo_reset(spark: SparkSession, sf: str) -> DataFrame:
    session = SheetSession.create(spark, table(spark, sf, "orders", "o_orderkey"))
    session.update(session.working.where("o_orderstatus = 'F'"), "keep F")
    session.update(session.working.where("o_totalprice > 250000"), "keep large")
    stages = [("updated", session.working)]
    for stage in ("undo", "redo", "reset"):
        stages.append((stage, getattr(session, stage)()))
    stages.append(("undo_reset", session.undo()))
    out = None
    for name, df in stages:
        one = df.agg(F.count("*").alias("row_count"), F.sum("o_orderkey").alias("key_sum")).select(
            F.lit(name).alias("stage"), "row_count", "key_sum"
        )
        out = one if out is None else out.union(one)
    return out


RECIPE = [
    {"action": "quick_fix", "params": {"fix_id": "trim_spaces"}},
    {"action": "fill_missing", "params": {"strategies": {"price": {"method": "constant", "value": 0.0}}}},
    {"action": "if", "params": {"column": "price", "op": ">=", "value": 250000, "true_value": "Large",
                                "false_value": "Small", "new_column": "Size"}},
    {"action": "concatenate", "params": {"columns": ["status", "Size"], "separator": "-", "new_column": "Code"}},
    {"action": "text_extract", "params": {"column": "Size", "mode": "left", "new_column": "Initial", "n": 1}},
    {"action": "vlookup", "params": {"key_column": "o_custkey", "lookup_key_column": "c_custkey",
                                     "value_columns": ["c_name"]}},
    {"action": "rank", "params": {"column": "price", "new_column": "Rank"}},
    {"action": "serial_number", "params": {"new_column": "Sr No", "start": 1}},
]
BROKEN_RECIPE = [
    {"action": "rank", "params": {"column": "does not exist", "new_column": "R"}},
    {"action": "no such action", "params": {}},
    {"action": "vlookup", "params": {"key_column": "o_custkey", "lookup_key_column": "c_custkey",
                                     "value_columns": ["c_name"]}},
    {"action": "text_extract", "params": {"column": "status", "mode": "len", "new_column": "Length"}},
    {"action": "pivot", "params": {"index_cols": ["status"], "values_col": "o_orderkey", "agg_func": "count"}},
    {"action": "serial_number", "params": {}},
]

REPLAYED = f"""
WITH messy AS ({plain(MESSY_ORDERS)}),
filled AS (SELECT *, coalesce(price, 0.0) AS p2 FROM messy)
SELECT o_orderkey, o_custkey, p2 AS price, trim(priority) AS priority, status, remark, grade,
       CASE WHEN p2 >= 250000 THEN 'Large' ELSE 'Small' END AS "Size",
       coalesce(status, '') || '-' || CASE WHEN p2 >= 250000 THEN 'Large' ELSE 'Small' END AS "Code",
       CASE WHEN p2 >= 250000 THEN 'L' ELSE 'S' END AS "Initial",
       c_name,
       CAST(rank() OVER (ORDER BY p2 DESC) AS DOUBLE) AS "Rank",
       row_number() OVER (ORDER BY o_orderkey) AS "Sr No"
FROM filled LEFT JOIN customer ON o_custkey = c_custkey
"""


def recipe_replay(spark: SparkSession, sf: str) -> DataFrame:
    sheet = derived(spark, sf, MESSY_ORDERS, "o_orderkey")
    return apply_recipe(sheet, RECIPE, table(spark, sf, "customer", "c_custkey")).df.drop(ROW_ID)


CHAIN_RECIPE = [
    {"action": "fill_missing", "params": {"strategies": {"price": {"method": "ffill"}}}},
    {"action": "rank", "params": {"column": "price", "new_column": "Rank"}},
    {"action": "rank", "params": {"column": "Rank", "new_column": "Again", "ascending": True}},
    {"action": "quick_fix", "params": {"fix_id": "remove_empty_rows"}},
    {"action": "serial_number", "params": {"new_column": "Sr No", "start": 10}},
    {"action": "fill_missing", "params": {"strategies": {"priority": {"method": "ffill"}, "status": {"method": "bfill"}}}},
]

CHAINED = f"""
WITH messy AS ({plain(MESSY_ORDERS)}),
filled AS (SELECT * REPLACE (last_value(price IGNORE NULLS) OVER (ORDER BY o_orderkey) AS price) FROM messy),
ranked AS (SELECT *, CASE WHEN price IS NOT NULL THEN CAST(rank() OVER (ORDER BY price DESC NULLS LAST) AS DOUBLE) END AS "Rank" FROM filled),
again AS (SELECT *, CASE WHEN "Rank" IS NOT NULL THEN CAST(rank() OVER (ORDER BY "Rank" NULLS LAST) AS DOUBLE) END AS "Again" FROM ranked)
SELECT o_orderkey, o_custkey, price,
       last_value(CASE WHEN trim(priority) <> '' THEN priority END IGNORE NULLS) OVER (ORDER BY o_orderkey) AS priority,
       first_value(status IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS status,
       remark, grade, "Rank", "Again", 9 + row_number() OVER (ORDER BY o_orderkey) AS "Sr No"
FROM again
"""


def recipe_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Steps on the row order that depend on one another."""
    return apply_recipe(derived(spark, sf, MESSY_ORDERS, "o_orderkey"), CHAIN_RECIPE).df.drop(ROW_ID)


def recipe_skips(spark: SparkSession, sf: str) -> DataFrame:
    """Three of six steps are skipped; the others still apply."""
    replay = apply_recipe(derived(spark, sf, MESSY_ORDERS, "o_orderkey"), BROKEN_RECIPE)
    return replay.df.drop(ROW_ID).withColumn("skipped", F.lit(len(replay.skipped)))


def recipe_json(spark: SparkSession, sf: str) -> DataFrame:
    """A recipe saved, loaded and its first four steps replayed."""
    path = scratch_path(spark, "recipe")
    save_recipe(spark, path, "monthly", RECIPE)
    recipe = load_recipe(spark, path)
    actions = recipe_frame(spark, recipe).where("step <= 4").agg(F.array_join(F.array_sort(F.collect_list("action")), ","))
    sheet = apply_recipe(derived(spark, sf, MESSY_ORDERS, "o_orderkey"), recipe["steps"][:4]).df
    sizes = sheet.groupBy("Size", "Code").agg(F.count("*").alias("row_count"))
    return sizes.withColumn("recipe", F.lit(recipe["name"])).withColumn("actions", F.lit(actions.first()[0]))


QUERIES = {
    "read_csv_detect": Query(read_csv_detect, f"SELECT {', '.join(ORDER_COLUMNS)} FROM orders"),
    "normalize_headers": Query(
        normalize_headers,
        'SELECT c_custkey AS "Customer Key", c_name AS column_1, c_mktsegment AS "Segment" FROM customer',
    ),
    "workbook_sheets": Query(
        workbook_sheets,
        """SELECT 0 AS position, 'nation' AS sheet, count(*) AS row_count FROM nation
           UNION ALL SELECT 1, 'orders', count(*) FROM orders
           UNION ALL SELECT 2, 'region', count(*) FROM region""",
    ),
    "preview_head": Query(
        preview_head,
        f"""SELECT {', '.join(f"coalesce(CAST({c} AS VARCHAR), '') AS {c}"
                              for c in ('o_orderkey', 'o_custkey', 'price', 'priority', 'status', 'remark', 'grade'))}
            FROM (SELECT * FROM ({plain(MESSY_ORDERS)}) ORDER BY o_orderkey LIMIT 10)""",
    ),
    "write_csv_roundtrip": Query(
        write_csv_roundtrip, "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer"
    ),
    "snapshot_undo_redo_reset": Query(
        snapshot_undo_redo_reset,
        """WITH f AS (SELECT * FROM orders WHERE o_orderstatus = 'F'),
                l AS (SELECT * FROM f WHERE o_totalprice > 250000)
           SELECT 'updated' AS stage, count(*) AS row_count, CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM l
           UNION ALL SELECT 'undo', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM f
           UNION ALL SELECT 'redo', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM l
           UNION ALL SELECT 'reset', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM orders
           UNION ALL SELECT 'undo_reset', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM l""",
    ),
    "recipe_replay": Query(recipe_replay, REPLAYED),
    "recipe_chain": Query(recipe_chain, CHAINED),
    "recipe_skips": Query(
        recipe_skips,
        f"""SELECT row_number() OVER (ORDER BY status) AS "Sr No", status, o_orderkey, 3 AS skipped
            FROM (SELECT status, count(*) AS o_orderkey FROM ({plain(MESSY_ORDERS)})
                  WHERE status IS NOT NULL GROUP BY status)""",
    ),
    "recipe_json": Query(
        recipe_json,
        f"""WITH sized AS (SELECT status, CASE WHEN coalesce(price, 0) >= 250000 THEN 'Large' ELSE 'Small' END AS "Size"
                           FROM ({plain(MESSY_ORDERS)}))
            SELECT "Size", coalesce(status, '') || '-' || "Size" AS "Code", count(*) AS row_count,
                   'monthly' AS recipe, 'concatenate,fill_missing,if,quick_fix' AS actions
            FROM sized GROUP BY 1, 2""",
    ),
}
