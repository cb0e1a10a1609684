"""Projections, filters, lookups, aggregates, pivots and ordered operators."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetloom.catalog.inputs import (
    GAPPED_EVENTS,
    MESSY_ORDERS,
    REPEATED_EVENTS,
    TIED_ORDERS,
    Query,
    derived,
    plain,
    table,
)
from sheetloom.operators import aggregates, distinct, formulas, lookups, ordered, pivots
from sheetloom.rows import ROW_ID, with_row_id

MESSY = plain(MESSY_ORDERS)


def _messy(spark: SparkSession, sf: str) -> DataFrame:
    return derived(spark, sf, MESSY_ORDERS, "o_orderkey")


# -- IF, CONCATENATE, text -------------------------------------------------

COMPARED = {"gt": ">", "lt": "<", "ge": ">=", "le": "<=", "eq": "==", "ne": "!="}


def if_number(spark: SparkSession, sf: str) -> DataFrame:
    df = _messy(spark, sf)
    for name, op in COMPARED.items():
        df = formulas.if_column(df, "grade", op, 50, "yes", "no", name)
    return df.select("o_orderkey", *COMPARED)


def if_text(spark: SparkSession, sf: str) -> DataFrame:
    df = _messy(spark, sf)
    for name, op in COMPARED.items():
        df = formulas.if_column(df, "priority", op, "3-MEDIUM", 1, 0, name)
    return df.select("o_orderkey", *COMPARED)


def if_contains(spark: SparkSession, sf: str) -> DataFrame:
    df = formulas.if_column(_messy(spark, sf), "priority", "contains", "high|urg", "hot", "cold", "has")
    df = formulas.if_column(df, "priority", "not_contains", "HIGH", "cold", "hot", "has_not")
    return df.select("o_orderkey", "has", "has_not")


def _sql_compare(column: str, value: str, yes: str, no: str) -> str:
    parts = []
    for name, op in COMPARED.items():
        null_case = yes if op == "!=" else no
        sql_op = {"==": "=", "!=": "<>"}.get(op, op)
        parts.append(
            f"CASE WHEN {column} IS NULL THEN {null_case} WHEN {column} {sql_op} {value} THEN {yes} ELSE {no} END AS {name}"
        )
    return f"SELECT o_orderkey, {', '.join(parts)} FROM ({MESSY})"


def concatenate(spark: SparkSession, sf: str) -> DataFrame:
    df = formulas.concatenate(_messy(spark, sf), ["status", "priority", "price"], " / ", "joined")
    return df.select("o_orderkey", "joined")


def text_part(spark: SparkSession, sf: str, mode: str, **args: int) -> DataFrame:
    docs = table(spark, sf, "documents", "doc_id")
    return formulas.text_extract(docs, "text", mode, "part", **args).select("doc_id", "part")


# -- rows ------------------------------------------------------------------


def drop_rows_by_id(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events", "event_id")
    unwanted = events.where("value > 50").select(ROW_ID)
    return distinct.drop_rows(events, unwanted).select("event_id", "user_id", "event_type", "value")


SPARSE_EVENTS = """
SELECT event_id AS id,
       CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS reading,
       CASE WHEN event_id % 2 = 0 THEN '   ' ELSE event_type END AS kind,
       CASE WHEN event_id % 8 = 4 THEN props END AS props
FROM {events}
"""


def remove_empty_rows(spark: SparkSession, sf: str) -> DataFrame:
    df = derived(spark, sf, SPARSE_EVENTS, "id").drop("id")
    return distinct.remove_empty_rows(df).withColumnRenamed(ROW_ID, "id")


def drop_missing_rows(spark: SparkSession, sf: str) -> DataFrame:
    return distinct.drop_missing_rows(derived(spark, sf, SPARSE_EVENTS, "id"), "kind").drop(ROW_ID)


# -- lookups ---------------------------------------------------------------

# keys repeat, so the first row must win; every fifth key is missing
CUSTOMER_LOOKUP = """
SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_custkey % 700 END AS id, c_name, c_mktsegment AS status
FROM {customer} WHERE c_custkey % 5 <> 0
"""
FIRST_CUSTOMER = f"""
SELECT id, arg_min(c_name, c_custkey) AS c_name, arg_min(status, c_custkey) AS status
FROM ({plain(CUSTOMER_LOOKUP)}) GROUP BY id
"""
KEYED_ORDERS = """
SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_custkey END AS o_custkey, o_orderstatus AS status
FROM {orders}
"""


def vlookup(spark: SparkSession, sf: str, how: str = "left", sheet: str = KEYED_ORDERS) -> DataFrame:
    orders = derived(spark, sf, sheet, "o_orderkey")
    customers = derived(spark, sf, CUSTOMER_LOOKUP, "c_custkey")
    return lookups.vlookup(orders, customers, "o_custkey", "id", ["c_name", "status"], how).drop(ROW_ID)


def vlookup_null_key(spark: SparkSession, sf: str) -> DataFrame:
    return vlookup(spark, sf, "inner").where("o_custkey IS NULL")


def index_match(spark: SparkSession, sf: str) -> DataFrame:
    customers = table(spark, sf, "customer", "c_custkey")
    nations = table(spark, sf, "nation", "n_nationkey")
    return lookups.index_match(customers, nations, "c_nationkey", "n_nationkey", ["n_name"]).select(
        "c_custkey", "c_nationkey", "n_name"
    )


def vlookup_matches(spark: SparkSession, sf: str) -> DataFrame:
    orders = derived(spark, sf, KEYED_ORDERS, "o_orderkey")
    return lookups.lookup_match_count(orders, derived(spark, sf, CUSTOMER_LOOKUP), "o_custkey", "id")


def hlookup(spark: SparkSession, sf: str) -> DataFrame:
    """Nations laid out across a row: keys in the first line, names in the second."""
    nations = table(spark, sf, "nation")
    codes = nations.groupBy().pivot("n_nationkey").agg(F.first(F.col("n_nationkey").cast("string")))
    names = nations.groupBy().pivot("n_nationkey").agg(F.first("n_name"))
    across = with_row_id(codes.withColumn("line", F.lit(0)).union(names.withColumn("line", F.lit(1))), "line")
    customers = table(spark, sf, "customer", "c_custkey")
    found = lookups.hlookup(customers, across.drop("line"), "c_nationkey", 0, 1)
    return found.select("c_custkey", "c_nationkey", "Lookup Value")


# -- aggregates ------------------------------------------------------------


def agg(spark: SparkSession, sf: str, func: str, column: str = "price", **cond) -> DataFrame:
    result = aggregates.aggregate(_messy(spark, sf), column, func, **cond)
    return result.select(F.round(F.col("result"), 3).alias("result")) if column == "price" else result


def _agg_sql(expr: str, rounded: bool = True) -> str:
    return f"SELECT {f'round({expr}, 3)' if rounded else expr} AS result FROM ({MESSY})"


IN_F = {"condition_column": "status", "condition_op": "==", "condition_value": "F"}
AGGREGATES = {
    "agg_sum": Query(partial(agg, func="sum"), _agg_sql("sum(price)")),
    "agg_average": Query(partial(agg, func="average"), _agg_sql("avg(price)")),
    "agg_count": Query(
        partial(agg, func="count", column="remark"), _agg_sql("count(TRY_CAST(remark AS DOUBLE))", False)
    ),
    "agg_counta": Query(partial(agg, func="counta", column="remark"), _agg_sql("count(remark)", False)),
    "agg_min": Query(partial(agg, func="min"), _agg_sql("min(price)")),
    "agg_max": Query(partial(agg, func="max"), _agg_sql("max(price)")),
    "agg_median": Query(partial(agg, func="median"), _agg_sql("median(price)")),
    "agg_countif": Query(
        partial(agg, func="countif", column="grade", **IN_F), _agg_sql("count(*) FILTER (WHERE status = 'F')", False)
    ),
    "agg_sumif": Query(partial(agg, func="sumif", **IN_F), _agg_sql("sum(price) FILTER (WHERE status = 'F')")),
    "agg_averageif": Query(
        partial(agg, func="averageif", condition_column="grade", condition_op=">", condition_value="40"),
        _agg_sql("avg(price) FILTER (WHERE grade > 40)"),
    ),
}

# -- pivots ----------------------------------------------------------------

LINES = """
SELECT l_returnflag, l_linestatus, CAST(l_linenumber AS STRING) AS line,
       CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity END AS quantity
FROM {lineitem}
"""
LINE_VALUES = [str(i) for i in range(1, 8)]
PIVOT_SQL = {
    "sum": "coalesce(sum(quantity), 0)",
    "mean": "avg(quantity)",
    "count": "count(quantity)",
    "min": "min(quantity)",
    "max": "max(quantity)",
    "median": "median(quantity)",
    "nunique": "count(DISTINCT quantity)",
}


def pivot(spark: SparkSession, sf: str, func: str, columns: str | None = None) -> DataFrame:
    out = pivots.pivot_table(derived(spark, sf, LINES), ["l_returnflag", "l_linestatus"], "quantity", func, columns)
    if func != "mean":
        return out
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def _pivot_rows_sql(func: str) -> str:
    value = f"round({PIVOT_SQL[func]}, 6)" if func == "mean" else PIVOT_SQL[func]
    return f"""SELECT l_returnflag, l_linestatus, {value} AS quantity FROM ({plain(LINES)})
               GROUP BY l_returnflag, l_linestatus HAVING {value} IS NOT NULL"""


def _pivot_columns_sql(func: str) -> str:
    # lines 3 and 6 have no values at all, so those headers exist only where an empty group has a result
    cells = []
    for v in LINE_VALUES:
        if v in ("3", "6") and func in pivots.NULLABLE:
            continue
        value = PIVOT_SQL[func]
        inner = value.replace("quantity)", f"CASE WHEN line = '{v}' THEN quantity END)")
        inner = f"round({inner}, 6)" if func == "mean" else inner
        cells.append(f'coalesce({inner}, 0) AS "{v}"')
    return f"""SELECT l_returnflag, l_linestatus, {', '.join(cells)} FROM ({plain(LINES)})
               GROUP BY l_returnflag, l_linestatus"""


PIVOTS = {}
for _func in pivots.FUNCTIONS:
    PIVOTS[f"pivot_rows_{_func}"] = Query(partial(pivot, func=_func), _pivot_rows_sql(_func))
    PIVOTS[f"pivot_cols_{_func}"] = Query(partial(pivot, func=_func, columns="line"), _pivot_columns_sql(_func))

SPEND = """
SELECT CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderpriority END AS priority, o_custkey,
       CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_totalprice END AS price FROM {orders}
"""


def pivot_long(spark: SparkSession, sf: str, func: str) -> DataFrame:
    """A header per customer: more than a table has columns."""
    return pivots.pivot_long(derived(spark, sf, SPEND), ["priority"], "price", func, "o_custkey")


def _pivot_long_sql(value: str) -> str:
    return f"""SELECT priority, CAST(dense_rank() OVER (ORDER BY o_custkey) AS BIGINT) AS header_position,
                      o_custkey AS header, {value} AS value FROM ({plain(SPEND)})
               WHERE priority IS NOT NULL AND price IS NOT NULL GROUP BY priority, o_custkey"""


PIVOTS["pivot_long_max"] = Query(partial(pivot_long, func="max"), _pivot_long_sql("max(price)"))
PIVOTS["pivot_long_median"] = Query(partial(pivot_long, func="median"), _pivot_long_sql("median(price)"))

# -- duplicates, order -----------------------------------------------------


def remove_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    df = derived(spark, sf, REPEATED_EVENTS, "event_id").drop("event_id")
    return distinct.remove_duplicates(df).withColumnRenamed(ROW_ID, "first_id")


def duplicate_count(spark: SparkSession, sf: str) -> DataFrame:
    return distinct.duplicate_count(derived(spark, sf, REPEATED_EVENTS).drop("event_id"))


def unique_values(spark: SparkSession, sf: str) -> DataFrame:
    df = derived(spark, sf, MESSY_ORDERS, "o_orderkey")
    return distinct.unique_values(df, "remark").withColumnRenamed(ROW_ID, "first_id")


def rank(spark: SparkSession, sf: str, ascending: bool) -> DataFrame:
    return ordered.rank_column(derived(spark, sf, TIED_ORDERS, "o_orderkey"), "amount", "rank", ascending).drop(ROW_ID)


def _rank_sql(direction: str) -> str:
    return f"""WITH n AS (SELECT o_orderkey, amount, TRY_CAST(amount AS DOUBLE) AS v FROM ({plain(TIED_ORDERS)}))
               SELECT o_orderkey, amount, CASE WHEN v IS NOT NULL THEN
                 CAST(rank() OVER (ORDER BY v {direction} NULLS LAST) AS DOUBLE) END AS rank FROM n"""


def serial_number(spark: SparkSession, sf: str) -> DataFrame:
    kept = table(spark, sf, "events", "event_id").where("event_type <> 'click'")
    return ordered.serial_number(kept, "Sr No", 101).select("Sr No", "event_id", "event_type")


def fill_direction(spark: SparkSession, sf: str, forward: bool) -> DataFrame:
    df = derived(spark, sf, GAPPED_EVENTS, "event_id")
    fill = ordered.forward_fill if forward else ordered.backward_fill
    return fill(df, "reading", "kind").drop(ROW_ID)


def _fill_sql(function: str, frame: str) -> str:
    over = f"OVER (ORDER BY event_id ROWS BETWEEN {frame})"
    return f"""SELECT event_id, {function}(reading IGNORE NULLS) {over} AS reading,
                      {function}(nullif(trim(kind), '') IGNORE NULLS) {over} AS kind FROM ({plain(GAPPED_EVENTS)})"""


QUERIES = {
    "if_number": Query(if_number, _sql_compare("grade", "50", "'yes'", "'no'")),
    "if_text": Query(if_text, _sql_compare("priority", "'3-MEDIUM'", "1", "0")),
    "if_contains": Query(
        if_contains,
        f"""SELECT o_orderkey,
                   CASE WHEN regexp_matches(priority, '(?i)high|urg') THEN 'hot' ELSE 'cold' END AS has,
                   CASE WHEN regexp_matches(priority, '(?i)HIGH') THEN 'hot' ELSE 'cold' END AS has_not
            FROM ({MESSY})""",
    ),
    "concatenate": Query(
        concatenate,
        f"""SELECT o_orderkey, coalesce(status, '') || ' / ' || coalesce(priority, '') || ' / '
                   || coalesce(CAST(price AS VARCHAR), '') AS joined FROM ({MESSY})""",
    ),
    "text_left": Query(partial(text_part, mode="left", n=12), "SELECT doc_id, left(text, 12) AS part FROM documents"),
    "text_right": Query(partial(text_part, mode="right", n=12), "SELECT doc_id, right(text, 12) AS part FROM documents"),
    "text_mid": Query(
        partial(text_part, mode="mid", start=5, length=20), "SELECT doc_id, substr(text, 6, 20) AS part FROM documents"
    ),
    "text_len": Query(partial(text_part, mode="len"), "SELECT doc_id, CAST(length(text) AS INTEGER) AS part FROM documents"),
    "drop_rows_by_id": Query(
        drop_rows_by_id,
        "SELECT event_id, user_id, event_type, value FROM events WHERE value <= 50 OR value IS NULL",
    ),
    "remove_empty_rows": Query(
        remove_empty_rows,
        f"""SELECT * FROM ({plain(SPARSE_EVENTS)})
            WHERE reading IS NOT NULL OR trim(kind) <> '' OR props IS NOT NULL""",
    ),
    "drop_missing_rows": Query(
        drop_missing_rows, f"SELECT * FROM ({plain(SPARSE_EVENTS)}) WHERE trim(kind) <> ''"
    ),
    "vlookup_left": Query(
        vlookup,
        f"""SELECT o.*, c.c_name, c.status AS status_lookup FROM ({plain(KEYED_ORDERS)}) o
            LEFT JOIN ({FIRST_CUSTOMER}) c ON o.o_custkey IS NOT DISTINCT FROM c.id""",
    ),
    "vlookup_inner": Query(
        partial(vlookup, how="inner"),
        f"""SELECT o.*, c.c_name, c.status AS status_lookup FROM ({plain(KEYED_ORDERS)}) o
            JOIN ({FIRST_CUSTOMER}) c ON o.o_custkey IS NOT DISTINCT FROM c.id""",
    ),
    "vlookup_null_key": Query(
        vlookup_null_key,
        f"""SELECT o.*, c.c_name, c.status AS status_lookup FROM ({plain(KEYED_ORDERS)}) o
            JOIN ({FIRST_CUSTOMER}) c ON o.o_custkey IS NULL AND c.id IS NULL""",
    ),
    "vlookup_matches": Query(
        vlookup_matches,
        f"""SELECT count(*) FILTER (WHERE c.hit) AS matched, count(*) AS total FROM ({plain(KEYED_ORDERS)}) o
            LEFT JOIN (SELECT DISTINCT id, true AS hit FROM ({plain(CUSTOMER_LOOKUP)})) c
              ON o.o_custkey IS NOT DISTINCT FROM c.id""",
    ),
    "index_match": Query(
        index_match,
        "SELECT c_custkey, c_nationkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey",
    ),
    "hlookup": Query(
        hlookup,
        """SELECT c_custkey, c_nationkey, n_name AS "Lookup Value"
           FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
    ),
    **AGGREGATES,
    **PIVOTS,
    "remove_duplicates": Query(
        remove_duplicates,
        f"SELECT user_id, event_type, min(event_id) AS first_id FROM ({plain(REPEATED_EVENTS)}) GROUP BY ALL",
    ),
    "duplicate_count": Query(
        duplicate_count,
        f"""SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type FROM ({plain(REPEATED_EVENTS)})))
            AS duplicate_rows FROM events""",
    ),
    "unique_values": Query(
        unique_values,
        f"SELECT remark, min(o_orderkey) AS first_id FROM ({MESSY}) WHERE remark IS NOT NULL GROUP BY remark",
    ),
    "rank_desc": Query(partial(rank, ascending=False), _rank_sql("DESC")),
    "rank_asc": Query(partial(rank, ascending=True), _rank_sql("ASC")),
    "serial_number": Query(
        serial_number,
        """SELECT 100 + row_number() OVER (ORDER BY event_id) AS "Sr No", event_id, event_type
           FROM events WHERE event_type <> 'click'""",
    ),
    "fill_ffill": Query(
        partial(fill_direction, forward=True), _fill_sql("last_value", "UNBOUNDED PRECEDING AND CURRENT ROW")
    ),
    "fill_bfill": Query(
        partial(fill_direction, forward=False), _fill_sql("first_value", "CURRENT ROW AND UNBOUNDED FOLLOWING")
    ),
}
