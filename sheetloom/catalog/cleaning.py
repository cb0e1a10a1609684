"""The eighteen fixes and the keyword classifier."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetloom.catalog.inputs import MESSY_ORDERS, REPEATED_EVENTS, Query, derived, plain, table
from sheetloom.operators import fixes
from sheetloom.operators.changes import ChangeLog
from sheetloom.operators.keywords import keyword_weight, match_fix
from sheetloom.rows import ROW_ID

SPACES = r"[\t\n\x0b\f\r \x{85}\p{Z}]"

DAY = "lpad(CAST(extract(day FROM o_orderdate) AS STRING), 2, '0')"
MONTH = "lpad(CAST(extract(month FROM o_orderdate) AS STRING), 2, '0')"
YEAR = "CAST(extract(year FROM o_orderdate) AS STRING)"
MONTH_NAME = (
    "substr('JanFebMarAprMayJunJulAugSepOctNovDec', "
    "CAST(3 * extract(month FROM o_orderdate) - 2 AS INT), 3)"
)

WRITTEN_DATES = f"""
SELECT o_orderkey,
       CASE WHEN o_orderkey % 8 = 0 THEN {DAY} || '-' || {MONTH} || '-' || {YEAR}
            WHEN o_orderkey % 8 = 1 THEN {DAY} || '/' || {MONTH} || '/' || {YEAR}
            WHEN o_orderkey % 8 = 2 THEN {YEAR} || '-' || {MONTH} || '-' || {DAY}
            WHEN o_orderkey % 8 = 3 THEN {DAY} || ' ' || {MONTH_NAME} || ' ' || {YEAR}
            WHEN o_orderkey % 8 = 4 THEN {MONTH_NAME} || ' ' || {DAY} || ', ' || {YEAR}
            WHEN o_orderkey % 8 = 5 THEN {YEAR} || {MONTH} || {DAY}
            WHEN o_orderkey % 8 = 6 AND extract(day FROM o_orderdate) > 12
                 THEN {MONTH} || '/' || {DAY} || '/' || {YEAR}
            ELSE 'unknown' END AS order_date
FROM {{orders}}
"""
FORMATTED_DATES = f"""
SELECT o_orderkey,
       CASE WHEN o_orderkey % 8 < 6 OR (o_orderkey % 8 = 6 AND extract(day FROM o_orderdate) > 12)
            THEN {DAY} || '-' || {MONTH} || '-' || {YEAR} END AS order_date
FROM orders
"""

CONTACTS = """
SELECT c_custkey AS id,
       CASE WHEN c_custkey % 6 = 0 THEN '  ' || lower(c_mktsegment) || '   ' || upper(c_name) || ' '
            WHEN c_custkey % 6 = 1 THEN c_mktsegment || ' ' || c_name
            ELSE c_mktsegment || '  de  ' || c_name END AS "Customer Name",
       CASE WHEN c_custkey % 3 = 0 THEN '+91 98' || lpad(CAST(c_custkey AS STRING), 3, '0') || '-' || lpad(CAST(c_custkey AS STRING), 5, '0')
            WHEN c_custkey % 3 = 1 THEN '0' || lpad(CAST(c_custkey AS STRING), 10, '9')
            ELSE '(12) ' || CAST(c_custkey AS STRING) END AS "Mobile Number",
       ' ' || c_name || '@Mail.COM  ' AS "Email ID",
       CASE WHEN c_custkey % 5 = 0 THEN 'Y' WHEN c_custkey % 5 = 1 THEN ' no ' WHEN c_custkey % 5 = 2 THEN 'TRUE'
            WHEN c_custkey % 5 = 3 THEN 'haan'
            WHEN c_custkey % 10 = 4 THEN NULL ELSE '0' END AS "Active",
       CASE WHEN c_custkey % 4 = 0 THEN 'Rs. ' || CAST(abs(c_acctbal) AS STRING)
            WHEN c_custkey % 4 = 1 THEN '₹ ' || CAST(abs(c_acctbal) AS STRING)
            WHEN c_custkey % 4 = 2 THEN '(' || CAST(abs(c_acctbal) AS STRING) || ')'
            WHEN c_custkey % 12 = 3 THEN 'unknown'
            ELSE CAST(c_acctbal AS STRING) END AS "Salary",
       CASE WHEN c_custkey % 7 = 0 THEN '#N/A' WHEN c_custkey % 7 = 1 THEN ' #ref! '
            WHEN c_custkey % 7 = 2 THEN NULL ELSE c_mktsegment END AS "Segment",
       CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey % 90 + 10 AS STRING) || '.5E+3'
            WHEN c_custkey % 3 = 1 THEN CAST(c_custkey % 9 + 1 AS STRING) || '.25E-2'
            ELSE c_name END AS "Account",
       c_acctbal / 7 AS "Ratio"
FROM {customer}
"""
C = plain(CONTACTS)
REST = ["Customer Name", "Mobile Number", "Email ID", "Active", "Salary", "Segment", "Account", "Ratio"]


def fixed(spark: SparkSession, sf: str, fix_id: str, columns: list[str]) -> DataFrame:
    """Apply one fix to the contact sheet and keep the columns of interest."""
    sheet = derived(spark, sf, CONTACTS, "id").drop("id")
    out = fixes.apply_fix(sheet, fix_id)
    return out.select(F.col(ROW_ID).alias("id"), *[f"`{c}`" for c in columns])


def fixed_table(spark: SparkSession, sf: str, fix_id: str, name: str, key: str, columns: list[str]) -> DataFrame:
    out = fixes.apply_fix(table(spark, sf, name, key).select(ROW_ID, *columns), fix_id)
    return out.withColumnRenamed(ROW_ID, key)


def fix_remove_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    df = derived(spark, sf, REPEATED_EVENTS, "event_id").drop("event_id")
    return fixes.apply_fix(df, "remove_duplicates").withColumnRenamed(ROW_ID, "first_id")


def fix_clean_headers(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    return fixes.apply_fix(raw.toDF(" supplier   key", "full NAME ", "o'neil a-balance"), "clean_headers")


def fix_fill_blanks(spark: SparkSession, sf: str) -> DataFrame:
    return fixes.apply_fix(derived(spark, sf, MESSY_ORDERS, "o_orderkey"), "fill_blanks").drop(ROW_ID)


def fix_date_format(spark: SparkSession, sf: str) -> DataFrame:
    return fixes.apply_fix(derived(spark, sf, WRITTEN_DATES, "o_orderkey"), "date_format").drop(ROW_ID)


NAME_PARTS = """
SELECT c_custkey, '  ' || c_mktsegment || ' ' AS "First Name",
       CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_name END AS "Last Name" FROM {customer}
"""


def fix_merge_names(spark: SparkSession, sf: str) -> DataFrame:
    return fixes.apply_fix(derived(spark, sf, NAME_PARTS, "c_custkey"), "merge_name_columns").drop(ROW_ID)


ROWS_WITH_GAPS = """
SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS reading,
       CASE WHEN event_id % 2 = 0 THEN '   ' ELSE event_type END AS kind FROM {events}
"""


def fix_remove_empty_rows(spark: SparkSession, sf: str) -> DataFrame:
    df = derived(spark, sf, ROWS_WITH_GAPS, "id").drop("id")
    return fixes.apply_fix(df, "remove_empty_rows").withColumnRenamed(ROW_ID, "id")


def change_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Counts gathered by the actions that write the results anyway."""
    rows, cells = ChangeLog(), ChangeLog()
    df = derived(spark, sf, REPEATED_EVENTS, "event_id").drop("event_id")
    fixes.apply_fix(df, "remove_duplicates", rows).write.format("noop").mode("overwrite").save()
    sheet = derived(spark, sf, CONTACTS, "id").select(ROW_ID, "`Email ID`", "Segment")
    fixes.apply_fix(sheet, "remove_excel_errors", cells).write.format("noop").mode("overwrite").save()
    found = rows.counts()
    data = [(found["rows_before"], found["rows_removed"], cells.counts()["cells_changed"])]
    return spark.createDataFrame(data, "rows_before long, rows_removed long, cells_changed long")


def keyword_match(spark: SparkSession, sf: str) -> DataFrame:
    texts = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return match_fix(texts, "text").select("conv_id", "turn", "fix_id", "fix_label", F.col("fix_score").alias("score"))


def list_fixes(spark: SparkSession, sf: str) -> DataFrame:
    """The registered fixes, with the number of documents that ask for each."""
    asked = match_fix(table(spark, sf, "documents").select("text"), "text").groupBy("fix_id").agg(
        F.count("*").alias("documents")
    )
    known = fixes.list_fixes(spark)
    return known.join(asked, known["id"] == asked["fix_id"], "left").select(
        "position", "id", "label", F.coalesce("documents", F.lit(0)).alias("documents")
    )


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _score_sql(keywords: tuple[str, ...], text: str) -> str:
    return " + ".join(f"CASE WHEN contains({text}, {_text(k)}) THEN {keyword_weight(k)} ELSE 0 END" for k in keywords)


def _match_sql(source: str, keys: str) -> str:
    """The best fix of every text; earlier fixes win ties."""
    scores = ", ".join(f"{_score_sql(f.keywords, 't')} AS s{i}" for i, f in enumerate(fixes.REGISTRY))
    best = "greatest(" + ", ".join(f"s{i}" for i in range(len(fixes.REGISTRY))) + ")"
    pick = lambda field: "CASE WHEN score = 0 THEN NULL " + " ".join(
        f"WHEN s{i} = score THEN {_text(getattr(f, field))}" for i, f in enumerate(fixes.REGISTRY)
    ) + " END"
    return f"""SELECT {keys}, {pick('id')} AS fix_id, {pick('label')} AS fix_label, score
               FROM (SELECT *, {best} AS score FROM (SELECT {keys}, {scores}
                     FROM (SELECT {keys}, lower(text) AS t FROM {source})))"""


def _contact_sql(changed: dict[str, str], columns: list[str]) -> str:
    cells = ", ".join(f'{changed[c]} AS "{c}"' if c in changed else f'"{c}"' for c in columns)
    return f"SELECT id, {cells} FROM ({C})"


def _trim(c: str) -> str:
    return f"regexp_replace({c}, '^{SPACES}+|{SPACES}+$', '', 'g')"


def _title(c: str) -> str:
    return (
        f"list_aggregate(list_transform(regexp_extract_all(lower({c}), '\\p{{L}}+|[^\\p{{L}}]+'),"
        " lambda x: replace(upper(x[1]), 'ẞ', 'Ss') || x[2:]), 'string_agg', '')"
    )


SALARY = """CASE WHEN id % 4 IN (0, 1) THEN CAST(regexp_extract("Salary", '[0-9][0-9.]*') AS DOUBLE)
                 WHEN id % 4 = 2 THEN -CAST(regexp_extract("Salary", '[0-9][0-9.]*') AS DOUBLE)
                 ELSE TRY_CAST("Salary" AS DOUBLE) END"""
YES = "('yes', 'y', 'true', '1', 'haan', 'ha')"
NO = "('no', 'n', 'false', '0', 'nahi', 'nahin')"
ERRORS = "('" + "', '".join(fixes.ERROR_TOKENS) + "')"

QUERIES = {
    "fix_remove_duplicates": Query(
        fix_remove_duplicates,
        f"SELECT user_id, event_type, min(event_id) AS first_id FROM ({plain(REPEATED_EVENTS)}) GROUP BY ALL",
    ),
    "fix_trim_spaces": Query(
        partial(fixed_table, fix_id="trim_spaces", name="documents", key="doc_id", columns=["text", "source"]),
        f"""SELECT doc_id, regexp_replace({_trim('text')}, '{SPACES}+', ' ', 'g') AS text, source FROM documents""",
    ),
    "fix_clean_currency": Query(
        partial(fixed, fix_id="clean_currency", columns=["Salary", "Mobile Number"]),
        _contact_sql({"Salary": SALARY}, ["Salary", "Mobile Number"]),
    ),
    "fix_date_format": Query(fix_date_format, FORMATTED_DATES),
    "fix_capitalize_text": Query(
        partial(fixed_table, fix_id="capitalize_text", name="documents", key="doc_id", columns=["text", "lang"]),
        f"SELECT doc_id, {_title(_trim('text'))} AS text, {_title('lang')} AS lang FROM documents",
    ),
    "fix_clean_headers": Query(
        fix_clean_headers,
        """SELECT s_suppkey AS "Supplier Key", s_name AS "Full Name", s_acctbal AS "O'Neil A-Balance" FROM supplier""",
    ),
    "fix_fill_blanks": Query(
        fix_fill_blanks,
        f"""SELECT o_orderkey, o_custkey, coalesce(CAST(price AS VARCHAR), 'N/A') AS price,
                   coalesce(nullif(nullif(priority, ''), '  '), 'N/A') AS priority, coalesce(status, 'N/A') AS status,
                   coalesce(nullif(remark, ''), 'N/A') AS remark, coalesce(CAST(grade AS VARCHAR), 'N/A') AS grade
            FROM ({plain(MESSY_ORDERS)})""",
    ),
    "fix_remove_special_chars": Query(
        partial(fixed_table, fix_id="remove_special_chars", name="documents", key="doc_id", columns=["text"]),
        r"""SELECT doc_id, regexp_replace(text, '[^\p{L}\p{N}_\t\n\x0b\f\r \x{85}\p{Z}.,@\-]', '', 'g') AS text
            FROM documents""",
    ),
    "fix_remove_excel_errors": Query(
        partial(fixed, fix_id="remove_excel_errors", columns=["Segment", "Active"]),
        _contact_sql(
            {"Segment": f"""CASE WHEN upper(trim("Segment")) IN {ERRORS} THEN NULL ELSE "Segment" END"""},
            ["Segment", "Active"],
        ),
    ),
    "fix_accounting_negatives": Query(
        partial(fixed, fix_id="accounting_negatives", columns=["Salary"]),
        _contact_sql(
            {"Salary": """CASE WHEN id % 4 = 2 THEN CAST(-CAST(regexp_extract("Salary", '[0-9][0-9.]*') AS DOUBLE) AS VARCHAR)
                               ELSE trim("Salary") END"""},
            ["Salary"],
        ),
    ),
    "fix_split_full_name": Query(
        partial(fixed, fix_id="split_full_name", columns=["Customer Name", "First Name", "Last Name"]),
        f"""SELECT id, "Customer Name", regexp_extract(trim("Customer Name"), '^\\S+') AS "First Name",
                   regexp_replace(trim("Customer Name"), '^\\S+\\s*', '') AS "Last Name" FROM ({C})""",
    ),
    "fix_merge_name_columns": Query(
        fix_merge_names,
        f"""SELECT *, trim(trim("First Name") || ' ' || trim(coalesce("Last Name", ''))) AS "Full Name"
            FROM ({plain(NAME_PARTS)})""",
    ),
    "fix_standardize_phone": Query(
        partial(fixed, fix_id="standardize_phone", columns=["Mobile Number"]),
        _contact_sql({"Mobile Number": """right(regexp_replace("Mobile Number", '\\D', '', 'g'), 10)"""}, ["Mobile Number"]),
    ),
    "fix_standardize_email": Query(
        partial(fixed, fix_id="standardize_email", columns=["Email ID"]),
        _contact_sql({"Email ID": 'lower(trim("Email ID"))'}, ["Email ID"]),
    ),
    "fix_remove_empty_rows": Query(
        fix_remove_empty_rows,
        f"SELECT * FROM ({plain(ROWS_WITH_GAPS)}) WHERE reading IS NOT NULL OR trim(kind) <> ''",
    ),
    "fix_scientific_notation": Query(
        partial(fixed, fix_id="scientific_notation", columns=["Account"]),
        _contact_sql(
            {"Account": """CASE WHEN id % 3 = 0 THEN CAST(CAST(CAST("Account" AS DOUBLE) AS BIGINT) AS VARCHAR)
                                WHEN id % 3 = 1 THEN CAST(CAST("Account" AS DOUBLE) AS VARCHAR) ELSE "Account" END"""},
            ["Account"],
        ),
    ),
    "fix_round_numbers": Query(
        partial(fixed, fix_id="round_numbers", columns=["Ratio"]),
        _contact_sql({"Ratio": 'CAST(round_even("Ratio" * 100, 0) AS DOUBLE) / 100'}, ["Ratio"]),
    ),
    "fix_standardize_yesno": Query(
        partial(fixed, fix_id="standardize_yesno", columns=["Active", "Segment"]),
        _contact_sql(
            {"Active": f"""CASE WHEN lower(trim("Active")) IN {YES} THEN 'Yes'
                                WHEN lower(trim("Active")) IN {NO} THEN 'No' ELSE "Active" END"""},
            ["Active", "Segment"],
        ),
    ),
    "change_metrics": Query(
        change_metrics,
        f"""SELECT (SELECT count(*) FROM events) AS rows_before,
                   (SELECT count(*) FROM events) - (SELECT count(*) FROM
                     (SELECT DISTINCT user_id, event_type FROM ({plain(REPEATED_EVENTS)}))) AS rows_removed,
                   (SELECT count(*) FROM ({C}) WHERE upper(trim("Segment")) IN {ERRORS}) AS cells_changed""",
    ),
    "keyword_match": Query(keyword_match, _match_sql("conversations", "conv_id, turn")),
    "list_fixes": Query(
        list_fixes,
        f"""WITH asked AS (SELECT fix_id, count(*) AS n FROM ({_match_sql('documents', 'doc_id')}) GROUP BY fix_id)
            SELECT position, id, label, coalesce(n, 0) AS documents FROM (VALUES
              {', '.join(f'({i}, {_text(f.id)}, {_text(f.label)})' for i, f in enumerate(fixes.REGISTRY))}
            ) AS f(position, id, label) LEFT JOIN asked ON id = fix_id""",
    ),
}
