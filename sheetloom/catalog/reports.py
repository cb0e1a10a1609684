"""Missing values, anomalies, quality, near duplicates and rate limits."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetloom.catalog.inputs import MESSY_ORDERS, Query, derived, plain, table
from sheetloom.operators import anomalies, limits, missing, quality, similarity
from sheetloom.rows import ROW_ID
from sheetloom.session import scratch_path
from sheetloom.streaming import fixes as stream_fixes
from sheetloom.streaming.limits import admit_stream, admitted_events, count_stream, run_admission

MESSY = plain(MESSY_ORDERS)
COLUMNS = {  # name: (type, test for missing)
    "o_orderkey": ("bigint", "o_orderkey IS NULL"),
    "o_custkey": ("bigint", "o_custkey IS NULL"),
    "price": ("double", "price IS NULL"),
    "priority": ("string", "(priority IS NULL OR trim(priority) = '')"),
    "status": ("string", "status IS NULL"),
    "remark": ("string", "(remark IS NULL OR trim(remark) = '')"),
    "grade": ("bigint", "grade IS NULL"),
}


def _messy(spark: SparkSession, sf: str) -> DataFrame:
    return derived(spark, sf, MESSY_ORDERS, "o_orderkey")


# -- missing values --------------------------------------------------------


def _report_sql() -> str:
    lines = []
    for i, (name, (kind, test)) in enumerate(COLUMNS.items()):
        numeric = kind != "string"
        count = f"count(*) FILTER (WHERE {test})"
        method = "median" if numeric else "mode"
        lines.append(
            f"""SELECT {i} AS position, '{name}' AS "column", '{kind}' AS dtype, {str(numeric).lower()} AS is_numeric,
                       {count} AS missing_count,
                       CAST(round_even({count} * 100.0 / count(*) * 10, 0) AS DOUBLE) / 10 AS missing_pct,
                       CASE WHEN {count} > 0 THEN '{method}' END AS suggested_method FROM messy"""
        )
    return f"WITH messy AS ({MESSY}) " + " UNION ALL ".join(lines)


def missing_report(spark: SparkSession, sf: str) -> DataFrame:
    return missing.missing_report(_messy(spark, sf))


def missing_totals(spark: SparkSession, sf: str) -> DataFrame:
    return missing.missing_totals(_messy(spark, sf))


def top_missing(spark: SparkSession, sf: str) -> DataFrame:
    return missing.top_missing(_messy(spark, sf), 10)


def fill(spark: SparkSession, sf: str, strategies: dict, rounded: str | None = None) -> DataFrame:
    out = missing.fill_missing(_messy(spark, sf), strategies).drop(ROW_ID)
    return out.withColumn(rounded, F.round(rounded, 4)) if rounded else out


def _fill_sql(**changed: str) -> str:
    cells = [f"{changed[c]} AS {c}" if c in changed else c for c in COLUMNS]
    return f"WITH messy AS ({MESSY}) SELECT {', '.join(cells)} FROM messy"


def _mode_sql(column: str, test: str) -> str:
    return f"(SELECT {column} FROM messy WHERE NOT {test} GROUP BY {column} ORDER BY count(*) DESC, {column} LIMIT 1)"


def fill_nothing_to_go_by(spark: SparkSession, sf: str) -> DataFrame:
    """A column without any value has no mean and no median, and stays as it is."""
    events = table(spark, sf, "events", "event_id").select(ROW_ID, "event_id", F.lit(None).cast("double").alias("blank"), "user_id")
    once = missing.fill_missing(events, {"blank": {"method": "mean"}, "user_id": {"method": "mode"}})
    return missing.fill_missing(once, {"blank": {"method": "median"}}).drop(ROW_ID)


FILL_IN_ORDER = {
    "price": {"method": "drop_rows"},
    "status": {"method": "constant", "value": "?"},
    "grade": {"method": "median"},
    "no such column": {"method": "mean"},
    "remark": {"method": "no such method"},
    "priority": {"method": "mode"},
}

# -- anomalies -------------------------------------------------------------

# a few values a thousand times too large, and text that is no number
SPIKED_EVENTS = """
SELECT event_id, CASE WHEN event_id % 97 = 5 THEN 'n/a'
                      WHEN event_id % 211 = 7 THEN CAST(value * 1000 AS STRING)
                      ELSE CAST(value AS STRING) END AS reading
FROM {events}
"""
FLAT_EVENTS = """
SELECT event_id, CASE WHEN event_id % 101 = 3 THEN 10.0 + event_id % 7 ELSE 10.0 END AS reading FROM {events}
"""


def anomaly_rows(spark: SparkSession, sf: str, sql: str) -> DataFrame:
    found = anomalies.detect_anomalies(derived(spark, sf, sql, "event_id"), "reading")
    return found.withColumnRenamed(ROW_ID, "event_id")


def _anomaly_sql(source: str) -> str:
    return f"""
    WITH n AS (SELECT event_id, TRY_CAST(reading AS DOUBLE) AS v FROM ({plain(source)})),
    m AS (SELECT median(v) AS med FROM n WHERE v IS NOT NULL),
    d AS (SELECT median(abs(v - med)) AS mad, avg(abs(v - med)) AS dev FROM n, m WHERE v IS NOT NULL),
    z AS (SELECT event_id, v, CASE WHEN mad = 0 THEN abs(v - med) / CASE WHEN dev = 0 THEN 1.0 ELSE dev END
                                   ELSE abs(0.6745 * (v - med) / mad) END AS score FROM n, m, d WHERE v IS NOT NULL)
    SELECT event_id, 'reading' AS "column", v AS value, CAST(round_even(score * 100, 0) AS DOUBLE) / 100 AS anomaly_score
    FROM z WHERE score > 3.5"""


# -- quality ---------------------------------------------------------------

# repeated rows, blanks, outliers and one mixed column
ROUGH_EVENTS = """
SELECT event_id, user_id % 40 AS grp, event_type AS kind,
       CASE WHEN event_id % 2 = 0 THEN event_type ELSE CAST(user_id % 10 AS STRING) END AS mixed,
       CASE WHEN event_id % 50 = 0 THEN NULL ELSE CASE WHEN event_id % 1000 = 7 THEN 99999.0 ELSE 1.0 * (user_id % 7) END END AS reading
FROM {events}
"""


def quality_report(spark: SparkSession, sf: str) -> DataFrame:
    df = derived(spark, sf, ROUGH_EVENTS, "event_id").drop("event_id")
    return quality.quality_report(df).to_frame(spark).drop("issues")


QUALITY_SQL = f"""
WITH q AS (SELECT grp, kind, mixed, reading FROM ({plain(ROUGH_EVENTS)})),
t AS (SELECT count(*) AS n, count(*) FILTER (WHERE reading IS NULL) AS missing FROM q),
d AS (SELECT (SELECT n FROM t) - (SELECT count(*) FROM (SELECT DISTINCT * FROM q)) AS dup),
v AS (SELECT 'grp' AS c, CAST(grp AS DOUBLE) AS x FROM q UNION ALL SELECT 'reading', reading FROM q WHERE reading IS NOT NULL),
m AS (SELECT c, median(x) AS med FROM v GROUP BY c),
e AS (SELECT v.c, median(abs(x - med)) AS mad, avg(abs(x - med)) AS dev FROM v JOIN m USING (c) GROUP BY v.c),
a AS (SELECT count(*) AS anomalies FROM v JOIN m USING (c) JOIN e USING (c)
      WHERE CASE WHEN mad = 0 THEN abs(x - med) / CASE WHEN dev = 0 THEN 1.0 ELSE dev END
                 ELSE abs(0.6745 * (x - med) / mad) END > 3.5),
p AS (SELECT n, missing, dup, anomalies, round(missing * 100.0 / (n * 4), 1) AS mp, round(dup * 100.0 / n, 1) AS dp
      FROM t, d, a),
s AS (SELECT *, CAST(greatest(0, round_even(100 - least(30, mp * 1.5) - least(25, dp * 2) - least(20, anomalies * 0.8) - 5, 0))
                     AS INTEGER) AS score FROM p)
SELECT score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C'
                   WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade,
       n AS total_rows, 4 AS total_columns, missing AS total_missing_cells, dup AS duplicate_rows, anomalies,
       1 AS mixed_columns FROM s
"""


def quality_issues(spark: SparkSession, sf: str) -> DataFrame:
    """The findings behind the score, a row each."""
    df = derived(spark, sf, ROUGH_EVENTS, "event_id").drop("event_id")
    return quality.quality_report(df).issues_frame(spark)


ISSUES_SQL = f"""
WITH f AS (SELECT *, round(total_missing_cells * 100.0 / (total_rows * total_columns), 1) AS mp,
                  round(duplicate_rows * 100.0 / total_rows, 1) AS dp FROM ({QUALITY_SQL}))
SELECT 'missing_values' AS type, CASE WHEN mp > 15 THEN 'high' ELSE 'medium' END AS severity,
       total_missing_cells || ' cells are blank (~' || CAST(mp AS DOUBLE) || '% of the table).' AS message FROM f
WHERE total_missing_cells > 0
UNION ALL SELECT 'duplicate_rows', CASE WHEN dp > 10 THEN 'high' ELSE 'medium' END,
       duplicate_rows || ' rows repeat an earlier row exactly (~' || CAST(dp AS DOUBLE) || '%).' FROM f WHERE duplicate_rows > 0
UNION ALL SELECT 'anomalies', 'medium', anomalies || ' unusual numbers in 1 column(s).' FROM f WHERE anomalies > 0
UNION ALL SELECT 'mixed_types', 'low', 'Numbers and text are mixed in: mixed.' FROM f
"""


def mixed_type_columns(spark: SparkSession, sf: str) -> DataFrame:
    df = derived(spark, sf, ROUGH_EVENTS, "event_id").drop("event_id")
    out = quality.mixed_type_columns(df)
    return out.select("column", "cells", F.round("numeric_share", 6).alias("numeric_share"))


# -- near duplicates -------------------------------------------------------


def fuzzy_pairs(spark: SparkSession, sf: str) -> DataFrame:
    found = similarity.similar_pairs(table(spark, sf, "part", "p_partkey"), ["p_name"])
    return found.select("left_row_id", "right_row_id", F.round("score", 4).alias("score"))


def fuzzy_pairs_low(spark: SparkSession, sf: str) -> DataFrame:
    """A threshold at which no chunk of a text is sure to survive."""
    found = similarity.similar_pairs(table(spark, sf, "part", "p_partkey"), ["p_name"], threshold=60)
    return found.select("left_row_id", "right_row_id", F.round("score", 4).alias("score"))


def fuzzy_groups_sorted(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of equal and similar part names, largest first."""
    return similarity.ordered_groups(similarity.similar_groups(table(spark, sf, "part", "p_partkey"), ["p_name"]))


def fuzzy_members(spark: SparkSession, sf: str) -> DataFrame:
    """The rows behind the ids of `fuzzy_pairs`."""
    return similarity.text_members(table(spark, sf, "part", "p_partkey"), ["p_name"])


def fuzzy_groups(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.similar_groups(table(spark, sf, "pages", "page_id"), ["url"])


def fuzzy_groups_parts(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.similar_groups(table(spark, sf, "part", "p_partkey"), ["p_name", "p_brand"])


def _lcs_sql(a: str, b: str) -> str:
    """Bit-parallel LCS over 128-bit integers; ``a`` must not exceed 120 letters."""
    full = f"((CAST(1 AS HUGEINT) << length({a})) - 1)"
    mask = (
        f"list_sum(list_transform(range(1, length({a}) + 1), lambda i: CASE WHEN substr({a}, i, 1) = substr({b}, j, 1)"
        " THEN CAST(1 AS HUGEINT) << CAST(i - 1 AS INTEGER) ELSE CAST(0 AS HUGEINT) END))"
    )
    masks = f"list_transform(range(1, length({b}) + 1), lambda j: CAST({mask} AS HUGEINT))"
    step = f"lambda v, m: ((v + (v & m)) | (v & (~m))) & {full}"
    return f"(length({a}) - bit_count(list_reduce(list_prepend({full}, {masks}), {step})))"


def _texts_sql(source: str, key: str, text: str) -> str:
    words = f"array_to_string(list_sort(string_split_regex(trim(lower({text})), '\\s+')), ' ')"
    return f"""t AS (SELECT {key} AS id, {words} AS s FROM {source}),
               r AS (SELECT s, min(id) AS id FROM t GROUP BY s)"""


def _pairs_sql(source: str, key: str, text: str, least: int = 87) -> str:
    return f"""
    WITH {_texts_sql(source, key, text)},
    p AS (SELECT a.id AS l, b.id AS r, {_lcs_sql('a.s', 'b.s')} AS lcs, length(a.s) + length(b.s) AS total
          FROM r a JOIN r b ON a.id < b.id AND 200 * least(length(a.s), length(b.s)) >= {least} * (length(a.s) + length(b.s)))
    SELECT l AS left_row_id, r AS right_row_id, round(200.0 * lcs / total, 4) AS score FROM p WHERE 200 * lcs >= {least} * total"""


def _groups_sql(source: str, key: str, text: str) -> str:
    return f"""
    WITH RECURSIVE {_texts_sql(source, key, text)},
    e AS (SELECT a.id AS u, b.id AS v
          FROM r a JOIN r b ON a.id < b.id AND 200 * least(length(a.s), length(b.s)) >= 87 * (length(a.s) + length(b.s))
          WHERE 200 * {_lcs_sql('a.s', 'b.s')} >= 87 * (length(a.s) + length(b.s))),
    both_ways AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
    reach AS (SELECT id AS node, id AS root FROM r
              UNION SELECT b.v, reach.root FROM reach JOIN both_ways b ON b.u = reach.node),
    c AS (SELECT node, min(root) AS g FROM reach GROUP BY node),
    m AS (SELECT t.id, c.g FROM t JOIN r USING (s) JOIN c ON c.node = r.id)
    SELECT g AS group_id, g AS keep_row_id, id AS row_id, count(*) OVER (PARTITION BY g) AS group_size FROM m
    QUALIFY group_size > 1"""


# -- rate limits -----------------------------------------------------------

LIMIT = {"max_requests": 3, "window_seconds": 86_400}


def rate_limit_batch(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    out = limits.rate_limit(events, ["user_id"], "ts", "event_id", **LIMIT)
    return out.select("event_id", "user_id", "window_start", "allowed")


def rate_limit_admitted(spark: SparkSession, sf: str) -> DataFrame:
    out = limits.admitted(table(spark, sf, "events"), ["event_type"], "ts", "event_id", 2, 3_600)
    return out.select("event_id", "event_type", "window_start")


def rate_limit_usage(spark: SparkSession, sf: str) -> DataFrame:
    return limits.window_usage(table(spark, sf, "events"), ["user_id"], "ts", **LIMIT)


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    schema = table(spark, sf, name).schema
    # a pattern, since a stream takes no path of a single file; it holds for a folder of files as well
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


def _run(spark: SparkSession, stream: DataFrame, label: str) -> DataFrame:
    path = scratch_path(spark, label)
    stream_fixes.run_available(stream, path, scratch_path(spark, f"{label}-checkpoint"))
    return spark.read.schema(stream.schema).parquet(path)


def rate_limit_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Events admitted one by one on a stream, then summed per user and window."""
    admitted = _run(spark, admit_stream(_stream(spark, sf, "events"), ["user_id"], "ts", **LIMIT), "admitted")
    return admitted.groupBy("user_id", "window_start").agg(
        F.count("*").alias("events"),
        F.count_if("allowed").alias("allowed"),
        F.count_if(~F.col("allowed")).alias("refused"),
    )


def rate_limit_stream_events(spark: SparkSession, sf: str) -> DataFrame:
    """The events that pass on a stream, by time and id as in the table form; the stream is ended, so all windows close."""
    root = scratch_path(spark, "admission")
    run_admission(_stream(spark, sf, "events"), ["user_id"], "ts", "event_id", **LIMIT, root=root, close=True)
    return admitted_events(spark, root, "ts", "event_id", LIMIT["max_requests"]).select("event_id", "user_id", "window_start")


def rate_limit_stream_closed(spark: SparkSession, sf: str) -> DataFrame:
    """Closed windows of a watermarked count; the newest windows stay open."""
    counts = count_stream(_stream(spark, sf, "events"), ["user_id"], "ts", **LIMIT)
    return _run(spark, counts, "counted")


def stream_cleaning(spark: SparkSession, sf: str) -> DataFrame:
    """Row-wise fixes on a stream of conversation turns."""
    turns = _stream(spark, sf, "conversations")
    return _run(spark, stream_fixes.apply_fixes(turns, ["trim_spaces", "remove_special_chars"]), "turns")


WINDOW = "CAST(floor(epoch_us(ts) / {us}) * {s} AS BIGINT)"
DAY_WINDOW = WINDOW.format(us=86_400_000_000, s=86_400)
HOUR_WINDOW = WINDOW.format(us=3_600_000_000, s=3_600)
USAGE = f"""SELECT user_id, {DAY_WINDOW} AS window_start, count(*) AS events, least(count(*), 3) AS allowed,
                   count(*) - least(count(*), 3) AS refused FROM events GROUP BY 1, 2"""
CLOSED = f"""SELECT * FROM ({USAGE})
             WHERE window_start + 86400 <= (SELECT floor(epoch_us(max(ts)) / 1000000) - 600 FROM events)"""
SPACES = r"[\t\n\x0b\f\r \x{85}\p{Z}]"

QUERIES = {
    "missing_report": Query(missing_report, _report_sql()),
    "missing_totals": Query(
        missing_totals,
        f"""SELECT count(*) AS total_rows, {' + '.join(f'count(*) FILTER (WHERE {t})' for _, t in COLUMNS.values())}
            AS total_missing_cells FROM ({MESSY})""",
    ),
    "top_missing": Query(top_missing, f"SELECT * FROM ({_report_sql()}) WHERE missing_count > 0"),
    "fill_mean": Query(
        partial(fill, strategies={"price": {"method": "mean"}}, rounded="price"),
        _fill_sql(price="round(coalesce(price, (SELECT avg(price) FROM messy)), 4)"),
    ),
    "fill_median": Query(
        partial(fill, strategies={"price": {"method": "median"}}),
        _fill_sql(price="coalesce(price, (SELECT median(price) FROM messy))"),
    ),
    "fill_mode": Query(
        partial(fill, strategies={"priority": {"method": "mode"}, "grade": {"method": "mode"}}),
        _fill_sql(
            priority=f"CASE WHEN {COLUMNS['priority'][1]} THEN {_mode_sql('priority', COLUMNS['priority'][1])} ELSE priority END",
            grade=f"coalesce(grade, {_mode_sql('grade', 'grade IS NULL')})",
        ),
    ),
    "fill_constant": Query(
        partial(fill, strategies={"status": {"method": "constant", "value": "none"},
                                  "grade": {"method": "constant", "value": "absent"}}),
        _fill_sql(status="coalesce(status, 'none')", grade="coalesce(CAST(grade AS VARCHAR), 'absent')"),
    ),
    "fill_drop_rows": Query(
        partial(fill, strategies={"priority": {"method": "drop_rows"}, "grade": {"method": "drop_rows"}}),
        _fill_sql() + f" WHERE NOT {COLUMNS['priority'][1]} AND grade IS NOT NULL",
    ),
    "fill_nothing_to_go_by": Query(
        fill_nothing_to_go_by,
        "SELECT event_id, CAST(NULL AS DOUBLE) AS blank, user_id FROM events",
    ),
    "fill_in_order": Query(
        partial(fill, strategies=FILL_IN_ORDER),
        f"""WITH messy AS (SELECT * FROM ({MESSY}) WHERE price IS NOT NULL)
            SELECT o_orderkey, o_custkey, price,
                   CASE WHEN {COLUMNS['priority'][1]} THEN {_mode_sql('priority', COLUMNS['priority'][1])} ELSE priority END
                     AS priority,
                   coalesce(status, '?') AS status, remark,
                   coalesce(CAST(grade AS DOUBLE), (SELECT median(grade) FROM messy)) AS grade FROM messy""",
    ),
    "anomalies_mad": Query(partial(anomaly_rows, sql=SPIKED_EVENTS), _anomaly_sql(SPIKED_EVENTS)),
    "anomalies_mad_zero": Query(partial(anomaly_rows, sql=FLAT_EVENTS), _anomaly_sql(FLAT_EVENTS)),
    "quality_report": Query(quality_report, QUALITY_SQL),
    "quality_issues": Query(quality_issues, ISSUES_SQL),
    "mixed_type_columns": Query(
        mixed_type_columns,
        f"""SELECT 'mixed' AS "column", count(*) AS cells,
                   round(avg(CASE WHEN regexp_full_match(mixed, '\\s*-?\\d+(\\.\\d+)?\\s*') THEN 1.0 ELSE 0.0 END), 6)
                     AS numeric_share FROM ({plain(ROUGH_EVENTS)}) WHERE trim(mixed) <> ''""",
    ),
    "fuzzy_pairs": Query(fuzzy_pairs, _pairs_sql("part", "p_partkey", "p_name")),
    "fuzzy_pairs_low": Query(fuzzy_pairs_low, _pairs_sql("part", "p_partkey", "p_name", 60)),
    "fuzzy_groups_sorted": Query(fuzzy_groups_sorted, _groups_sql("part", "p_partkey", "p_name")),
    "fuzzy_members": Query(
        fuzzy_members,
        r"""SELECT p_partkey AS row_id, MIN(p_partkey) OVER (
                     PARTITION BY array_to_string(list_sort(regexp_split_to_array(trim(lower(COALESCE(p_name, ''))), '\s+')), ' ')) AS representative
            FROM part""",
    ),
    "fuzzy_groups": Query(fuzzy_groups, _groups_sql("pages", "page_id", "url")),
    "fuzzy_groups_parts": Query(fuzzy_groups_parts),
    "rate_limit_batch": Query(
        rate_limit_batch,
        f"""SELECT event_id, user_id, {DAY_WINDOW} AS window_start,
                   row_number() OVER (PARTITION BY user_id, {DAY_WINDOW} ORDER BY ts, event_id) <= 3 AS allowed FROM events""",
    ),
    "rate_limit_admitted": Query(
        rate_limit_admitted,
        f"""SELECT event_id, event_type, {HOUR_WINDOW} AS window_start FROM events
            QUALIFY row_number() OVER (PARTITION BY event_type, {HOUR_WINDOW} ORDER BY ts, event_id) <= 2""",
    ),
    "rate_limit_usage": Query(rate_limit_usage, USAGE),
    "rate_limit_stream": Query(rate_limit_stream, USAGE),
    "rate_limit_stream_events": Query(
        rate_limit_stream_events,
        f"""SELECT event_id, user_id, {DAY_WINDOW} AS window_start FROM events
            QUALIFY row_number() OVER (PARTITION BY user_id, {DAY_WINDOW} ORDER BY ts, event_id) <= 3""",
    ),
    "rate_limit_stream_closed": Query(rate_limit_stream_closed, CLOSED),
    "stream_cleaning": Query(
        stream_cleaning,
        rf"""SELECT conv_id, turn, role, regexp_replace(
               regexp_replace(regexp_replace(text, '^{SPACES}+|{SPACES}+$', '', 'g'), '{SPACES}+', ' ', 'g'),
               '[^\p{{L}}\p{{N}}_\t\n\x0b\f\r \x{{85}}\p{{Z}}.,@\-]', '', 'g') AS text FROM conversations""",
    ),
}
