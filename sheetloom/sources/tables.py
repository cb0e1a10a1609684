"""Table readers and writers.

A table read here has trimmed headers, NaN turned into NULL, and ``_row_id``
in file order.
"""

from __future__ import annotations

import csv
import io
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetloom.rows import ROW_ID, col, data_columns, denan, require_row_id
from sheetloom.session import materialize

# Delimiters tried, bytes looked at, cells read as blank.
DELIMITERS = ",;\t|"
SAMPLE_BYTES = 4096
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
TRUE_TOKENS = ("True", "TRUE", "true")
FALSE_TOKENS = ("False", "FALSE", "false")
INTEGER_TEXT = r"^\s*[+-]?\d+\s*$"
DECIMAL_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
BYTE_ORDER_MARK = "﻿"
ROW_BITS = 40
ID_BITS = 63
TASK_ROW_BITS = 33  # of a running id, below the task's number


def normalize_headers(names: list[str]) -> list[str]:
    """Trim; name the blank ones by position; number the repeated ones."""
    trimmed = [n.strip() or f"column_{i}" for i, n in enumerate(map(str, names))]
    seen: dict[str, int] = {}
    out: list[str] = []
    for name in trimmed:
        unique = name
        while unique in out:
            seen[name] = seen.get(name, 0) + 1
            unique = f"{name}.{seen[name]}"
        out.append(unique)
    return out


def normalize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*normalize_headers(df.columns))


def detect_delimiter(sample: str) -> str:
    """One of comma, semicolon, tab, pipe; comma if nothing points elsewhere."""
    try:
        return csv.Sniffer().sniff(sample, delimiters=DELIMITERS).delimiter
    except csv.Error:
        return ","


def _head(spark: SparkSession, path: str) -> str:
    """The first lines of the file, about as many as the sample needs."""
    lines, size = [], 0
    for row in spark.read.text(path).take(200):
        lines.append(row["value"])
        size += len(row["value"].encode()) + 1
        if size >= SAMPLE_BYTES:
            break
    return "\n".join(lines).removeprefix(BYTE_ORDER_MARK)


def read_delimited(
    spark: SparkSession,
    path: str,
    delimiter: str | None = None,
    na_tokens: tuple[str, ...] = NA_TOKENS,
    multi_line: bool = False,
) -> DataFrame:
    """Read a .csv file: find the delimiter, read text, type it in one profile pass.

    ``multi_line`` allows line breaks inside quotes, at the price of reading
    each file in one task; leave it off unless the data needs it.
    """
    head = _head(spark, path)
    if not head.strip():
        raise ValueError(f"{path} is empty")
    sep = delimiter or detect_delimiter(head.encode()[:SAMPLE_BYTES].decode(errors="ignore"))
    names = normalize_headers(next(csv.reader(io.StringIO(head), delimiter=sep)))
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = (
        spark.read.schema(schema)
        .options(header=True, sep=sep, quote='"', escape='"', multiLine=multi_line)
        .csv(path)
    )
    raw = _number_rows(raw)
    blank = {n: F.when(~col(n).isin(*na_tokens), col(n)) for n in names}
    cells = raw.withColumns(blank)
    return _typed(cells, names)


def _typed(cells: DataFrame, names: list[str]) -> DataFrame:
    """Integer, decimal or boolean columns where every filled cell agrees."""
    aggs: list[Column] = []
    for i, n in enumerate(names):
        c = col(n)
        aggs += [
            F.count(c).alias(f"filled{i}"),
            F.count_if(c.rlike(INTEGER_TEXT) & F.trim(c).try_cast("bigint").isNotNull()).alias(f"whole{i}"),
            F.count_if(c.rlike(DECIMAL_TEXT)).alias(f"number{i}"),
            F.count_if(c.isin(*TRUE_TOKENS, *FALSE_TOKENS)).alias(f"flag{i}"),
        ]
    found = cells.agg(*aggs).first()
    typed = {}
    for i, n in enumerate(names):
        filled, c = found[f"filled{i}"], F.trim(col(n))
        if not filled:
            continue
        if found[f"whole{i}"] == filled:
            typed[n] = c.try_cast("bigint")
        elif found[f"number{i}"] == filled:
            typed[n] = c.try_cast("double")
        elif found[f"flag{i}"] == filled:
            typed[n] = col(n).isin(*TRUE_TOKENS)
            typed[n] = F.when(col(n).isNotNull(), typed[n])
    return cells.withColumns(typed) if typed else cells


def _number_rows(df: DataFrame) -> DataFrame:
    """``_row_id`` by file and by position in the file.

    Within one file, splits are handed to tasks in file order, so the running
    id follows it; several files are put in name order by the high bits.  Where
    file, task and row take too many bits, rows are numbered without gaps.
    """
    files = sorted(df.inputFiles())
    running = F.monotonically_increasing_id()
    if len(files) <= 1:
        return df.withColumn(ROW_ID, running)
    task_bits = max(1, (df.rdd.getNumPartitions() - 1).bit_length())
    file_bits = (len(files) - 1).bit_length()
    df = df.select("*", F.col("_metadata.file_path").alias("__path"), running.alias(ROW_ID))
    if task_bits + TASK_ROW_BITS + file_bits > ID_BITS:
        return _number_densely(df)
    return _join_file_number(df, files, task_bits + TASK_ROW_BITS)


def _number_densely(df: DataFrame) -> DataFrame:
    """``_row_id`` 0, 1, 2, ... by file name (``__path``) and by the running id in ``_row_id``.

    The rows are written once, so that numbers and rows are of one scan.  A
    segment is what one task read of one file; the rows before it are summed
    over the segments alone, of which there are no more than files and splits.
    """
    written = materialize(df.withColumn("__task", F.shiftright(col(ROW_ID), TASK_ROW_BITS)), "numbered")
    segments = written.groupBy("__path", "__task").agg(F.min(ROW_ID).alias("__first"), F.count("*").alias("__rows"))
    earlier = Window.orderBy("__path", "__task").rowsBetween(Window.unboundedPreceding, -1)
    starts = segments.select("__path", "__task", "__first", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__start"))
    numbered = written.join(starts, ["__path", "__task"]).withColumn(ROW_ID, F.col("__start") + col(ROW_ID) - F.col("__first"))
    return numbered.select(*[col(c) for c in df.columns if c != "__path"])


def _join_file_number(df: DataFrame, files: list[str], shift: int) -> DataFrame:
    # local paths come with one slash or three
    numbered = [(i, re.sub(r"^file:/+", "file:/", f)) for i, f in enumerate(files)]
    df = df.withColumn("__path", F.regexp_replace("__path", "^file:/+", "file:/"))
    order = df.sparkSession.createDataFrame(numbered, "__file long, __file_path string")
    unknown = F.raise_error(F.concat(F.lit("file not in listing: "), F.col("__path"))).cast("long")
    number = F.coalesce(F.col("__file"), unknown)
    joined = df.join(order, F.col("__path") == F.col("__file_path"), "left")
    joined = joined.withColumn(ROW_ID, F.shiftleft(number, shift).bitwiseOR(F.col(ROW_ID)))
    return joined.drop("__file", "__file_path", "__path")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Read Parquet; ``_row_id`` comes from the file's own row index, without a job."""
    raw = spark.read.parquet(path)
    if ROW_ID in raw.columns:
        return raw
    names = normalize_headers(raw.columns)
    files = sorted(raw.inputFiles())
    meta = F.col("_metadata.row_index").alias(ROW_ID)
    if len(files) <= 1:
        df = raw.select("*", meta)
    else:
        df = raw.select("*", F.col("_metadata.file_path").alias("__path"), meta)
        df = _join_file_number(df, files, ROW_BITS)
    return denan(df.toDF(*names, ROW_ID))


def read_table(spark: SparkSession, path: str, **options) -> DataFrame:
    """Read by file name: ``.csv`` or ``.parquet``."""
    lower = path.lower().rstrip("/")
    if lower.endswith(".csv"):
        return read_delimited(spark, path, **options)
    if lower.endswith(".parquet"):
        return read_parquet(spark, path)
    raise ValueError("only .csv and .parquet tables can be read")


def write_csv(df: DataFrame, path: str, byte_order_mark: bool = True, mode: str = "error") -> None:
    """CSV in row order, without the row id, UTF-8.

    The byte order mark makes spreadsheets take the file as UTF-8.  Parts are
    written in parallel; each carries the header.
    """
    require_row_id(df)
    ordered = df.orderBy(ROW_ID).select(*[col(c) for c in data_columns(df)])
    if byte_order_mark and ordered.columns:
        ordered = ordered.toDF(BYTE_ORDER_MARK + ordered.columns[0], *ordered.columns[1:])
    ordered.write.mode(mode).options(header=True, encoding="UTF-8", quote='"', escape='"').csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "error") -> None:
    """Parquet with the row id, the sink that scales."""
    df.write.mode(mode).parquet(path)
