"""Fixes that look at one row at a time run unchanged on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sheetloom.operators.fixes import apply_fix

# These choose their columns from the schema alone, so they need no profile job.
STREAMING_FIXES = (
    "trim_spaces",
    "capitalize_text",
    "clean_headers",
    "remove_special_chars",
    "remove_excel_errors",
    "merge_name_columns",
    "standardize_phone",
    "standardize_email",
    "remove_empty_rows",
    "round_numbers",
)


def apply_fixes(stream: DataFrame, fix_ids: list[str]) -> DataFrame:
    """Chain fixes on a streaming (or batch) table."""
    for fix_id in fix_ids:
        if fix_id not in STREAMING_FIXES:
            raise ValueError(f"{fix_id!r} profiles the whole table and cannot run on a stream")
        stream = apply_fix(stream, fix_id)
    return stream


def run_available(stream: DataFrame, path: str, checkpoint: str, output_mode: str = "append") -> None:
    """Process all available input into a Parquet folder, then stop."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode(output_mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
