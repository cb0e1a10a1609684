"""A 0-100 data-quality score."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetloom.functions.cells import PLAIN_NUMBER_TEXT, is_missing
from sheetloom.operators.anomalies import count_anomalies
from sheetloom.operators.distinct import duplicate_count
from sheetloom.operators.missing import report_aggregates, report_lines
from sheetloom.rows import col, data_columns, is_numeric, text_columns

# Checks, caps and grades of the score.
MIXED_MIN_CELLS = 5
MIXED_LOW, MIXED_HIGH = 0.15, 0.85
GRADES = ((90, "A"), (75, "B"), (60, "C"), (40, "D"))


def grade(score: int) -> str:
    return next((g for least, g in GRADES if score >= least), "F")


MIXED_STRUCT = "array<struct<column:string,cells:bigint,numeric_share:double,is_mixed:boolean>>"


def _mixed_aggregates(df: DataFrame) -> list[Column]:
    aggs = []
    for i, c in enumerate(text_columns(df)):
        filled = ~is_missing(df, c)
        aggs.append(F.count_if(filled).alias(f"__f{i}"))
        aggs.append(F.avg(F.when(filled, F.when(col(c).rlike(PLAIN_NUMBER_TEXT), 1.0).otherwise(0.0))).alias(f"__s{i}"))
    return aggs


def _mixed_lines(df: DataFrame) -> Column:
    lines = []
    for i, c in enumerate(text_columns(df)):
        share, cells = F.col(f"__s{i}"), F.col(f"__f{i}")
        mixed = (cells >= MIXED_MIN_CELLS) & (share > MIXED_LOW) & (share < MIXED_HIGH)
        lines.append(
            F.struct(
                F.lit(c).alias("column"),
                cells.alias("cells"),
                share.alias("numeric_share"),
                F.coalesce(mixed, F.lit(False)).alias("is_mixed"),
            )
        )
    return F.array(*lines).cast(MIXED_STRUCT)


def mixed_type_shares(df: DataFrame) -> DataFrame:
    """Per text column: non-blank cells, and the share that looks like numbers."""
    aggs = _mixed_aggregates(df) or [F.count("*")]
    return df.agg(*aggs).select(F.inline(_mixed_lines(df)))


def mixed_type_columns(df: DataFrame) -> DataFrame:
    return mixed_type_shares(df).where("is_mixed").select("column", "cells", "numeric_share")


@dataclass
class QualityReport:
    score: int
    grade: str
    total_rows: int
    total_columns: int
    total_missing_cells: int
    duplicate_rows: int
    issues: list[dict] = field(default_factory=list)
    missing_by_column: list[dict] = field(default_factory=list)
    anomaly_columns: list[dict] = field(default_factory=list)
    mixed_type_columns: list[str] = field(default_factory=list)

    def as_dict(self) -> dict:
        return asdict(self)

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """One row with the totals and the issues as an array of structs."""
        schema = (
            "score int, grade string, total_rows long, total_columns int, total_missing_cells long,"
            " duplicate_rows long, anomalies long, mixed_columns int,"
            " issues array<struct<type:string,severity:string,message:string>>"
        )
        row = (
            self.score, self.grade, self.total_rows, self.total_columns, self.total_missing_cells,
            self.duplicate_rows, sum(a["count"] for a in self.anomaly_columns), len(self.mixed_type_columns),
            [(i["type"], i["severity"], i["message"]) for i in self.issues],
        )
        return spark.createDataFrame([row], schema)

    def issues_frame(self, spark: SparkSession) -> DataFrame:
        return self.to_frame(spark).select(F.inline("issues"))


def quality_report(df: DataFrame, max_numeric_columns: int | None = None) -> QualityReport:
    """Score a table from its blanks, exact duplicates, outliers and mixed columns.

    Outliers are looked for in all numeric columns, or in the first `max_numeric_columns`.
    """
    names = data_columns(df)
    found = (
        df.agg(*report_aggregates(df), *_mixed_aggregates(df))
        .select("__rows", report_lines(df).alias("report"), _mixed_lines(df).alias("mixed"))
        .first()
    )  # one pass; one entry per column
    report = sorted(found["report"], key=lambda r: -r["missing_count"])
    total_rows = found["__rows"]
    total_missing = sum(r["missing_count"] for r in report)
    score, issues = 100.0, []

    missing_pct = round(total_missing / max(total_rows * len(names), 1) * 100, 1)
    if total_missing:
        score -= min(30, missing_pct * 1.5)
        issues.append(_issue("missing_values", "high" if missing_pct > 15 else "medium",
                             f"{total_missing} cells are blank (~{missing_pct}% of the table)."))

    duplicates = duplicate_count(df).first()["duplicate_rows"]
    if duplicates:
        pct = round(duplicates / total_rows * 100, 1)
        score -= min(25, pct * 2)
        issues.append(_issue("duplicate_rows", "high" if pct > 10 else "medium",
                             f"{duplicates} rows repeat an earlier row exactly (~{pct}%)."))

    numeric = [c for c in names if is_numeric(df, c)][:max_numeric_columns]
    flagged = {c: n for c, n in count_anomalies(df, numeric).items() if n} if numeric else {}
    if flagged:
        total = sum(flagged.values())
        score -= min(20, total * 0.8)
        issues.append(_issue("anomalies", "medium", f"{total} unusual numbers in {len(flagged)} column(s)."))

    mixed = [r["column"] for r in found["mixed"] if r["is_mixed"]]
    if mixed:
        score -= min(15, 5 * len(mixed))
        issues.append(_issue("mixed_types", "low", f"Numbers and text are mixed in: {', '.join(mixed)}."))

    if not issues:
        issues.append(_issue("none", "info", "No major data-quality issue found."))
    final = max(0, round(score))
    return QualityReport(
        score=final,
        grade=grade(final),
        total_rows=total_rows,
        total_columns=len(names),
        total_missing_cells=total_missing,
        duplicate_rows=duplicates,
        issues=issues,
        missing_by_column=[r.asDict() for r in report],
        anomaly_columns=[{"column": c, "count": n} for c, n in flagged.items()],
        mixed_type_columns=mixed,
    )


def _issue(kind: str, severity: str, message: str) -> dict:
    return {"type": kind, "severity": severity, "message": message}
