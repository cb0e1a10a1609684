"""A workbook is a folder of tables, one file (or table folder) per sheet."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from sheetloom.sources.files import list_entries
from sheetloom.sources.tables import read_table

SINGLE_SHEET = "Sheet1"
SUFFIXES = (".csv", ".parquet")


class SheetNotFound(KeyError):
    """No sheet of that name."""


@dataclass
class Workbook:
    sheets: dict[str, DataFrame]
    active: str

    @property
    def names(self) -> list[str]:
        return list(self.sheets)

    @property
    def sheet(self) -> DataFrame:
        return self.sheets[self.active]

    def switch(self, name: str) -> DataFrame:
        if name not in self.sheets:
            raise SheetNotFound(name)
        self.active = name
        return self.sheet


def open_workbook(spark: SparkSession, path: str, **options) -> Workbook:
    """Open a single table as ``Sheet1``, or every table of a folder, in name order."""
    if path.lower().rstrip("/").endswith(SUFFIXES):
        return Workbook({SINGLE_SHEET: read_table(spark, path, **options)}, SINGLE_SHEET)
    entries = [e for e in list_entries(spark, path) if e.name.lower().endswith(SUFFIXES)]
    if not entries:
        raise ValueError(f"no sheet found in {path}")
    sheets = {
        e.name.rsplit(".", 1)[0]: read_table(spark, e.path, **(options if e.name.lower().endswith(".csv") else {}))
        for e in entries
    }
    return Workbook(sheets, next(iter(sheets)))
