"""Named queries over the provided tables, each with equivalent SQL where SQL can say it."""

from __future__ import annotations

from sheetloom.catalog import cleaning, formulas, history, reports, tables
from sheetloom.catalog.inputs import Query

QUERIES: dict[str, Query] = {}
for _module in (tables, formulas, cleaning, reports, history):
    QUERIES.update(_module.QUERIES)
