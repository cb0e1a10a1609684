"""Spark-native table cleaning and spreadsheet formulas.

Every operator is a plain ``DataFrame -> DataFrame`` function.  Row order is
carried by a hidden ``_row_id`` column (see :mod:`sheetloom.rows`).
"""

from sheetloom.rows import ROW_ID, data_columns, with_row_id
from sheetloom.session import get_session

__all__ = ["ROW_ID", "data_columns", "get_session", "with_row_id"]
