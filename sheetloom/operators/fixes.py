"""The registered cleanup fixes.

Each fix is ``fix(df, log=None) -> DataFrame``.  Fixes whose columns depend on
the data (currency, dates, blanks, accounting negatives, scientific notation,
yes/no) first run one profiling aggregate over all candidate columns; every
other fix is a lazy projection or filter.  ``columns=`` overrides the choice
made from headers.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetloom.functions.cells import (
    ACCOUNTING_TEXT,
    SCIENTIFIC_TEXT,
    as_identifier_text,
    as_text,
    currency_text,
    double_to_text,
    is_missing,
    proper_case,
    round_half_even,
    squeeze,
    strip,
    text_to_number,
)
from sheetloom.functions.dates import parse_date
from sheetloom.operators import distinct
from sheetloom.operators.changes import ChangeLog, filtered, rewrite
from sheetloom.rows import (
    ROW_ID,
    col,
    data_columns,
    field_type,
    is_fractional,
    is_text,
    require_columns,
    require_row_id,
    text_columns,
)

# --------------------------------------------------------------------------
# Header fragments, cell tokens and shares that decide results.
# --------------------------------------------------------------------------

ID_HEADER_FRAGMENTS = (
    "phone", "mobile", "contact no", "contact number", "whatsapp", "account no",
    "account number", "pincode", "pin code", "zip", "otp", "aadhaar", "pan no",
    " id", "id ", "code",
)
DATE_HEADER_FRAGMENTS = ("date", "dob", "joining", "birth")
PHONE_HEADER_FRAGMENTS = ("phone", "mobile", "contact no", "contact number", "whatsapp")
EMAIL_HEADER_FRAGMENTS = ("email", "e-mail", "mail id")
FULL_NAME_FRAGMENTS = ("full name", "customer name", "employee name", "student name")
FIRST_NAME_FRAGMENTS = ("first name", "fname", "first_name")
LAST_NAME_FRAGMENTS = ("last name", "lname", "surname", "last_name")
ERROR_TOKENS = ("#N/A", "#REF!", "#VALUE!", "#DIV/0!", "#NAME?", "#NULL!", "#NUM!", "#GETTING_DATA")
YES_TOKENS = ("yes", "y", "true", "1", "haan", "ha")
NO_TOKENS = ("no", "n", "false", "0", "nahi", "nahin")
BLANK_FILLER = "N/A"
AMOUNT_TEXT = r"^-?\d+(\.\d+)?$"
NUMBER_SHARE = 0.6
DATE_SHARE = 0.5
YES_NO_SHARE = 0.8


def columns_named(df: DataFrame, fragments: tuple[str, ...]) -> list[str]:
    """Columns whose lower-cased header contains one of the fragments."""
    return [c for c in data_columns(df) if any(f in c.lower() for f in fragments)]


def first_column_named(df: DataFrame, *fragments: str) -> str | None:
    return next(iter(columns_named(df, fragments)), None)


def profile(df: DataFrame, aggs: dict[str, Column]) -> dict:
    """One aggregate over the table, keyed by column name."""
    if not aggs:
        return {}
    row = df.agg(*[a.alias(f"p{i}") for i, a in enumerate(aggs.values())]).first()
    return {name: row[i] for i, name in enumerate(aggs)}


def _share(test: Column) -> Column:
    """Share of all rows that pass; null rows do not pass."""
    return F.avg(F.when(test, 1.0).otherwise(0.0))


# --------------------------------------------------------------------------
# rows
# --------------------------------------------------------------------------


def remove_duplicates(df: DataFrame, log: ChangeLog | None = None) -> DataFrame:
    return filtered(df, distinct.remove_duplicates, log)


def remove_empty_rows(df: DataFrame, log: ChangeLog | None = None) -> DataFrame:
    return filtered(df, distinct.remove_empty_rows, log)


# --------------------------------------------------------------------------
# text, in every text column
# --------------------------------------------------------------------------


def trim_spaces(df: DataFrame, log: ChangeLog | None = None) -> DataFrame:
    return rewrite(df, {c: squeeze(col(c)) for c in text_columns(df)}, log)


def capitalize_text(df: DataFrame, log: ChangeLog | None = None) -> DataFrame:
    cells = {}
    for c in text_columns(df):
        cells[c] = F.when(col(c).rlike(r"(?U)\S"), proper_case(strip(col(c)))).otherwise(col(c))
    return rewrite(df, cells, log)


def remove_special_chars(df: DataFrame, log: ChangeLog | None = None) -> DataFrame:
    keep = r"(?U)[^\p{L}\p{N}_\s.,@\-]"
    return rewrite(df, {c: F.regexp_replace(col(c), keep, "") for c in text_columns(df)}, log)


def remove_error_values(df: DataFrame, log: ChangeLog | None = None) -> DataFrame:
    cells = {c: F.when(~F.upper(strip(col(c))).isin(*ERROR_TOKENS), col(c)) for c in text_columns(df)}
    return rewrite(df, cells, log)


def accounting_negatives(df: DataFrame, log: ChangeLog | None = None) -> DataFrame:
    """``(1,234)`` to ``-1234.0`` as text; other cells of such a column are trimmed."""
    found = profile(df, {c: F.max(strip(col(c)).rlike(ACCOUNTING_TEXT)) for c in text_columns(df)})
    cells = {}
    for c in [c for c, hit in found.items() if hit]:
        s = strip(col(c))
        digits = F.replace(F.regexp_extract(s, ACCOUNTING_TEXT, 1), F.lit(","), F.lit(""))
        negative = double_to_text(-digits.try_cast("double"))
        cells[c] = F.when(s.rlike(ACCOUNTING_TEXT), F.coalesce(negative, s)).otherwise(s)
    return rewrite(df, cells, log)


def scientific_notation(df: DataFrame, log: ChangeLog | None = None) -> DataFrame:
    """``1.23E+15`` back to plain digits; other cells stay as they are."""
    found = profile(df, {c: F.max(strip(col(c)).rlike(SCIENTIFIC_TEXT)) for c in text_columns(df)})
    cells = {}
    for c in [c for c, hit in found.items() if hit]:
        s = strip(col(c))
        number = s.try_cast("double")
        whole = F.when(number == F.rint(number), number.try_cast("decimal(38,0)").cast("string"))
        plain = F.coalesce(whole, double_to_text(number))
        cells[c] = F.when(s.rlike(SCIENTIFIC_TEXT) & (F.abs(number) < float("inf")), plain).otherwise(col(c))
    return rewrite(df, cells, log)


def standardize_yesno(df: DataFrame, log: ChangeLog | None = None) -> DataFrame:
    names = text_columns(df)
    known = {c: F.lower(strip(col(c))).isin(*YES_TOKENS, *NO_TOKENS) for c in names}
    shares = profile(df, {c: F.avg(F.when(known[c], 1.0).when(col(c).isNotNull(), 0.0)) for c in names})
    cells = {}
    for c in names:
        if shares[c] is None or shares[c] < YES_NO_SHARE:
            continue
        s = F.lower(strip(col(c)))
        cells[c] = F.when(s.isin(*YES_TOKENS), "Yes").when(s.isin(*NO_TOKENS), "No").otherwise(col(c))
    return rewrite(df, cells, log)


# --------------------------------------------------------------------------
# numbers and dates
# --------------------------------------------------------------------------


def number_like_columns(df: DataFrame, sample_cells: int | None = None) -> list[str]:
    """Text columns most of whose filled cells look like amounts and whose header is no ID.

    All cells count; `sample_cells` looks at that many of the first ones only.
    """
    names = [c for c in text_columns(df) if not any(f in f" {c.lower()} " for f in ID_HEADER_FRAGMENTS)]
    if not names:
        return []
    if sample_cells is not None:
        require_row_id(df)
        cells = df.unpivot([ROW_ID], [col(c) for c in names], "__column", "__cell").where("__cell IS NOT NULL")
        first = Window.partitionBy("__column").orderBy(ROW_ID)
        sample = cells.withColumn("__nth", F.row_number().over(first)).where(F.col("__nth") <= sample_cells)
        like = currency_text(F.col("__cell")).rlike(AMOUNT_TEXT)
        found = {r["__column"]: r["s"] for r in sample.groupBy("__column").agg(_share(like).alias("s")).collect()}
    else:
        found = profile(df, {c: F.avg(F.when(col(c).isNotNull(), currency_text(col(c)).rlike(AMOUNT_TEXT).cast("double"))) for c in names})
    return [c for c in names if (found.get(c) or 0) > NUMBER_SHARE]


def clean_currency(
    df: DataFrame, log: ChangeLog | None = None, columns: list[str] | None = None, sample_cells: int | None = None
) -> DataFrame:
    """Amounts written as text become numbers, if most of the column parses."""
    if columns is not None:
        require_columns(df, *columns)
    names = number_like_columns(df, sample_cells) if columns is None else [c for c in columns if is_text(df, c)]
    numbers = {c: text_to_number(currency_text(col(c))) for c in names}
    shares = profile(df, {c: _share(n.isNotNull()) for c, n in numbers.items()})
    return rewrite(df, {c: numbers[c] for c in names if (shares[c] or 0) > NUMBER_SHARE}, log)


def date_format(
    df: DataFrame, log: ChangeLog | None = None, columns: list[str] | None = None
) -> DataFrame:
    """Dates in any usual form to ``dd-MM-yyyy`` text."""
    if columns is not None:
        require_columns(df, *columns)
    dates = {}
    for c in columns_named(df, DATE_HEADER_FRAGMENTS) if columns is None else columns:
        kind = field_type(df, c)
        if isinstance(kind, T.StringType):
            dates[c] = parse_date(col(c))
        elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            dates[c] = col(c)
    shares = profile(df, {c: _share(d.isNotNull()) for c, d in dates.items()})
    cells = {c: F.date_format(d, "dd-MM-yyyy") for c, d in dates.items() if (shares[c] or 0) > DATE_SHARE}
    return rewrite(df, cells, log)


def round_numbers(df: DataFrame, log: ChangeLog | None = None) -> DataFrame:
    names = [c for c in data_columns(df) if is_fractional(df, c)]
    return rewrite(df, {c: round_half_even(col(c).cast("double")) for c in names}, log)


def fill_blanks(df: DataFrame, log: ChangeLog | None = None) -> DataFrame:
    """Every blank cell becomes ``N/A``; columns that had one become text."""
    counts = profile(df, {c: F.count_if(is_missing(df, c)) for c in data_columns(df)})
    cells = {
        c: F.when(is_missing(df, c), F.lit(BLANK_FILLER)).otherwise(as_text(df, c))
        for c, n in counts.items()
        if n
    }
    return rewrite(df, cells, log)


# --------------------------------------------------------------------------
# names, phones, e-mails, headers
# --------------------------------------------------------------------------


def clean_headers(df: DataFrame, log: ChangeLog | None = None) -> DataFrame:
    names = [c if c == ROW_ID else re.sub(r"\s+", " ", c.strip()).title() for c in df.columns]
    clash = {n for n in names if names.count(n) > 1}
    if clash:
        raise ValueError(f"headers would collide: {', '.join(sorted(clash))}")
    return df.toDF(*names)


def split_full_name(df: DataFrame, log: ChangeLog | None = None) -> DataFrame:
    """A name column to ``First Name`` and ``Last Name``, if any name has two words."""
    name = first_column_named(df, *FULL_NAME_FRAGMENTS) or first_column_named(df, "name")
    if name is None:
        return df
    if first_column_named(df, "first name") and first_column_named(df, "last name"):
        return df
    words = F.split(strip(as_text(df, name)), r"(?U)\s+", 2)
    if not profile(df, {name: F.max(F.size(words) > 1)})[name]:
        return df
    return df.withColumns(
        {
            "First Name": F.get(words, F.lit(0)),
            "Last Name": F.when(words.isNotNull(), F.coalesce(F.get(words, F.lit(1)), F.lit(""))),
        }
    )


def merge_name_columns(df: DataFrame, log: ChangeLog | None = None) -> DataFrame:
    first = first_column_named(df, *FIRST_NAME_FRAGMENTS)
    last = first_column_named(df, *LAST_NAME_FRAGMENTS)
    if first is None or last is None:
        return df
    parts = [F.coalesce(strip(as_text(df, c)), F.lit("")) for c in (first, last)]
    return df.withColumn("Full Name", strip(F.concat_ws(" ", *parts)))


def standardize_phone(df: DataFrame, log: ChangeLog | None = None) -> DataFrame:
    """Digits only, the last ten of them."""
    cells = {}
    for c in columns_named(df, PHONE_HEADER_FRAGMENTS):
        digits = F.regexp_replace(as_identifier_text(df, c), r"\D", "")
        cells[c] = F.right(digits, F.lit(10))
    return rewrite(df, cells, log)


def standardize_email(df: DataFrame, log: ChangeLog | None = None) -> DataFrame:
    names = [c for c in columns_named(df, EMAIL_HEADER_FRAGMENTS) if is_text(df, c)]
    return rewrite(df, {c: F.lower(strip(col(c))) for c in names}, log)


# --------------------------------------------------------------------------
# registry
# --------------------------------------------------------------------------


@dataclass(frozen=True)
class Fix:
    id: str
    label: str
    keywords: tuple[str, ...]
    run: Callable[..., DataFrame]


# Ids, labels and keywords, in order of precedence.
REGISTRY: list[Fix] = [
    Fix("remove_duplicates", "Duplicate rows hatao",
        ("duplicate", "duplicates", "dobara", "repeat", "copy row", "dupliate"), remove_duplicates),
    Fix("trim_spaces", "Extra spaces trim karo",
        ("space", "spaces", "trim", "extra space", "gap"), trim_spaces),
    Fix("clean_currency", "Currency/number symbols saaf karo",
        ("currency", "₹", "rupee", "rs.", "price", "salary", "comma", "number clean", "symbol"), clean_currency),
    Fix("date_format", "Date format sahi karo",
        ("date", "format", "dd-mm", "dob", "tareekh"), date_format),
    Fix("capitalize_text", "Naam/text ka case sahi karo",
        ("capitalize", "case", "upper", "lower", "naam sahi", "proper case", "title case"), capitalize_text),
    Fix("clean_headers", "Column headers clean karo",
        ("header", "headers", "column name", "heading", "title row"), clean_headers),
    Fix("fill_blanks", "Khali cells fill karo",
        ("blank cell", "empty cell", "khali cell", "missing value", "na value", "blank", "khali"), fill_blanks),
    Fix("remove_special_chars", "Special characters hatao",
        ("special character", "junk char", "garbage", "weird symbol"), remove_special_chars),
    Fix("remove_excel_errors", "Excel error values (#N/A, #REF!) hatao",
        ("#n/a", "#ref", "#value", "#div/0", "excel error", "error value", "error hatao"), remove_error_values),
    Fix("accounting_negatives", "Accounting-format negatives fix karo",
        ("accounting format", "bracket negative", "parenthesis negative", "negative number", "bracket number"),
        accounting_negatives),
    Fix("split_full_name", "Full Name ko First/Last mein split karo",
        ("split name", "name split", "first name last name", "naam alag karo", "split"), split_full_name),
    Fix("merge_name_columns", "First/Last Name ko Full Name mein jodo",
        ("merge name", "combine name", "full name banao", "name jodo", "name combine", "jodo", "milao", "milaao"),
        merge_name_columns),
    Fix("standardize_phone", "Phone numbers standardize karo",
        ("phone number", "mobile number", "contact number", "phone format", "whatsapp number"), standardize_phone),
    Fix("standardize_email", "Email addresses clean karo",
        ("email lowercase", "email clean", "email format", "mail id clean", "email standardize", "email id",
         "id lowercase"), standardize_email),
    Fix("remove_empty_rows", "Poori khali rows hatao",
        ("empty row", "blank row", "khali row", "poori row khali", "row khali hai"), remove_empty_rows),
    Fix("scientific_notation", "Scientific notation fix karo",
        ("scientific notation", "exponential number", "e+", "1.23e"), scientific_notation),
    Fix("round_numbers", "Numbers ko round karo (2 decimal)",
        ("round number", "decimal round", "2 decimal", "round off"), round_numbers),
    Fix("standardize_yesno", "Yes/No values standardize karo",
        ("yes no", "true false", "boolean clean", "y n column", "yes no clean", "y n", "standardize yes"),
        standardize_yesno),
]


def register_fix(fix_id: str, label: str, keywords: list[str], run: Callable[..., DataFrame]) -> None:
    """Add a fix, ``run(df, log=None) -> DataFrame``; an existing id is replaced."""
    entry = Fix(fix_id, label, tuple(keywords), run)
    for i, known in enumerate(REGISTRY):
        if known.id == fix_id:
            REGISTRY[i] = entry
            return
    REGISTRY.append(entry)


def find_fix(fix_id: str) -> Fix | None:
    return next((f for f in REGISTRY if f.id == fix_id), None)


def apply_fix(df: DataFrame, fix_id: str, log: ChangeLog | None = None) -> DataFrame | None:
    """Run a fix by id; None if there is no such fix."""
    fix = find_fix(fix_id)
    if fix is None:
        return None
    return fix.run(df) if log is None else fix.run(df, log=log)


def list_fixes(spark) -> DataFrame:
    rows = [(i, f.id, f.label) for i, f in enumerate(REGISTRY)]
    return spark.createDataFrame(rows, "position int, id string, label string")
