"""Column expressions for single cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetloom.rows import col, field_type, is_fractional, is_text

# What counts as a number when text is coerced.
NUMBER_TEXT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
ACCOUNTING_TEXT = r"^\(\s*([\d,]+(?:\.\d+)?)\s*\)$"
SCIENTIFIC_TEXT = r"^-?\d+(\.\d+)?[eE][+-]?\d+$"
PLAIN_NUMBER_TEXT = r"^\s*-?\d+(\.\d+)?\s*$"

# Currency words, and what is left out of amounts.
CURRENCY_WORD = r"(?i)\brs\.?\s*"
CURRENCY_MARKS = r"(?U)[₹$,\s]"

# The characters that count as white space at the ends of a cell.
SPACE_CHARACTERS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
ANY_SPACE = r"(?U)[\s\x1c-\x1f]+"


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only the blank."""
    return F.trim(c, F.lit(SPACE_CHARACTERS))


def squeeze(c: Column) -> Column:
    """Trim, and collapse inner white space to one blank."""
    return F.trim(F.regexp_replace(c, ANY_SPACE, " "))


def text_to_number(c: Column) -> Column:
    """Text to DOUBLE, null for anything that is not a plain finite number.

    The pattern comes first because a bare cast also takes ``12d`` and ``NaN``.
    """
    trimmed = F.trim(F.translate(c, "\t\r\n\f", "    "))
    value = F.when(trimmed.rlike(NUMBER_TEXT), trimmed.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def to_number(df: DataFrame, name: str) -> Column:
    """The column as DOUBLE, whatever its type; null where it is no number."""
    kind = field_type(df, name)
    if isinstance(kind, T.StringType):
        return text_to_number(col(name))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.nanvl(col(name).cast("double"), F.lit(None))
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return col(name).cast("double")
    return F.lit(None).cast("double")


def is_missing(df: DataFrame, name: str) -> Column:
    """Null, NaN, or (text only) nothing but white space."""
    c = col(name)
    if is_text(df, name):
        return c.isNull() | ~c.rlike(r"(?U)\S")
    if is_fractional(df, name):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def double_to_text(c: Column) -> Column:
    """A double as people write it: ``12345678.9``, not ``1.23456789E7``."""
    short = c.cast("string")
    plain = F.regexp_replace(short.try_cast("decimal(38,18)").cast("string"), r"0+$", "")
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    size = F.abs(c)
    wide = (size >= 1e7) & (size < 1e16)
    tiny = (size < 1e-3) & (size >= 1e-4)
    return F.when(wide | tiny, F.coalesce(plain, short)).otherwise(short)


def as_text(df: DataFrame, name: str) -> Column:
    """The cell as text; null stays null."""
    if is_text(df, name):
        return col(name)
    if is_fractional(df, name):
        return double_to_text(col(name).cast("double"))
    return col(name).cast("string")


def as_identifier_text(df: DataFrame, name: str) -> Column:
    """Like :func:`as_text`, but whole doubles lose their ``.0``.

    Phone numbers in a column with blanks arrive as doubles.
    """
    if not is_fractional(df, name):
        return as_text(df, name)
    value = col(name).cast("double")
    whole = (value == F.rint(value)) & (F.abs(value) < 1e18)
    return F.when(whole, value.try_cast("decimal(38,0)").cast("string")).otherwise(double_to_text(value))


MARK = "\ufffe"  # a non-character; texts that hold it take the slow way
CASED = r"[\p{IsLowercase}\p{IsUppercase}\p{Lt}]"
RUN_START = f"(?<!{CASED})(?={CASED})"


def proper_case(c: Column) -> Column:
    """First letter of every run of cased letters upper, the rest lower.

    ``initcap`` starts a word after blanks only, so every run is put after a
    marked blank, which is taken out again.
    """
    low = F.lower(c)
    marked = F.initcap(F.regexp_replace(low, RUN_START, MARK + " "))
    fast = F.replace(marked, F.lit(MARK + " "), F.lit(""))
    slow = F.array_join(F.transform(F.split(low, RUN_START), F.initcap), "")
    return F.when(F.contains(c, F.lit(MARK)), slow).otherwise(fast)


def currency_text(c: Column) -> Column:
    """Strip currency words and signs; ``(1,234)`` becomes ``-1234``."""
    s = strip(c)
    inner = F.regexp_extract(s, ACCOUNTING_TEXT, 1)
    signed = F.when(inner != "", F.concat(F.lit("-"), F.replace(inner, F.lit(","), F.lit("")))).otherwise(s)
    no_word = F.regexp_replace(signed, CURRENCY_WORD, "")
    return F.regexp_replace(no_word, CURRENCY_MARKS, "")


def round_half_even(c: Column, digits: int = 2) -> Column:
    """Scale, round half to even, unscale."""
    scale = float(10**digits)
    return F.rint(c * scale) / scale
