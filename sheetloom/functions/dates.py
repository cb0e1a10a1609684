"""Free-form date text to DATE, day first.

Weekday and clock are cut off; what digits, separators and month words are left
make a short signature, which says where day, month and year stand.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheetloom.functions.cells import strip

# Three letters per month, in calendar order; month and weekday words.
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
MONTH_WORD = (
    "(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?"
    "|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
)
WEEKDAY_WORD = (
    "(?:mon(?:day)?|tue(?:s(?:day)?)?|wed(?:nesday)?|thu(?:r(?:s(?:day)?)?)?|fri(?:day)?|sat(?:urday)?|sun(?:day)?)"
)
CLOCK = r"\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?(?:\s*[ap]\.?m\b\.?)?(?:\s*(?:z|utc|gmt)\b|\s*[+-]\d{2}:?\d{2}\b)?"
EDGES = rf"^(?:{CLOCK}[\s,]+)?(?:{WEEKDAY_WORD}[\s,.]+)?(?:{CLOCK}[\s,]+)?|(?:[\s,]+|t)\d{{1,2}}:\d{{2}}.*$"
ORDINAL_OR_GAP = r"(?<=\d)(?:st|nd|rd|th)(?![a-z])[-/,.\s]*|[-/,.\s]+|(?<=\d)(?=[a-z])|(?<=[a-z])(?=\d)"

HAS_EDGES = ":|^(?:mon|tue|wed|thu|fri|sat|sun)"


def _shapes(*parts: str) -> list[str]:
    """All signatures of parts d (day or month), y (two or four digits), Y (four) and m (month word)."""
    forms = {"d": ("0", "00"), "y": ("00", "0000"), "Y": ("0000",), "m": ("m",)}
    return [" ".join(found) for found in itertools.product(*(forms[p] for p in parts))]


# Signatures, and which part is the year, the month and the day (0: day 1).
COMPACT = "00000000"
NUMBERS = [(_shapes("Y", "d", "d"), 1, 2, 3), (_shapes("d", "d", "y"), 3, 2, 1)]
WORDS = [
    (_shapes("d", "m", "y"), 3, 2, 1),
    (_shapes("m", "d", "y"), 3, 1, 2),
    (_shapes("Y", "m", "d"), 1, 2, 3),
    (_shapes("m", "Y"), 2, 1, 0),
]
TWO_DIGITS_FROM = 1969  # two-digit years without a year to go by: 1969 to 2068


def _build(year: Column, month: Column, day: Column) -> Column:
    """A date from text parts, null if there is no such day."""
    return F.concat(year, F.lit("-"), month, F.lit("-"), day).try_cast("date")


def _month_number(word: Column) -> Column:
    at = F.instr(F.lit(MONTHS), F.substring(word, 1, 3))
    return F.floor((at + 2) / 3).cast("int").cast("string")


def _full_year(year: Column, first: int) -> Column:
    """Two digits become the year of the hundred years from ``first``."""
    full = F.lit(first) + F.pmod(year.try_cast("int") - F.lit(first), F.lit(100))
    return F.when(F.length(year) == 2, full.cast("string")).otherwise(year)


def parse_date(c: Column, this_year: int | None = None) -> Column:
    """Day-first parsing of the usual written forms; null if none fits.

    Numbers with separators, eight digits, month words with or without a day
    (day 1 then), each with a weekday in front and a clock on either side.  The
    month is read first only where day-first gives no valid date
    (``01/13/2023``).  Two-digit years land within 50 years of ``this_year``, or
    without one from 1969 to 2068, whatever the day of the run.
    """
    first = TWO_DIGITS_FROM if this_year is None else this_year - 50

    def part(text: Column, i: int) -> Column:
        return F.split_part(text, F.lit(" "), F.lit(i)) if i else F.lit("1")

    def zeros(text: Column) -> Column:
        return F.translate(text, "123456789", "000000000")

    def dated(core: Column) -> Column:
        # numbers only: the cell's own characters are the signature
        numbers = F.translate(core, "-/.", "   ")
        shape = zeros(numbers)
        found = F.when(
            shape == COMPACT, _build(F.substring(core, 1, 4), F.substring(core, 5, 2), F.substring(core, 7, 2))
        )
        for shapes, y, m, d in NUMBERS:
            year, month, day = _full_year(part(numbers, y), first), part(numbers, m), part(numbers, d)
            date = _build(year, month, day)
            if y == 3:
                date = F.coalesce(date, _build(year, day, month))
            found = found.when(shape.isin(shapes), date)

        # with a month word: one space between the parts
        spaced = F.regexp_replace(core, ORDINAL_OR_GAP, " ")
        worded = zeros(F.regexp_replace(spaced, rf"\b{MONTH_WORD}\b", "m"))
        dates = [
            F.when(worded.isin(shapes), _build(_full_year(part(spaced, y), first), _month_number(part(spaced, m)), part(spaced, d)))
            for shapes, y, m, d in WORDS
        ]
        return found.when(core.rlike("[a-z]"), F.coalesce(*dates))

    cell = F.lower(strip(c))
    core = F.when(cell.rlike(HAS_EDGES), F.regexp_replace(cell, EDGES, "")).otherwise(cell)
    # a one-element array: what is used in many places is computed once
    return F.get(F.transform(F.array(core), dated), F.lit(0))
