import datetime

import pytest
from pyspark.sql import functions as F

from sheetloom.functions.dates import parse_date

D = datetime.date

WRITTEN = {
    "5/4/2023": D(2023, 4, 5),
    " 05-04-2023 ": D(2023, 4, 5),
    "5.4.23": D(2023, 4, 5),
    "01/13/2023": D(2023, 1, 13),
    "2023-04-05": D(2023, 4, 5),
    "20230405": D(2023, 4, 5),
    "2023-04-05T10:20:30Z": D(2023, 4, 5),
    "2023-04-05 10:20:30.123456+05:30": D(2023, 4, 5),
    "10:30 05/04/2023": D(2023, 4, 5),
    "9:05 pm, 5 April 2023": D(2023, 4, 5),
    "5 Apr 2023 9:05 PM": D(2023, 4, 5),
    "Wednesday, 5th April 2023": D(2023, 4, 5),
    "Wed 05/04/2023": D(2023, 4, 5),
    "Thu, 06 Apr 2023 08:49:37 GMT": D(2023, 4, 6),
    "5-Apr-23": D(2023, 4, 5),
    "April 5, 2023": D(2023, 4, 5),
    "Apr. 5, 2023": D(2023, 4, 5),
    "2023 April 5": D(2023, 4, 5),
    "April 2023": D(2023, 4, 1),
    "sept-2021": D(2021, 9, 1),
    "29/02/2024": D(2024, 2, 29),
    "1/1/69": D(1969, 1, 1),
    "1/1/68": D(2068, 1, 1),
}
NO_DATES = [
    None, "", "   ", "29/02/2023", "31 April 2023", "13/13/2023", "hello", "may", "12", "2023", "1,2,2023", "5/4", "th 5 April 2023",
    "5 April 2023 of some year", "12345678901", "99999999", "monday", "10:30", "march of 2023", "1//2//2023", "x 5/4/2023",
]


def parsed(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    out = df.select("i", "t", parse_date(F.col("t"), **options).alias("d"))
    return {r["t"]: r["d"] for r in out.orderBy("i").collect()}


def test_written_forms(spark):
    assert parsed(spark, list(WRITTEN)) == WRITTEN


def test_no_dates(spark):
    assert parsed(spark, NO_DATES) == dict.fromkeys(NO_DATES)


@pytest.mark.parametrize("year, expected", [(1990, D(1968, 1, 1)), (2026, D(2068, 1, 1)), (2010, D(1968, 1, 1))])
def test_two_digits_around_a_year(spark, year, expected):
    assert parsed(spark, ["1/1/68"], this_year=year) == {"1/1/68": expected}


def test_long_cell(spark):
    text = "5 April 2023 " * 20_000
    assert parsed(spark, [text]) == {text: None}
