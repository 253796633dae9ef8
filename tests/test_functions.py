"""Column expressions against plain Python."""

from datetime import datetime

import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tabwise.functions import parse, text
from tabwise.functions.display import format_kpi, number_format


def values(spark, expression, cells):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("c"))).collect()]


CELLS = [
    "", " ", "a", " a ", " x　", "\tNA\n", "n/A", "--", "- -", "?", "undefined", "UNDEFINED ",
    "undefineds", "é", " é", "x\x1f", "nil", None, "a b", " nan ", "0", "None.",
]


def test_strip_is_the_usual_strip(spark):
    assert values(spark, text.strip, CELLS) == [c if c is None else c.strip() for c in CELLS]


def test_missing_tokens(spark):
    def expected(c):
        if c is None or c.strip().lower() in text.MISSING_TOKENS:
            return None
        return c.strip()

    assert values(spark, lambda c: text.token_to_null(text.strip(c)), CELLS) == [expected(c) for c in CELLS]


def test_strip_random_text(spark):
    @settings(max_examples=5, deadline=None)
    @given(st.lists(st.text(alphabet=" \t  abc!~é\x7f\x80", max_size=6), min_size=40))
    def check(cells):
        assert values(spark, text.strip, cells) == [c.strip() for c in cells]

    check()


def test_number(spark):
    cells = ["1", " 2.5 ", "+3", "-4e2", ".5", "5.", "1d", "1f", "0x1p3", "1,000", "", "abc", "inf",
             "nan", None, "1e", "--1"]
    want = [1.0, 2.5, 3.0, -400.0, 0.5, 5.0, None, None, None, None, None, None, float("inf"),
            None, None, None, None]
    assert values(spark, parse.number, cells) == want
    assert values(spark, parse.plain_number, ["1,234.5", "x"]) == [1234.5, None]
    assert values(spark, parse.percent_number, ["25%", " 5 % ", "1,0%", "x%"]) == [0.25, 0.05, None, None]
    assert values(spark, parse.currency_number, [" ₹1,500.00 ", "$ 7", "€x"]) == [1500.0, 7.0, None]


DATES = [
    "2024-01-05", "2024-1-5", "2024-01-05 10:20:30", "2024-01-05T10:20:30.25", "2024/01/05", "20240105",
    "2024-01", "2024", "01/05/2024", "13/01/2024", "05-01-2024", "13.01.2024 10:20", "5 Jan 2024",
    "5-Jan-2024", "Jan 5, 2024", "January 5 2024", "Sept 5, 2024", "31 December 2023", "TX-101", "12345",
    "02/30/2024", "2024-13-01", "", "5 Foo 2024", "hello",
]


def test_dates_read_as_pandas_reads_them(spark):
    want = [
        None if pd.isna(t) else t.to_pydatetime()
        for t in (pd.to_datetime(pd.Series([c]), errors="coerce", format="mixed")[0] for c in DATES)
    ]
    assert values(spark, parse.timestamp, DATES) == want


def test_compact_date(spark):
    df = spark.createDataFrame([(20240105,), (5,), (20241399,)], "n bigint")
    got = [r[0] for r in df.select(parse.compact_date(F.col("n"))).collect()]
    assert got == [datetime(2024, 1, 5), None, None]


@pytest.mark.parametrize(
    ("value", "role", "symbol", "shown", "code"),
    [
        (0.72, "percentage", None, "72.00%", "0.00%"),
        (1250.0, "currency", "$", "$1,250.00", '"$"#,##0.00'),
        (1250.0, "currency", None, "₹1,250.00", '"₹"#,##0.00'),
        (2.675, "rating", None, "2.67", "0.00"),
        (0.125, "rating", None, "0.12", "0.00"),
        (1449.5, "count", None, "1,450", "#,##0"),
        (2.5, "count", None, "2", "#,##0"),
        (7.0, "numeric", None, "7", "#,##0.00"),
        (1234.567, "numeric", None, "1,234.57", "#,##0.00"),
        (None, "numeric", None, "N/A", "#,##0.00"),
        (-0.5, "currency", "€", "€-0.50", '"€"#,##0.00'),
    ],
)
def test_display(spark, value, role, symbol, shown, code):
    df = spark.createDataFrame([(value, role, symbol)], "v double, r string, s string")
    args = F.col("r"), F.col("s")
    row = df.select(format_kpi(F.col("v"), *args), number_format(*args)).first()
    assert tuple(row) == (shown, code)


def test_dates_by_their_parts(spark):
    at = datetime
    wanted = {
        "Mon, 5 Feb 2024 17:03:09 GMT": at(2024, 2, 5, 17, 3, 9),
        "monday February 5, 2024 5 pm": at(2024, 2, 5, 17),
        "02/05/24 12:00 AM": at(2024, 2, 5, 0, 0),
        "2/5/24, 12:30:01.5 p.m.": at(2024, 2, 5, 12, 30, 1, 500_000),
        "13/05/24": at(2024, 5, 13),
        "1-2-68": at(2068, 1, 2),
        "1-2-69": at(1969, 1, 2),
        "1-2-99": at(1999, 1, 2),
        "2024-02-05T23:30:00-08:00": at(2024, 2, 6, 7, 30),
        "2024-02-05 01:00 +0530": at(2024, 2, 4, 19, 30),
        "2024/2/5 7:05z": at(2024, 2, 5, 7, 5),
        "Tue 2024-02-06": at(2024, 2, 6),
        "2024-02-05 24:00 GMT": None,
        "2024-02-05 13:00 PM": None,
        "2024-02-05 0:10 am": None,
        "2024-02-05 7": None,
        "2024-02-30 07:00 GMT": None,
        "30/30/24": None,
        "1.2.34": None,
        "Mondays 5 Feb 2024": None,
        "5 Fob 2024 5 pm": None,
        "": None,
    }
    assert dict(zip(wanted, values(spark, parse.timestamp, list(wanted)), strict=True)) == wanted
