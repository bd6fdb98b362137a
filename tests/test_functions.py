"""Cleaning, dates and calendar parts on hand-made text."""

from datetime import datetime as dt

import pytest
from pyspark.sql import functions as F

from tsweave.functions import calendar, cleaning, dates


def column(spark, texts, build):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(2)
    return [r[0] for r in df.select("i", build(F.col("t")).alias("o")).orderBy("i").select("o").collect()]


NUMBERS = ["-5.2", "1,234.5", "12%", "$3.10", "1e-05", "1.2.3", ".", "", "N/A", None]


def test_digits_only(spark):
    got = column(spark, NUMBERS, cleaning.clean_numeric)
    assert got == [5.2, 1234.5, 12.0, 3.1, 105.0, None, None, None, None, None]


def test_signed(spark):
    got = column(spark, NUMBERS + ["+7", "NaN", "1d", "-.5", "Infinity"], lambda c: cleaning.clean_numeric(c, signed=True))
    assert got == [-5.2, 1234.5, 12.0, 3.1, 1e-05, None, None, None, None, None, 7.0, None, None, -0.5, None]


def test_nan_becomes_null(spark):
    df = spark.sql("SELECT explode(array(double('NaN'), 1.5, null)) AS v")
    assert [r[0] for r in df.select(cleaning.nan_to_null(F.col("v"))).collect()] == [None, 1.5, None]


FIRST = [
    ("Nov-21", dt(2021, 11, 1)), ("25-Nov-2021", dt(2020, 11, 1)), ("Nov-2021", dt(2020, 11, 1)), ("Nov-85", dt(1985, 11, 1)),
    ("2021-11-25 14:33:14", dt(2021, 11, 25)), ("01-02-2021", dt(2021, 2, 1)), ("99-11-2021", dt(2021, 11, 9)),
    ("1/1/1985", dt(1985, 1, 1)), ("31/12/1999", dt(1999, 1, 12)), ("2021/11/25", dt(2021, 11, 25)),
    ("November 5, 2021", dt(2021, 11, 5)), ("Nov 5, 2021", dt(2021, 11, 5)), ("2021-11", dt(2021, 11, 1)),
    ("2021-13-01", dt(2021, 1, 1)), ("11/2021", dt(2021, 11, 1)), ("November 2021", dt(2021, 11, 1)),
    ("Thursday, November 25, 2021", dt(2021, 11, 25)), ("2021-02-30", dt(2021, 2, 1)), ("nothing", None), ("", None), (None, None),
]


def test_first_match(spark):
    got = column(spark, [t for t, _ in FIRST], lambda c: dates.parse_dates(c, "first_match"))
    assert got == [v for _, v in FIRST]


SPECIFIC = [
    ("2021-11-25 14:33:14", dt(2021, 11, 25, 14, 33, 14)), ("2021-11-25T14:33:14.5", dt(2021, 11, 25, 14, 33, 14, 500000)),
    ("2021-11-25 14:33", dt(2021, 11, 25, 14, 33)), ("25-11-2021 01:02:03", dt(2021, 11, 25, 1, 2, 3)),
    ("11/25/2021 02:05 PM", dt(2021, 11, 25, 14, 5)), ("11/25/2021 12:05 AM", dt(2021, 11, 25, 0, 5)),
    ("Thu, 25 Nov 2021 14:33:14 GMT", dt(2021, 11, 25, 14, 33, 14)), ("Thursday, November 25, 2021", dt(2021, 11, 25)),
    ("25-Nov-2021", dt(2021, 11, 25)), ("Nov-2021", dt(2021, 11, 1)), ("Nov-21", dt(2021, 11, 1)), ("Nov-85", dt(1985, 11, 1)),
    ("1/1/1985", dt(1985, 1, 1)), ("2021-11", dt(2021, 11, 1)), ("31/12/1999", None), ("2021-02-30", None), ("x 2021-11-25", None),
]


def test_unread_layouts(spark):
    df = spark.createDataFrame([("25.11.2021",), ("01.2.2021",), ("2021-11-25",), (None,), ("",), ("soon",)], "t string")
    assert sorted(map(tuple, dates.unread_layouts(df, "t").collect())) == [("", 1, ""), ("9.9.9", 2, "01.2.2021"), ("a", 1, "soon")]


def test_most_specific(spark):
    assert column(spark, [t for t, _ in SPECIFIC], dates.parse_dates) == [v for _, v in SPECIFIC]


def test_unknown_mode():
    with pytest.raises(ValueError):
        dates.parse_dates(None, "best")


def test_parse_timestamp(spark):
    assert column(spark, ["2021-11-25 14:33:14", "no"], dates.parse_timestamp) == [dt(2021, 11, 25, 14, 33, 14), None]
    by_pattern = column(spark, ["25|11|2021", "no"], lambda c: dates.parse_timestamp(c, "dd|MM|yyyy"))
    assert by_pattern == [dt(2021, 11, 25), None]
    with pytest.raises(Exception):
        column(spark, ["no"], lambda c: dates.parse_timestamp(c, strict=True))


def test_day_and_hour_keeps_null(spark):
    df = spark.createDataFrame([("2021-11-25", "14:00"), ("2021-11-25", None), (None, "14:00")], "d string, h string")
    got = [r[0] for r in df.select(dates.day_and_hour(F.col("d"), F.col("h"))).collect()]
    assert got == [dt(2021, 11, 25, 14), None, None]


def test_calendar(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-01 18:00:00' AS ts")  # a Monday
    row = calendar.add_calendar(df).first()
    assert (row.hour, row.day_of_week, row.day_of_month, row.month) == (18, 0, 1, 1)
    row = calendar.add_date_parts(df, drop_ts=True).first()
    assert (row.year, row.weekday) == (2024, 0) and "ts" not in row.asDict()
    assert row.hour_sin == pytest.approx(-1) and row.hour_cos == pytest.approx(0) and row.weekday_cos == 1


def test_future_timestamp(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-02-28 06:00:00' AS ts, 3600.5D AS s")
    row = df.select(
        calendar.future_timestamp(F.col("ts"), F.lit(2)), calendar.future_timestamp(F.col("ts"), F.lit(2), F.col("s"))
    ).first()
    assert tuple(row) == (dt(2024, 3, 1, 6), dt(2024, 2, 28, 8, 0, 1))
