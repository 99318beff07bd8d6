import datetime as dt

import pytest

from pyspark.sql import functions as F

from meterlens.functions.calendar import (
    add_holiday_flag, add_time_features, holiday_calendar, is_holiday,
)

COLUMNS = "id int, timestamp timestamp_ntz"


def test_time_features(spark):
    table = spark.createDataFrame(
        [(1, dt.datetime(2016, 1, 1, 13)), (2, dt.datetime(2016, 7, 10, 0)),
         (3, dt.datetime(2016, 10, 3, 6))], COLUMNS,
    )
    got = {r["id"]: r for r in add_time_features(table).collect()}
    assert got[1]["week_of_year"] == 53 and got[1]["day_of_week"] == 4
    assert got[2]["is_weekend"] == 1 and got[2]["semester_period"] == 0
    assert got[1]["semester_period"] == 1 and got[3]["semester_period"] == 2
    assert got[3]["hour_sin"] == pytest.approx(1.0) and got[3]["quarter"] == 4


# Public dates of US federal holidays (fixed values).
KNOWN = [
    "2016-01-01", "2016-01-18", "2016-02-15", "2016-05-30", "2016-07-04", "2016-09-05",
    "2016-10-10", "2016-11-11", "2016-11-24", "2016-12-25", "2016-12-26",
    "2017-01-01", "2017-01-02", "2017-11-10", "2017-11-11", "2021-06-18", "2021-06-19",
    "2021-12-24", "2021-12-25", "2021-12-31",
]


def test_holidays(spark):
    days = {str(r["date"]) for r in holiday_calendar(spark, 2016, 2021).collect()}
    assert set(KNOWN) <= days
    assert "2016-06-19" not in days and "2016-12-24" not in days
    assert len([d for d in days if d.startswith("2016")]) == 11


def test_holiday_flag_keeps_rows(spark):
    table = spark.createDataFrame(
        [(1, dt.datetime(2016, 12, 26, 5)), (2, dt.datetime(2016, 12, 27, 5))], COLUMNS
    )
    flagged = add_holiday_flag(table, holiday_calendar(spark))
    assert [r["is_holiday"] for r in flagged.orderBy("id").collect()] == [1, 0]


def test_holidays_of_all_years(spark):
    """The rule on a date names the days that the table of holidays lists, centuries away too."""
    days = spark.sql("select explode(sequence(date'1860-01-01', date'2230-12-31')) as date")
    ruled = {r[0] for r in days.filter(is_holiday(F.col("date"))).collect()}
    assert ruled == {r["date"] for r in holiday_calendar(spark, 1860, 2230).collect()}
    assert {dt.date(1985, 12, 25), dt.date(2061, 12, 26)} <= ruled  # 2061: a Sunday is observed


def test_no_time_is_no_holiday(spark):
    table = spark.createDataFrame([(1, None), (2, dt.datetime(1985, 12, 25, 3))], COLUMNS)
    assert [r["is_holiday"] for r in add_holiday_flag(table).orderBy("id").collect()] == [0, 1]
