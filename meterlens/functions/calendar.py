"""Calendar columns of a timestamp, and the holiday calendar table."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlens.session import bounded_broadcast


def day_of_week(ts) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(ts)


def semester_period(ts) -> Column:
    """1 for January-May, 2 for August-December, 0 in summer."""
    month = F.month(ts)
    return F.when(month <= 5, 1).when(month >= 8, 2).otherwise(0)


def calendar_columns(ts: str = "timestamp") -> dict[str, Column]:
    """The calendar features that need no holiday table."""
    return {
        "hour": F.hour(ts),
        "day_of_week": day_of_week(ts),
        "day_of_month": F.dayofmonth(ts),
        "month": F.month(ts),
        "week_of_year": F.weekofyear(ts),
        "quarter": F.quarter(ts),
        "is_weekend": (day_of_week(ts) >= 5).cast("int"),
        "semester_period": semester_period(ts),
    }


def cyclical_columns(ts: str = "timestamp") -> dict[str, Column]:
    """Sine and cosine of the hour, weekday and month angles."""

    def turn(value: Column, period: int) -> Column:
        return 2 * F.pi() * value / period

    hour, dow, month = turn(F.hour(ts), 24), turn(day_of_week(ts), 7), turn(F.month(ts), 12)
    return {
        "hour_sin": F.sin(hour), "hour_cos": F.cos(hour),
        "dow_sin": F.sin(dow), "dow_cos": F.cos(dow),
        "month_sin": F.sin(month), "month_cos": F.cos(month),
    }


def add_time_features(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    return df.select("*", *[c.alias(n) for n, c in {
        **calendar_columns(ts), **cyclical_columns(ts)
    }.items()])


# US federal holidays (fixed values): name, month, day, first year.
FIXED_DAYS = [
    ("New Year's Day", 1, 1, 1871),
    ("Juneteenth National Independence Day", 6, 19, 2021),
    ("Independence Day", 7, 4, 1871),
    ("Veterans Day", 11, 11, 1938),
    ("Christmas Day", 12, 25, 1871),
]
# Name, month, weekday, n-th occurrence (0 = last), first year (fixed values).
FLOATING_DAYS = [
    ("Martin Luther King Jr. Day", 1, "Mon", 3, 1986),
    ("Washington's Birthday", 2, "Mon", 3, 1971),
    ("Memorial Day", 5, "Mon", 0, 1971),
    ("Labor Day", 9, "Mon", 1, 1894),
    ("Columbus Day", 10, "Mon", 2, 1971),
    ("Thanksgiving", 11, "Thu", 4, 1942),
]
# As Spark numbers them.
WEEKDAYS = {"Mon": 0, "Tue": 1, "Wed": 2, "Thu": 3, "Fri": 4, "Sat": 5, "Sun": 6}


def _fixed_dates() -> str:
    """SQL array of the fixed days of ``year`` and the days they are observed on."""
    entries = []
    for name, month, day, since in FIXED_DAYS:
        date, label = f"make_date(year, {month}, {day})", name.replace("'", "''")
        entries.append(f"struct('{label}' as holiday, {date} as date, {since} as since)")
        entries.append(
            f"struct('{label} (observed)' as holiday, case weekday({date})"
            f" when 5 then date_sub({date}, 1) when 6 then date_add({date}, 1) end as date,"
            f" {since} as since)"
        )
    return ", ".join(entries)


def _floating_dates() -> str:
    """SQL array of the n-th (or last) weekdays of a month of ``year``."""
    entries = []
    for name, month, day, n, since in FLOATING_DAYS:
        start, label = f"make_date(year, {month}, 1)", name.replace("'", "''")
        if n == 0:
            date = f"next_day(date_sub(last_day({start}), 7), '{day}')"
        else:
            date = f"date_add(next_day(date_sub({start}, 1), '{day}'), {7 * (n - 1)})"
        entries.append(f"struct('{label}' as holiday, {date} as date, {since} as since)")
    return ", ".join(entries)


def holiday_calendar(spark: SparkSession, first_year: int = 1990, last_year: int = 2060) -> DataFrame:
    """(date, holiday) by rule, about 13 rows per year, one row per date.

    Fixed days on a Saturday are observed the day before, on a Sunday the day
    after; both the day itself and the observed day are listed.
    """
    return (
        spark.range(first_year, last_year + 2)
        .selectExpr("cast(id as int) as year")
        .selectExpr("year", f"inline(array({_fixed_dates()}, {_floating_dates()}))")
        .filter(
            f"date is not null and year >= since"
            f" and year(date) between {first_year} and {last_year}"
        )
        .groupBy("date")
        .agg(F.min("holiday").alias("holiday"))
    )


def is_holiday(day: Column) -> Column:
    """Is the date a federal holiday or the weekday it is observed on? Holds for every year."""

    def fixed(date: Column) -> Column:
        rules = [
            (F.month(date) == month) & (F.dayofmonth(date) == nth) & (F.year(date) >= since)
            for _, month, nth, since in FIXED_DAYS
        ]
        return reduce(or_, rules)

    def floating(month: int, name: str, n: int, since: int) -> Column:
        # The n-th weekday of its month, or the one whose next is in another month.
        nth = F.dayofmonth(day) > F.dayofmonth(F.last_day(day)) - 7 if n == 0 else \
            F.ceil(F.dayofmonth(day) / 7) == n
        return (F.month(day) == month) & (F.weekday(day) == WEEKDAYS[name]) & nth & (F.year(day) >= since)

    friday_before = (F.weekday(day) == WEEKDAYS["Fri"]) & fixed(F.date_add(day, 1))
    monday_after = (F.weekday(day) == WEEKDAYS["Mon"]) & fixed(F.date_sub(day, 1))
    moving = [floating(*rule) for _, *rule in FLOATING_DAYS]
    return F.coalesce(reduce(or_, moving, fixed(day) | friday_before | monday_after), F.lit(False))


def add_holiday_flag(df: DataFrame, calendar: DataFrame | None = None, ts: str = "timestamp") -> DataFrame:
    """``is_holiday`` 0/1: is the date of ``ts`` a federal holiday, or in ``calendar`` if given?"""
    if calendar is None:
        return df.withColumn("is_holiday", is_holiday(F.to_date(ts)).cast("int"))
    days = bounded_broadcast(calendar.select(F.col("date").alias("_date")))
    return (
        df.join(days, F.to_date(ts) == F.col("_date"), "left")
        .select(*df.columns, F.col("_date").isNotNull().cast("int").alias("is_holiday"))
    )
