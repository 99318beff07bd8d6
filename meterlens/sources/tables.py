"""Meter views over the star-schema test tables.

Each function returns a lazy DataFrame. ``events`` become hourly readings,
``customer`` the buildings, and the ``error`` events of a nation its weather.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlens.operators.filters import positive, target_meter
from meterlens.operators.windows import history_windows


# Columns in use, so neither schema inference nor unused columns cost a read.
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"
CUSTOMER = "c_custkey bigint, c_nationkey int, c_acctbal double, c_mktsegment string"


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(EVENTS).parquet(f"{folder}/events.parquet")


def _customers(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(CUSTOMER).parquet(f"{folder}/customer.parquet")


def hour_of(ts: str):
    """Timestamp truncated to the hour, without a time zone."""
    return F.date_trunc("hour", F.col(ts)).cast("timestamp_ntz")


def readings(spark: SparkSession, folder: str) -> DataFrame:
    """One row per (building, meter, hour)."""
    hourly = (
        _events(spark, folder)
        .select(
            F.col("user_id").alias("building_id"),
            F.when(F.col("event_type") == "error", 1).otherwise(0).alias("meter"),
            hour_of("ts").alias("timestamp"),
            "value",
        )
        .groupBy("building_id", "meter", "timestamp")
        .agg(F.round(F.sum("value"), 6).alias("total"))
    )
    idle = (F.col("building_id") + F.hour("timestamp")) % 25 == 0
    return hourly.select(
        "building_id",
        "meter",
        "timestamp",
        F.when(idle, F.lit(0.0)).otherwise(F.col("total")).alias("meter_reading"),
    )


def electricity(spark: SparkSession, folder: str) -> DataFrame:
    """Positive readings of the electricity meter: (building_id, timestamp, meter_reading)."""
    return positive(target_meter(readings(spark, folder))).select(
        "building_id", "timestamp", "meter_reading"
    )


def buildings(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    return _customers(spark, folder).select(
        key.alias("building_id"),
        F.col("c_nationkey").alias("site_id"),
        F.when(F.col("c_mktsegment") == "FURNITURE", "Office")
        .otherwise("Lodging/residential")
        .alias("primary_use"),
        (F.abs("c_acctbal") * 10).alias("square_feet"),
        F.when(key % 7 != 0, (1950 + key % 70).cast("double")).alias("year_built"),
        F.when(key % 5 != 0, (1 + key % 12).cast("double")).alias("floor_count"),
    )


def weather_observations(spark: SparkSession, folder: str) -> DataFrame:
    """Sparse observations per site and hour."""
    sites = _customers(spark, folder).select(
        F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("site_id")
    )
    value = F.col("value")
    return (
        _events(spark, folder)
        .filter(F.col("event_type") == "error")
        .select("user_id", hour_of("ts").alias("timestamp"), "value", "event_id")
        .join(sites, "user_id")
        .groupBy("site_id", "timestamp")
        .agg(
            F.round(F.avg(value), 6).alias("air_temperature"),
            F.max(F.col("event_id") % 10).cast("double").alias("cloud_coverage"),
            F.when(F.col("site_id") % 5 != 0, F.min(value)).alias("precip_depth_1_hr"),
            F.round(F.avg(value) / 2, 6).alias("dew_temperature"),
            F.max(value).alias("sea_level_pressure"),
            F.max(F.col("event_id") % 360).cast("double").alias("wind_direction"),
            (F.min(value) / 4).alias("wind_speed"),
        )
    )


def weather_span(spark: SparkSession, folder: str) -> Column:
    """Struct of the hours of the first and last event, as a scalar."""
    return (
        _events(spark, folder)
        .agg(
            F.struct(
                F.date_trunc("hour", F.min("ts")).alias("first"),
                F.date_trunc("hour", F.max("ts")).alias("last"),
            ).alias("span")
        )
        .scalar()
    )


def weather(spark: SparkSession, folder: str) -> DataFrame:
    """Every hour of every site from the first to the last event; mostly NULL."""
    span = weather_span(spark, folder)
    grid = (
        _customers(spark, folder)
        .select(F.col("c_nationkey").alias("site_id"))
        .distinct()
        .select("site_id", span.alias("span"))
        .select(
            "site_id",
            F.explode(
                F.sequence("span.first", "span.last", F.expr("interval 1 hour"))
            ).alias("timestamp"),
        )
        .withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    )
    return grid.join(weather_observations(spark, folder), ["site_id", "timestamp"], "left")


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Three baseline forecasts in long form; rows without history stay NULL."""
    base = history_windows(
        electricity(spark, folder),
        ["building_id"],
        lambda w: {
            "lag1": F.lag("meter_reading", 1).over(w),
            "lag24": F.lag("meter_reading", 24).over(w),
            "roll24": F.round(F.avg("meter_reading").over(w.rowsBetween(-24, -1)), 6),
        },
        halo=24,
    )
    return base.withColumnRenamed("meter_reading", "actual").unpivot(
        ["building_id", "timestamp", "actual"], ["lag1", "lag24", "roll24"], "model", "prediction"
    )
