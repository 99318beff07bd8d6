"""Aggregations of readings: hourly profiles, means, KPIs and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlens.config import EPS, TARGET
from meterlens.functions.calendar import day_of_week
from meterlens.functions.scalars import building_label


def hourly_profile(
    df: DataFrame, by: list[str] = (), target: str = TARGET, cloud: str | None = None
) -> DataFrame:
    """Mean load by hour of day, for the fleet or per group.

    ``cloud`` adds the mean of a cloud column in the same pass.
    """
    means = [F.avg(target).alias("load")]
    if cloud:
        means.append(F.avg(cloud).alias("cloud"))
    return df.groupBy(*by, F.hour("timestamp").alias("hour")).agg(*means)


def peak_stats(profile: DataFrame, by: list[str] = (), load: str = "load") -> DataFrame:
    """Maximum, mean, minimum, their ratios and the total of a profile."""
    top, mean = F.max(load), F.avg(load)
    return profile.groupBy(*by).agg(
        top.alias("peak_load_kw"),
        mean.alias("avg_load_kw"),
        F.min(load).alias("min_load_kw"),
        (top / (mean + EPS)).alias("peak_to_avg_ratio"),
        (mean / (top + EPS)).alias("load_factor"),
        F.sum(load).alias("total_energy_kwh"),
    )


def building_means(df: DataFrame, by: list[str] = (), target: str = TARGET) -> DataFrame:
    return df.groupBy(*by, "building_id").agg(F.avg(target).alias("mean_load"))


def imbalance(means: DataFrame, by: list[str] = ()) -> DataFrame:
    """Sample std of the building means relative to their mean."""
    return means.groupBy(*by).agg(
        (F.stddev_samp("mean_load") / (F.avg("mean_load") + EPS)).alias("imbalance"),
        F.count("*").alias("n_buildings"),
    )


def kpi_row(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Total, mean of daily totals, peak and number of buildings.

    Days are summed first (one row per day leaves each task); the distinct
    count runs apart, so no row is expanded.
    """
    days = df.groupBy(F.to_date("timestamp").alias("day")).agg(
        F.sum(target).alias("total"), F.max(target).alias("peak")
    )
    buildings = df.agg(F.count_distinct("building_id").alias("n")).scalar()
    return days.agg(
        F.sum("total").alias("total_kwh"),
        F.avg("total").alias("avg_daily_kwh"),
        F.max("peak").alias("peak_kw"),
    ).withColumn("n_buildings", buildings)


def mean_by_timestamp(df: DataFrame, target: str = TARGET) -> DataFrame:
    return df.groupBy("timestamp").agg(F.avg(target).alias("mean_load"))


def weekday_hour_heatmap(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Mean load, one row per weekday and one column per hour (h00..h23)."""
    hour = F.hour("timestamp")
    return df.groupBy(day_of_week("timestamp").alias("day_of_week")).agg(
        *[F.avg(F.when(hour == h, F.col(target))).alias(f"h{h:02d}") for h in range(24)]
    )


def mean_by_month(df: DataFrame, target: str = TARGET) -> DataFrame:
    return df.groupBy(F.month("timestamp").alias("month")).agg(F.avg(target).alias("mean_load"))


def top_buildings(df: DataFrame, n: int = 12, target: str = TARGET) -> DataFrame:
    """The ``n`` buildings with the highest mean load."""
    return (
        building_means(df, target=target)
        .orderBy(F.col("mean_load").desc(), "building_id")
        .limit(n)
        .select("building_id", building_label(F.col("building_id")).alias("label"), "mean_load")
    )


def load_audit(readings: DataFrame, target: str = TARGET) -> DataFrame:
    """Rows read, kept and removed, and the time range, in one pass."""
    keep = F.col(target) > 0
    return readings.agg(
        F.count("*").alias("rows_read"),
        F.count_if(keep).alias("rows_kept"),
        F.count_if(~F.coalesce(keep, F.lit(False))).alias("rows_removed"),
        F.count_distinct("building_id").alias("n_buildings"),
        F.min("timestamp").alias("first_ts"),
        F.max("timestamp").alias("last_ts"),
    )


def site_audit(readings: DataFrame, buildings: DataFrame) -> DataFrame:
    """Distinct sites and buildings that have readings, and readings without a building."""
    sites = buildings.select("building_id", "site_id")
    sized = readings.groupBy("building_id").agg(F.count("*").alias("n"))
    return sized.join(sites, "building_id", "left").agg(
        F.count_distinct("site_id").alias("n_sites"), F.count("*").alias("n_buildings"),
        F.coalesce(F.sum(F.when(F.col("site_id").isNull(), F.col("n"))), F.lit(0)).alias("n_unplaced"),
    )


def split_audit(split: DataFrame) -> DataFrame:
    """Rows and time range of the training and validation parts."""
    return split.groupBy("is_val").agg(
        F.count("*").alias("n"),
        F.min("timestamp").alias("first_ts"),
        F.max("timestamp").alias("last_ts"),
    )
