"""Anomaly detectors, votes and severity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlens.config import TARGET
from meterlens.functions.scalars import deviation_pct, total, zscore
from meterlens.session import bounded_broadcast

FLAGS = ["anomaly_if", "anomaly_zscore", "anomaly_ae"]


def add_group_stats(
    df: DataFrame, keys: list[str] = ("building_id",), target: str = TARGET
) -> DataFrame:
    """Mean and sample std of the group on every row.

    The statistics are aggregated with partial sums and joined back, so the
    readings are not shuffled by building and a hot building stays spread.
    """
    stats = df.groupBy(*keys).agg(
        F.avg(target).alias("_mean"), F.stddev_samp(target).alias("_std")
    )
    return df.join(bounded_broadcast(stats), list(keys), "left")


def _zscore_columns(target: str, threshold: float):
    z = zscore(F.col(target), F.col("_mean"), F.col("_std"))
    return [
        z.alias("zscore"),
        F.coalesce((F.abs(z) > threshold).cast("int"), F.lit(0)).alias("anomaly_zscore"),
    ]


def detect_zscore(
    df: DataFrame, threshold: float = 3.0, keys: list[str] = ("building_id",), target: str = TARGET
) -> DataFrame:
    """Rows far from the mean of their building (and the deviation in percent)."""
    return add_group_stats(df, keys, target).select(
        *df.columns,
        *_zscore_columns(target, threshold),
        deviation_pct(F.col(target), F.col("_mean")).alias("deviation_pct"),
    )


def classify_severity(df: DataFrame, flags: list[str] = FLAGS) -> DataFrame:
    """Votes over an explicit list of flags and the severity they imply."""
    present = [f for f in flags if f in df.columns]
    votes = total([F.lit(0), *[F.coalesce(F.col(f), F.lit(0)) for f in present]])
    graded = df.withColumn("anomaly_votes", votes)
    v = F.col("anomaly_votes")
    return graded.select(
        "*",
        (v >= 1).cast("int").alias("is_anomaly"),
        F.when(v >= 3, "High").when(v == 2, "Medium").when(v == 1, "Low")
        .otherwise("Normal").alias("severity"),
    )


def anomaly_rates(df: DataFrame, flags: list[str]) -> DataFrame:
    """(detector, n, pct) of every flag, in one pass."""
    return df.agg(
        F.array(*[
            F.struct(
                F.lit(f).alias("detector"),
                F.sum(f).cast("long").alias("n"),
                (F.avg(f) * 100).alias("pct"),
            )
            for f in flags
        ]).alias("r")
    ).select(F.inline("r"))


def severity_counts(df: DataFrame) -> DataFrame:
    return (
        df.filter(F.col("is_anomaly") == 1).groupBy("severity").agg(F.count("*").alias("n"))
    )


def recent_alerts(df: DataFrame, n: int = 10) -> DataFrame:
    """The most recent anomalies, newest first."""
    return (
        df.filter(F.col("is_anomaly") == 1)
        .orderBy(F.col("timestamp").desc(), "building_id")
        .limit(n)
    )


def anomaly_timeline(df: DataFrame, n: int = 5000) -> DataFrame:
    """First rows by building and time, for a timeline plot."""
    return df.orderBy("building_id", "timestamp").limit(n)
