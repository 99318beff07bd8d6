"""Row filters. All are plain predicates that reach the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterlens.config import TARGET, TARGET_METER, TARGET_USE
from meterlens.functions.scalars import is_finite
from meterlens.session import bounded_broadcast


def lodging(buildings: DataFrame, use: str = TARGET_USE) -> DataFrame:
    return buildings.filter(F.col("primary_use") == use)


def target_meter(readings: DataFrame, meter: int = TARGET_METER) -> DataFrame:
    return readings.filter(F.col("meter") == meter)


def positive(readings: DataFrame, target: str = TARGET) -> DataFrame:
    return readings.filter(F.col(target) > 0)


def in_buildings(readings: DataFrame, ids: list[int] | DataFrame) -> DataFrame:
    """Readings of a short id list (pushed down) or of an id table (semi-join)."""
    if isinstance(ids, DataFrame):
        members = bounded_broadcast(ids.select("building_id"))
        return readings.join(members, "building_id", "left_semi")
    return readings.filter(F.col("building_id").isin(*ids))


def select_readings(
    readings: DataFrame, buildings: DataFrame, ids: list[int] | None = None
) -> DataFrame:
    """Positive electricity readings of the listed or all lodging buildings."""
    wanted = ids if ids is not None else lodging(buildings)
    return positive(in_buildings(target_meter(readings), wanted))


def finite_pairs(predictions: DataFrame) -> DataFrame:
    """Rows whose actual and prediction are both finite numbers."""
    return predictions.filter(is_finite("actual") & is_finite("prediction"))


def with_history(df: DataFrame, keys: list[str], more_than: int) -> DataFrame:
    """Rows of groups that hold more than ``more_than`` rows."""
    long_enough = (
        df.groupBy(*keys).count().filter(F.col("count") > more_than).select(*keys)
    )
    return df.join(bounded_broadcast(long_enough), keys, "left_semi")


def tail_rows(df: DataFrame, keys: list[str], n: int, ts: str = "timestamp") -> DataFrame:
    """Last ``n`` rows of every group.

    Spark trims every map task to ``n`` rows per group before the shuffle
    (up to ``spark.sql.optimizer.windowGroupLimitThreshold``), so a hot group
    never travels whole.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(ts).desc())
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def first_rows(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """First ``n`` rows of every group in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def valid_models(predictions: DataFrame) -> DataFrame:
    """Predictions of non-empty models; nothing at all for a single model."""
    counted = (
        predictions.groupBy("model")
        .agg(F.count("prediction").alias("n"))
        .filter(F.col("n") > 0)
    )
    several = counted.agg((F.count("*") >= 2).alias("enough")).scalar()
    return predictions.join(F.broadcast(counted.select("model")), "model", "left_semi").filter(several)


def pending_models(wanted: DataFrame, metrics: DataFrame) -> DataFrame:
    """Wanted models without a saved metric row (resume a broken run)."""
    return wanted.join(metrics.select("model"), "model", "left_anti")


def subsample(df: DataFrame, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """Repeatable random sample of exactly ``min(n, count)`` rows."""
    return df.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(n)
