"""Joins that enrich readings and align predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlens.config import BUILDING_FEATURES, WEATHER_FEATURES
from meterlens.operators.fills import fill_along_time, fill_medians, fill_zero
from meterlens.session import SMALL_BYTES, bounded_broadcast, is_small, settle


def join_buildings(readings: DataFrame, buildings: DataFrame) -> DataFrame:
    """Left join of the building columns; readings without a building stay."""
    columns = ["building_id", "site_id", *BUILDING_FEATURES]
    return readings.join(bounded_broadcast(buildings.select(*columns)), "building_id", "left")


def join_weather(readings: DataFrame, weather: DataFrame) -> DataFrame:
    """Left join on the exact (site, hour); missing weather becomes 0."""
    present = [c for c in WEATHER_FEATURES if c in weather.columns]
    right = bounded_broadcast(weather.select("site_id", "timestamp", *present))
    return fill_zero(readings.join(right, ["site_id", "timestamp"], "left"), present)


def join_observations(
    readings: DataFrame, observations: DataFrame, first: Column, last: Column, **sizing
) -> DataFrame:
    """Weather as of each reading, from observations alone: no row per site and hour is made.

    Equal to filling every hour from ``first`` to ``last`` along time and joining on the exact
    hour. An observation holds from its hour up to the next one of its site; the first also
    holds back to ``first``, the last on to ``last``. Readings outside, of other sites, or
    without site or time get 0. A site has one row per day it is observed on, with that day's
    observations in order, and the days of a gap carry the last value before it, so a reading
    meets one row and looks through one day. Several observations of an hour: the greatest
    holds, value by value in the order of the columns.
    """
    present = [c for c in WEATHER_FEATURES if c in observations.columns]
    known = observations.filter(F.col("timestamp").isNotNull() & F.col("site_id").isNotNull())
    filled = fill_along_time(known.select("site_id", "timestamp", *present), ["site_id"], present, **sizing)
    days = filled.groupBy("site_id", F.to_date("timestamp").alias("_day")).agg(
        F.sort_array(F.collect_list(F.struct("timestamp", *present))).alias("_seen")
    )
    along = Window.partitionBy("site_id").orderBy("_day")
    placed = days.select(
        "site_id", "_day", "_seen", F.get("_seen", F.size("_seen") - 1).alias("_latest"),
        F.lag("_seen").over(along).alias("_earlier"), F.lead("_day").over(along).alias("_next"),
    ).withColumn("_carry", F.coalesce(
        F.get("_earlier", F.size("_earlier") - 1), F.get("_seen", F.lit(0))  # the first holds back
    ))
    gap_end = F.coalesce(F.date_sub("_next", 1), F.to_date(last))
    after = placed.filter(gap_end > F.col("_day")).select(
        "site_id", F.explode(F.sequence(F.date_add("_day", 1), gap_end)).alias("_day"),
        F.lit(None).cast(days.schema["_seen"].dataType).alias("_seen"), F.col("_latest").alias("_carry"),
    )
    start = F.to_date(first)
    before = placed.filter(F.col("_earlier").isNull() & (start < F.col("_day"))).select(
        "site_id", F.explode(F.sequence(start, F.date_sub("_day", 1))).alias("_day"),
        F.lit(None).cast(days.schema["_seen"].dataType).alias("_seen"), "_carry",
    )
    held = placed.select("site_id", "_day", "_seen", "_carry").unionByName(after).unionByName(before)
    ts = F.col("timestamp")
    inside = F.when((ts >= first) & (ts <= last), F.to_date(ts))
    joined = readings.withColumn("_day", inside).join(held, ["site_id", "_day"], "left")
    sofar = F.filter("_seen", lambda o: o["timestamp"] <= ts)
    at = joined.withColumn("_at", F.coalesce(F.get(sofar, F.size(sofar) - 1), F.col("_carry")))
    return fill_zero(at.select(*readings.columns, *(F.col(f"_at.{c}").alias(c) for c in present)), present)


def enrich(
    readings: DataFrame, buildings: DataFrame, weather: DataFrame, small_bytes: int = SMALL_BYTES
) -> DataFrame:
    """Readings with building and weather columns and no missing values.

    ``buildings`` and ``weather`` are expected filled. Building columns still
    missing after the join (ids without metadata) get the median over the
    joined rows, so a building weighs as much as it has readings.
    """
    joined = join_buildings(readings, buildings)
    medians = _weighted_medians(readings, buildings, small_bytes)
    return join_weather(fill_medians(joined, BUILDING_FEATURES, medians=medians), weather)


def _weighted_medians(
    readings: DataFrame, buildings: DataFrame, small_bytes: int
) -> Column | None:
    """Medians over the joined rows from one row per building and its count.

    Large readings are reduced to (building, count) once; the exact weighted
    percentile then runs on that table, if it is small enough for one buffer.
    """
    if is_small(readings, small_bytes):
        return None
    sizes = readings.groupBy("building_id").agg(F.count("*").alias("n"))
    sized = settle(join_buildings(sizes, buildings).select("n", *BUILDING_FEATURES))
    if not is_small(sized):
        return None
    return sized.agg(
        F.struct(*[
            F.percentile(c, F.lit(0.5), F.col("n")).alias(c) for c in BUILDING_FEATURES
        ]).alias("m")
    ).scalar()


def scatter_predictions(rows: DataFrame, predictions: DataFrame, drop_missing: bool = False) -> DataFrame:
    """Predictions placed on all validation rows by key; unfilled rows get 0."""
    keys = ["building_id", "timestamp"]
    joined = rows.join(predictions.select(*keys, "prediction"), keys, "left")
    if drop_missing:
        return joined.filter(F.col("prediction").isNotNull())
    return joined.withColumn("prediction", F.coalesce("prediction", F.lit(0.0)))


def align_models(predictions: DataFrame, models: list[str]) -> DataFrame:
    """One column per model; only rows that every model predicts."""
    columns = [
        F.max(F.when(F.col("model") == m, F.col("prediction"))).alias(m) for m in models
    ]
    return (
        predictions.groupBy("building_id", "timestamp")
        .agg(F.max("actual").alias("actual"), *columns)
        .dropna(subset=models)
    )
