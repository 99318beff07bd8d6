"""The feature pipeline: raw tables to the model-ready matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegerType, LongType

from meterlens.config import ABLATION_GROUPS, TARGET
from meterlens.functions.calendar import add_holiday_flag, add_time_features
from meterlens.operators.fills import fill_medians, fill_weather
from meterlens.operators.filters import lodging, select_readings
from meterlens.operators.joins import enrich
from meterlens.operators.ranks import chronological_split
from meterlens.operators.windows import add_history_features

# Columns that are never model inputs (fixed values).
NOT_FEATURES = [
    TARGET, "meter_reading_log", "timestamp", "building_id", "meter", "site_id",
    "row_id", "primary_use", "is_val",
]
NUMERIC = (DoubleType, FloatType, IntegerType, LongType)
# Name parts of features that describe the context, not the time (fixed values).
CONTEXT_PARTS = [
    "temperature", "cloud", "dew", "precip", "pressure",
    "wind", "square_feet", "year_built", "floor_count",
]


def filled_buildings(buildings: DataFrame, **sizing) -> DataFrame:
    """Lodging buildings; missing year and floors get the median over them."""
    return fill_medians(lodging(buildings), ["year_built", "floor_count"], **sizing)


def add_log_target(df: DataFrame) -> DataFrame:
    return df.withColumn("meter_reading_log", F.log1p(TARGET))


def feature_matrix(
    readings: DataFrame,
    buildings: DataFrame,
    weather: DataFrame,
    ids: list[int] | None = None,
    calendar: DataFrame | None = None,
) -> DataFrame:
    """Readings with all 43 features and the log target, one lazy plan.

    History features run first, on three narrow columns; buildings, weather
    and holidays are joined afterwards, so the window shuffle stays slim.
    """
    kept = select_readings(readings, buildings, ids).select("building_id", "timestamp", TARGET)
    joined = enrich(add_history_features(kept), filled_buildings(buildings), fill_weather(weather))
    return add_log_target(add_time_features(add_holiday_flag(joined, calendar)))


def run_pipeline(
    readings: DataFrame, buildings: DataFrame, weather: DataFrame, ids: list[int] | None = None,
    **options,
) -> DataFrame:
    """The matrix with the chronological 80/20 split flag ``is_val``.

    The joins keep the rows of the readings, so the split boundary is found on
    those alone.
    """
    matrix = feature_matrix(readings, buildings, weather, ids, **options)
    return chronological_split(matrix, keys_from=select_readings(readings, buildings, ids))


def feature_columns(df: DataFrame, exclude: list[str] = NOT_FEATURES) -> list[str]:
    """Numeric columns that are not keys or targets."""
    return [
        f.name for f in df.schema.fields
        if f.name not in exclude and isinstance(f.dataType, NUMERIC)
    ]


def feature_branches(features: list[str]) -> tuple[list[str], list[str]]:
    """(temporal, contextual) features by name; anything unknown is temporal."""
    context = [f for f in features if any(part in f for part in CONTEXT_PARTS)]
    return [f for f in features if f not in context], context


def without_group(features: list[str], group: str) -> list[str]:
    return [f for f in features if f not in ABLATION_GROUPS[group]]
