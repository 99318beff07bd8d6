"""Explicit schemas of the raw tables; nothing is inferred."""

from pyspark.sql.types import (
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

from meterlens.config import WEATHER_FEATURES

READINGS = StructType(
    [
        StructField("building_id", LongType()),
        StructField("meter", IntegerType()),
        StructField("timestamp", TimestampNTZType()),
        StructField("meter_reading", DoubleType()),
    ]
)

BUILDINGS = StructType(
    [
        StructField("site_id", IntegerType()),
        StructField("building_id", LongType()),
        StructField("primary_use", StringType()),
        StructField("square_feet", DoubleType()),
        StructField("year_built", DoubleType()),
        StructField("floor_count", DoubleType()),
    ]
)

WEATHER = StructType(
    [StructField("site_id", IntegerType()), StructField("timestamp", TimestampNTZType())]
    + [StructField(name, DoubleType()) for name in WEATHER_FEATURES]
)

METRIC_FILE = StructType(
    [
        StructField("model_name", StringType()),
        StructField(
            "metrics",
            StructType([StructField(n, DoubleType()) for n in ("R2", "RMSE", "MAE", "MAPE")]),
        ),
        StructField("R2", DoubleType()),
        StructField("RMSE", DoubleType()),
        StructField("MAE", DoubleType()),
        StructField("MAPE", DoubleType()),
    ]
)
