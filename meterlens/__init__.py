"""Spark-native analytics for hourly building meters."""

__version__ = "0.1.0"
