"""Scans of raw CSV and processed parquet tables, and the load-or-build rule."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType

from meterlens.sources.schemas import BUILDINGS, READINGS, WEATHER


def nan_to_null(df: DataFrame) -> DataFrame:
    """Operators speak NULL only, so NaN is turned into NULL at the source."""
    return df.select(
        *[
            F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, (DoubleType, FloatType))
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def _csv(spark: SparkSession, path, schema: StructType) -> DataFrame:
    """Read by header name: columns the schema does not list are skipped.

    A file whose header has another order than the first, or a value that is
    not of its column's type, is an error.
    """
    paths = [path] if isinstance(path, str) else list(path)
    header = spark.read.option("header", True).csv(paths).columns
    names = {f.name: f for f in schema.fields}
    full = StructType()
    for name in header:
        full = full.add(names[name]) if name in names else full.add(name, "string")
    table = (
        spark.read.schema(full).option("header", True)
        .option("enforceSchema", False).option("mode", "FAILFAST").csv(paths)
    )
    return nan_to_null(table.select(*[f.name for f in schema.fields if f.name in header]))


def read_readings(spark: SparkSession, path) -> DataFrame:
    return _csv(spark, path, READINGS)


def read_buildings(spark: SparkSession, path) -> DataFrame:
    return _csv(spark, path, BUILDINGS)


def read_weather(spark: SparkSession, path) -> DataFrame:
    return _csv(spark, path, WEATHER)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Processed parquet table; filters and columns are pushed to the scan.

    Folder names are text, so the split flag of a partitioned matrix is turned
    back into a boolean; filters on it still prune whole partitions.
    """
    table = spark.read.parquet(path)
    if dict(table.dtypes).get("is_val") == "string":
        return table.withColumn("is_val", F.col("is_val").cast("boolean"))
    return table


def stack(tables: list[DataFrame]) -> DataFrame:
    """Rows of all tables, columns matched by name."""
    return reduce(lambda a, b: a.unionByName(b), tables)


def load_or_build(
    spark: SparkSession, path: str, build: Callable[[], DataFrame], partition_by: list[str] = ()
) -> DataFrame:
    """Reuse the processed table at ``path``; build and write it when absent."""
    try:
        return read_table(spark, path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER_SCHEMA" not in str(missing):
            raise
    build().write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return read_table(spark, path)


def require_rows(df: DataFrame, what: str = "readings") -> DataFrame:
    """An empty input is an error (job-level check: reads until one row)."""
    if df.isEmpty():
        raise ValueError(f"no {what} left after filtering")
    return df
