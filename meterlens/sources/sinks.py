"""Writers for processed tables, metrics, predictions and plan results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlens.operators.filters import first_rows
from meterlens.sources.schemas import METRIC_FILE

METRICS = ["R2", "RMSE", "MAE", "MAPE"]


def write_split(features: DataFrame, path: str) -> None:
    """Feature matrix with ``is_val``; train and validation are partitions."""
    features.write.mode("overwrite").partitionBy("is_val").parquet(path)


def write_version(df: DataFrame, root: str, version: str) -> str:
    """Write a new version next to the table it was derived from.

    A path that is being read must not be overwritten, so results with extra
    columns go to ``root/version``.
    """
    target = f"{root.rstrip('/')}/{version}"
    df.write.mode("errorifexists").parquet(target)
    return target


def save_metrics(metrics: DataFrame, folder: str) -> None:
    """Metrics (model, r2, rmse, mae, mape), one JSON folder per model."""
    metrics.select(
        F.col("model"),
        F.col("model").alias("model_name"),
        F.struct(*[F.col(m.lower()).alias(m) for m in METRICS]).alias("metrics"),
    ).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("model").json(folder)


def load_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """All saved metrics; files without metrics (e.g. reports) are skipped.

    The model name comes from the content, else from the file name.
    """
    raw = (
        spark.read.schema(METRIC_FILE)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .json(folder)
        .withColumn("_file", F.col("_metadata.file_name"))
    )
    return (
        raw.filter(F.col("_file") != "comparison_report.json")
        .select(
            F.coalesce("model_name", F.regexp_replace("_file", r"\.json$", "")).alias("model"),
            *[F.coalesce(f"metrics.{m}", m).alias(m.lower()) for m in METRICS],
        )
        .filter(F.col("r2").isNotNull())
    )


def registered_metrics(metrics: DataFrame, models: list[str]) -> DataFrame:
    """Only the metrics of registered models (nothing is deleted)."""
    return metrics.filter(F.col("model").isin(*models))


def write_report(report: DataFrame, folder: str) -> None:
    """A one-row report as a single JSON document."""
    report.coalesce(1).write.mode("overwrite").json(folder)


def hour_map(hour: str, value: str) -> Column:
    """Aggregate (hour, value) rows into an hour -> value map of at most 24."""
    return F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(hour), F.col(value)))))


def write_scenarios(results: dict[str, DataFrame], folder: str) -> None:
    """Every scenario table as JSON under its own name."""
    for name, table in results.items():
        table.write.mode("overwrite").json(f"{folder.rstrip('/')}/{name}")


def write_predictions(predictions: DataFrame, folder: str, n: int | None = None) -> None:
    """Validation predictions as JSON, one folder per model; ``n`` keeps the first of each in time."""
    kept = predictions if n is None else first_rows(
        predictions, ["model"], ["timestamp", "building_id"], n
    )
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy("model").json(folder)


def write_importance(importance: DataFrame, folder: str) -> None:
    """(feature, importance) as JSON, most important first."""
    importance.orderBy(F.col("importance").desc(), "feature").coalesce(1) \
        .write.mode("overwrite").json(folder)
