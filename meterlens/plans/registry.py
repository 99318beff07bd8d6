"""Saved models under one registry, scored again as a batch.

A registry is a folder. ``versions/<n>`` holds a table with one row per model (name, kind,
columns, path, version); ``results/<n>`` holds the predictions, metrics and status of one
scoring. A version is written as a whole and counts from the moment its ``_SUCCESS`` file
stands, which the writer puts there last, so readers see the old one or the new one and
never a part. A failed run leaves a folder without that file, which nobody reads.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlens.config import TARGET
from meterlens.operators.blend import stacked_ensemble, weighted_ensemble
from meterlens.operators.scores import model_metrics, stack_results
from meterlens.plans.boosting import Boosted, predict_boosted
from meterlens.plans.forecast import align_forecast, forecast_from, hours_ahead, load_models
from meterlens.plans.models import KEYS, predict
from meterlens.session import settle

ENTRY = "name string, kind string, columns array<string>, path string, version long"
PIPELINE, TREES, SEASONAL = "pipeline", "trees", "seasonal"
WEIGHTED, STACKED = "weighted_ensemble", "stacked_ensemble"


@dataclass(frozen=True)
class Entry:
    """A saved model: its kind says how it is loaded, its columns what rows must have."""

    name: str
    kind: str
    columns: list[str]
    path: str


def _committed(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the finished versions below ``folder``, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    found = [status.getPath() for status in files.listStatus(path)]
    done = [p.getName() for p in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(name) for name in done if name.isdigit())


def _next(spark: SparkSession, folder: str) -> str:
    """Path of a version after all folders there, finished or not."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
    return f"{folder}/{1 + max([int(n) for n in names if n.isdigit()], default=0)}"


class Registry:
    """Models by name; ``save_*`` writes a model and ``publish`` makes a set of them current."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def version(self) -> int | None:
        return max(_committed(self.spark, f"{self.root}/versions"), default=None)

    def entries(self) -> DataFrame:
        """The current table of models; empty before the first is published."""
        current = self.version()
        if current is None:
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).parquet(f"{self.root}/versions/{current}")

    def _path(self, name: str) -> str:
        return _next(self.spark, f"{self.root}/models/{name}")

    def save_pipeline(self, name: str, model: PipelineModel, columns: list[str]) -> Entry:
        path = self._path(name)
        model.write().save(path)
        return Entry(name, PIPELINE, columns, path)

    def save_trees(self, name: str, model: Boosted) -> Entry:
        path = self._path(name)
        model.table(self.spark).write.parquet(path)
        return Entry(name, TREES, model.features, path)

    def save_seasonal(self, name: str, models: DataFrame) -> Entry:
        path = self._path(name)
        models.write.parquet(path)
        return Entry(name, SEASONAL, [], path)

    def publish(self, entries: list[Entry]) -> int:
        """A new version in which these models replace or join those of their names."""
        path = _next(self.spark, f"{self.root}/versions")
        number = int(path.rsplit("/", 1)[1])
        names = [e.name for e in entries]
        if len(set(names)) < len(names):
            raise ValueError("a name occurs twice")
        fresh = self.spark.createDataFrame(
            [(e.name, e.kind, e.columns, e.path, number) for e in entries], ENTRY)
        kept = self.entries().filter(~F.col("name").isin(names)) if names else self.entries()
        kept.unionByName(fresh).coalesce(1).write.parquet(path)
        return number

    def results(self, kind: str) -> DataFrame:
        """``predictions``, ``metrics`` or ``status`` of the latest finished scoring."""
        done = _committed(self.spark, f"{self.root}/results")
        if not done:
            raise ValueError("nothing has been scored yet")
        return self.spark.read.parquet(f"{self.root}/results/{done[-1]}/{kind}")


def _seasonal(spark: SparkSession, path: str, rows: DataFrame, target: str) -> DataFrame:
    """A saved forecast set beside the hours of ``rows``, which follow its training rows."""
    pairs = align_forecast(forecast_from(load_models(spark, path), hours_ahead(rows, target)), rows, target)
    return pairs.select(*KEYS, "actual", "prediction")


LOADERS: dict[str, Callable[[SparkSession, str, DataFrame, str], DataFrame]] = {
    PIPELINE: lambda spark, path, rows, target: predict(PipelineModel.load(path), rows, target),
    TREES: lambda spark, path, rows, target: predict_boosted(spark.read.parquet(path), rows, target),
    SEASONAL: _seasonal,
}


def rescore_all(registry: Registry, rows: DataFrame, target: str = TARGET) -> DataFrame:
    """Score every current model on ``rows``, rebuild the ensembles, and switch the results.

    Returns (model, kind, version, status, message, metrics). A model that cannot be loaded,
    or whose columns ``rows`` lacks, becomes a status row and the rest go on. Ensembles need
    two scored models. Predictions of a model are written before its metrics are taken, so a
    fault while scoring is its own. The loop runs over models; their rows stay in Spark.
    """
    spark = registry.spark
    scored, status = {}, []
    for e in registry.entries().orderBy("name").collect():  # one row per model
        try:
            lacking = sorted(set(e["columns"]) - set(rows.columns))
            if lacking:
                raise ValueError(f"missing columns: {', '.join(lacking)}")
            scored[e["name"]] = settle(LOADERS[e["kind"]](spark, e["path"], rows, target))
            status.append((e["name"], e["kind"], e["version"], "ok", ""))
        except Exception as error:  # noqa: BLE001 - any model may fail on its own
            status.append((e["name"], e["kind"], e["version"], "failed", str(error)[:500]))
    if len(scored) >= 2:
        together, names = stack_results(scored), sorted(scored)
        for name, blend in ((WEIGHTED, lambda: weighted_ensemble(together)),
                            (STACKED, lambda: stacked_ensemble(together, names)[0])):
            try:
                scored[name] = settle(blend())
                status.append((name, "ensemble", None, "ok", ""))
            except Exception as error:  # noqa: BLE001
                status.append((name, "ensemble", None, "failed", str(error)[:500]))
    told = spark.createDataFrame(
        status, "model string, kind string, version long, status string, message string")
    target_folder = _next(spark, f"{registry.root}/results")
    if scored:
        predictions = stack_results(scored)
        predictions.write.partitionBy("model").parquet(f"{target_folder}/predictions")
        metrics = model_metrics(spark.read.parquet(f"{target_folder}/predictions"))
        metrics.coalesce(1).write.parquet(f"{target_folder}/metrics")
        told = told.join(spark.read.parquet(f"{target_folder}/metrics"), "model", "left")
    told.coalesce(1).write.parquet(f"{target_folder}/status")
    marker = spark._jvm.org.apache.hadoop.fs.Path(target_folder, "_SUCCESS")
    marker.getFileSystem(spark._jsc.hadoopConfiguration()).create(marker).close()
    return spark.read.parquet(f"{target_folder}/status")
