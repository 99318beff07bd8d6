"""Forecast models on ``pyspark.ml``; predictions are (id, ts, actual, prediction)."""

from __future__ import annotations

import queue
import time
import uuid
from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlens.config import ABLATION_GROUPS, LOOKBACK, TARGET, ForestParams, TreeParams
from meterlens.functions.scalars import clamp, corrected, unstandardise
from meterlens.operators.blend import weighted_ensemble
from meterlens.operators.filters import with_history
from meterlens.operators.scores import add_standardised, fit_scaler, model_metrics, stack_results
from meterlens.operators.windows import STATISTICS, add_sequence_statistics, add_sequences
from meterlens.plans.features import feature_branches, without_group
from meterlens.session import settle
from meterlens.sources.readers import require_rows

KEYS = ["building_id", "timestamp"]
RESULT = [*KEYS, "actual", "prediction"]


def parts(matrix: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(training rows, validation rows) of a matrix with ``is_val``."""
    return matrix.filter(~F.col("is_val")), matrix.filter(F.col("is_val"))


def _assembled(features: list[str], estimator) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), estimator])


def boosted_trees(p: TreeParams = TreeParams(), early_stop: bool = False, label: str = TARGET):
    """Gradient-boosted trees; stopping early is opt-in (needs ``is_val`` rows)."""
    model = GBTRegressor(
        labelCol=label, predictionCol="_raw", maxIter=p.trees, maxDepth=p.depth,
        stepSize=p.learning_rate, subsamplingRate=p.row_fraction,
        featureSubsetStrategy=str(p.column_fraction), seed=p.seed,
        checkpointInterval=20,
    )
    return model.setValidationIndicatorCol("is_val") if early_stop else model


def random_forest(p: ForestParams = ForestParams(), label: str = TARGET):
    return RandomForestRegressor(
        labelCol=label, predictionCol="_raw", numTrees=p.trees, maxDepth=p.depth,
        minInstancesPerNode=p.min_leaf, featureSubsetStrategy="sqrt", seed=p.seed,
    )


def ridge(label: str = TARGET, penalty: float = 1e-3):
    return LinearRegression(
        labelCol=label, predictionCol="_raw", regParam=penalty, elasticNetParam=0.0
    )


def fit_tabular(matrix: DataFrame, features: list[str], estimator) -> PipelineModel:
    early = estimator.hasParam("validationIndicatorCol") and estimator.isSet(
        "validationIndicatorCol"
    )
    rows = matrix if early else matrix.filter(~F.col("is_val"))
    return _assembled(features, estimator).fit(rows)


def predict(model: PipelineModel, rows: DataFrame, target: str = TARGET) -> DataFrame:
    scored = model.transform(rows)
    return scored.select(*KEYS, F.col(target).alias("actual"), clamp(F.col("_raw")).alias("prediction"))


def feature_importance(model: PipelineModel, features: list[str], spark: SparkSession) -> DataFrame:
    """(feature, importance), most important first."""
    values = model.stages[-1].featureImportances.toArray()
    rows = [(f, float(v)) for f, v in zip(features, values)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.col("importance").desc(), "feature"
    )


def top_importance(importance: DataFrame, n: int = 20) -> DataFrame:
    return importance.orderBy(F.col("importance").desc(), "feature").limit(n)


def standardised_regression(matrix: DataFrame, features: list[str], target: str = TARGET) -> DataFrame:
    """Linear regression on standardised inputs and target, scaled back."""
    train, val = parts(matrix)
    columns = [*features, target]
    fitted = fit_scaler(train, columns)
    inputs = [f"{f}_scaled" for f in features]
    model = _assembled(inputs, ridge(f"{target}_scaled")).fit(
        add_standardised(train, columns, fitted)
    )
    mean, std = fitted[target]
    raw = unstandardise(F.col("_raw"), F.lit(mean), F.lit(std))
    return model.transform(add_standardised(val, columns, fitted)).select(
        *KEYS, F.col(target).alias("actual"), clamp(raw).alias("prediction")
    )


def two_branch_regression(matrix: DataFrame, features: list[str]) -> DataFrame:
    """Temporal and contextual features fitted apart, then blended by 1/RMSE^2."""
    temporal, context = feature_branches(features)
    branches = {
        "temporal": standardised_regression(matrix, temporal),
        "contextual": standardised_regression(matrix, context),
    }
    return weighted_ensemble(stack_results(branches))


def residual_model(
    matrix: DataFrame, features: list[str], base, lookback: int = LOOKBACK, target: str = TARGET
) -> DataFrame:
    """Boosted trees plus a ridge on the previous ``lookback`` residuals.

    Residual histories are windows over training and validation rows, so a
    validation row sees the training rows before it. Rows without a full
    history keep the base forecast.
    """
    model = fit_tabular(matrix, features, base)
    scored = model.transform(matrix).select(
        *KEYS, "is_val", F.col(target).alias("actual"), F.col("_raw").alias("base"),
        (F.col(target) - F.col("_raw")).alias("residual"),
    )
    eligible = with_history(scored.filter(~F.col("is_val")), ["building_id"], lookback)
    known = eligible.select("building_id").distinct()
    sequences = add_sequences(scored, channels=["residual"], lookback=lookback).join(
        known, "building_id", "left_semi"
    ).withColumn("features", array_to_vector("sequence"))
    known_residuals = sequences.filter(~F.col("is_val"))
    if known_residuals.isEmpty():
        return scored.filter("is_val").select(
            *KEYS, "actual", clamp(F.col("base")).alias("prediction")
        )
    correction = ridge("residual").fit(known_residuals)
    corrections = correction.transform(sequences.filter(F.col("is_val"))).select(
        *KEYS, F.col("_raw").alias("correction")
    )
    return (
        scored.filter(F.col("is_val"))
        .join(corrections, KEYS, "left")
        .select(*KEYS, "actual", corrected(F.col("base"), F.col("correction")).alias("prediction"))
    )


def sequence_regression(matrix: DataFrame, lookback: int = LOOKBACK, target: str = TARGET) -> DataFrame:
    """Ridge on pooled statistics of the previous ``lookback`` rows."""
    enough = with_history(
        matrix.filter(~F.col("is_val")), ["building_id"], lookback
    ).select("building_id").distinct()
    rows = add_sequence_statistics(matrix.select(*KEYS, "is_val", target), target=target, lookback=lookback)
    pooled = rows.join(enough, "building_id", "left_semi")
    require_rows(pooled.filter(~F.col("is_val")), f"training rows with {lookback} rows before them")
    model = fit_tabular(pooled, list(STATISTICS), ridge(target))
    return predict(model, pooled.filter(F.col("is_val")), target)


def ablation(
    matrix: DataFrame, features: list[str], estimator: Callable[[], object],
    groups: dict[str, list[str]] = ABLATION_GROUPS,
) -> DataFrame:
    """Validation metrics without each feature group, and the change of R2.

    ``matrix`` should be materialised; every run refits on the same split.
    """
    runs = {"baseline": features, **{g: without_group(features, g) for g in groups}}
    val = matrix.filter(F.col("is_val"))
    results = {
        name: predict(fit_tabular(matrix, kept, estimator()), val) for name, kept in runs.items()
    }
    metrics = model_metrics(stack_results(results))
    base = metrics.filter(F.col("model") == "baseline").select("r2").scalar()
    sizes = F.create_map(*[x for n, kept in runs.items() for x in (F.lit(n), F.lit(len(kept)))])
    return metrics.select(
        F.col("model").alias("without"), sizes[F.col("model")].alias("n_features"),
        "r2", "rmse", "mae", "mape", (F.col("r2") - base).alias("delta_r2"),
    )


def train_suite(
    spark: SparkSession,
    members: dict[str, Callable[[], DataFrame]],
    timeout: float | None = None,
    parallel: int = 3,
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Run every member to its end; one that fails or hangs becomes a status row, the rest go on.

    ``parallel`` members run at a time, each in a scheduler pool and a job group of its own.
    One that takes more than ``timeout`` seconds is given up: its jobs are cancelled, and so
    are those it would still start. Predictions are written as they are made, so a fault while
    scoring belongs to its member. Status is (model, status, message), status being ok, failed
    or timeout, in the order of ``members``.
    """
    context, suite = spark.sparkContext, uuid.uuid4().hex
    ended: queue.Queue = queue.Queue()

    def run(name: str) -> None:
        context.setJobGroup(f"{suite}-{name}", f"member {name}", interruptOnCancel=True)
        context.setLocalProperty("spark.scheduler.pool", name)
        try:
            ended.put((name, "ok", "", settle(members[name]())))
        except Exception as error:  # noqa: BLE001 - any member may fail on its own
            ended.put((name, "failed", str(error), None))

    waiting, running = list(members), {}
    results, status = {}, {}
    while waiting or running:
        while waiting and len(running) < parallel:
            name = waiting.pop(0)
            running[name] = time.monotonic()
            InheritableThread(target=run, args=(name,), daemon=True, session=spark).start()
        try:
            left = None if timeout is None else min(running.values()) + timeout - time.monotonic()
            name, state, message, table = ended.get(timeout=None if left is None else max(left, 0))
            if running.pop(name, None) is not None:  # else it was given up before
                status[name] = state, message
                if state == "ok":
                    results[name] = table
        except queue.Empty:
            late = min(running, key=running.get)
            del running[late]
            context._jsc.sc().cancelJobGroupAndFutureJobs(f"{suite}-{late}")
            status[late] = "timeout", f"not ended after {timeout} seconds"
    rows = [(name, *status[name]) for name in members]
    return results, spark.createDataFrame(rows, "model string, status string, message string")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def rescore(path: str, rows: DataFrame, name: str) -> DataFrame:
    """Predictions of a saved model on new rows, labelled with its name."""
    return predict(PipelineModel.load(path), rows).withColumn("model", F.lit(name))
