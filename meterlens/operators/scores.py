"""Forecast quality: metrics, leaderboards, histograms and scaling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlens.functions.scalars import rounded_metrics, standardise
from meterlens.operators.filters import finite_pairs, first_rows

METRIC_NAMES = ["r2", "rmse", "mae", "mape"]


def model_metrics(predictions: DataFrame, by: list[str] = ("model",), rounded: bool = True) -> DataFrame:
    """R2, RMSE, MAE and MAPE of every model in one grouped pass.

    Rows with a non-finite value are left out. R2 is NULL when the actuals do
    not vary; MAPE skips zero actuals and is infinite when all are zero.
    """
    actual, error = F.col("actual"), F.col("actual") - F.col("prediction")
    spread = F.var_pop("actual") * F.count("actual")
    share = F.avg(F.when(actual != 0, F.abs(error / actual)))
    metrics = finite_pairs(predictions).groupBy(*by).agg(
        F.when(spread > 0, 1 - F.sum(error * error) / spread).alias("r2"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        F.coalesce(share * 100, F.lit(float("inf"))).alias("mape"),
        F.count("*").alias("n"),
    )
    if not rounded:
        return metrics
    places = rounded_metrics()
    return metrics.select(*by, *[F.bround(m, places[m]).alias(m) for m in METRIC_NAMES], "n")


def leaderboard(metrics: DataFrame) -> DataFrame:
    """Models by R2, best first, ranked from 1 (one row per model)."""
    w = Window.orderBy(F.col("r2").desc_nulls_last(), "model")
    return metrics.select(F.row_number().over(w).alias("rank"), "model", *METRIC_NAMES)


def best_by_metric(metrics: DataFrame) -> DataFrame:
    """(metric, model, value): highest R2, lowest RMSE, MAE and MAPE."""

    def entry(metric: str) -> Column:
        pick, edge = (F.max_by, F.max) if metric == "r2" else (F.min_by, F.min)
        return F.struct(
            F.lit(metric).alias("metric"),
            pick("model", metric).alias("model"),
            edge(metric).alias("value"),
        )

    return metrics.agg(F.array(*[entry(m) for m in METRIC_NAMES]).alias("best")).select(
        F.inline("best")
    )


def comparison_report(metrics: DataFrame) -> DataFrame:
    """One row: the leaderboard array and the best model per metric."""
    board = leaderboard(metrics).agg(
        F.sort_array(F.collect_list(F.struct("rank", "model", *METRIC_NAMES))).alias("leaderboard")
    )
    best = best_by_metric(metrics).agg(
        F.map_from_entries(
            F.collect_list(F.struct("metric", F.struct("model", "value")))
        ).alias("best_by_metric")
    )
    return board.select("leaderboard", best.scalar().alias("best_by_metric"))


def compare_two(metrics: DataFrame, first: str, second: str) -> DataFrame:
    """Metrics of two models side by side."""
    long = metrics.filter(F.col("model").isin(first, second)).unpivot(
        ["model"], METRIC_NAMES, "metric", "value"
    )
    return long.groupBy("metric").agg(
        *[F.max(F.when(F.col("model") == m, F.col("value"))).alias(m) for m in (first, second)]
    )


def add_residuals(predictions: DataFrame) -> DataFrame:
    error = F.col("actual") - F.col("prediction")
    return predictions.select("*", error.alias("residual"), F.abs(error).alias("abs_residual"))


def error_histogram(predictions: DataFrame, bins: int = 60) -> DataFrame:
    """Counts of errors in equal bins per model; the top edge is in the last bin.

    Every bin is listed, empty ones with 0. ``mean_error`` repeats per model.
    """
    errors = finite_pairs(predictions).select(
        "model", (F.col("actual") - F.col("prediction")).alias("error")
    )
    edges = errors.groupBy("model").agg(
        F.min("error").alias("low"), F.max("error").alias("high"), F.avg("error").alias("mean_error")
    )
    width = (F.col("high") - F.col("low")) / bins
    number = F.when(width > 0, F.floor((F.col("error") - F.col("low")) / width) + 1).otherwise(1)
    counts = (
        errors.join(F.broadcast(edges), "model")
        .groupBy("model", F.least(number, F.lit(bins)).cast("int").alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    spine = edges.select(
        "model", "low", width.alias("width"), "mean_error",
        F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"),
    )
    return spine.join(counts, ["model", "bin"], "left").select(
        "model",
        "bin",
        (F.col("low") + F.col("width") * (F.col("bin") - 1)).alias("bin_start"),
        F.coalesce("n", F.lit(0)).alias("n"),
        "mean_error",
    )


def scatter_bounds(predictions: DataFrame) -> DataFrame:
    """Common axis limits of actuals and predictions per model."""
    return finite_pairs(predictions).groupBy("model").agg(
        F.least(F.min("actual"), F.min("prediction")).alias("low"),
        F.greatest(F.max("actual"), F.max("prediction")).alias("high"),
    )


def error_threshold(df: DataFrame, column: str, by: list[str] = ()) -> DataFrame:
    """Mean plus two population standard deviations."""
    return df.groupBy(*by).agg(
        (F.avg(column) + 2 * F.stddev_pop(column)).alias("threshold")
    )


def first_predictions(predictions: DataFrame, n: int | None = 500) -> DataFrame:
    """First ``n`` (None: all) validation predictions of every model in time order."""
    return predictions if n is None else first_rows(predictions, ["model"], ["timestamp", "building_id"], n)


def scaler(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and population std of every column, one row per column."""
    stats = df.agg(
        F.array(*[
            F.struct(
                F.lit(c).alias("feature"),
                F.avg(c).alias("mean"),
                F.stddev_pop(c).alias("std"),
            )
            for c in columns
        ]).alias("s")
    )
    return stats.select(F.inline("s"))


def scaler_row(df: DataFrame, columns: list[str]) -> Column:
    """The same statistics as one scalar struct: column -> (mean, std)."""
    return df.agg(
        F.struct(*[
            F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c)
            for c in columns
        ]).alias("s")
    ).scalar()


def fit_scaler(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """(mean, population std) per column, fetched as one row for model fitting."""
    row = df.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(columns)}


def add_standardised(
    df: DataFrame,
    columns: list[str],
    fitted: dict[str, tuple[float, float]] | None = None,
    suffix: str = "_scaled",
) -> DataFrame:
    """Standardised copies of the columns, by fitted statistics or those of ``df``."""
    if fitted is not None:
        return df.select("*", *[
            standardise(F.col(c), F.lit(fitted[c][0]), F.lit(fitted[c][1])).alias(c + suffix)
            for c in columns
        ])
    # The statistics enter as one column, so the plan holds the subquery once.
    return df.select("*", scaler_row(df, columns).alias("_stats")).select(
        *df.columns,
        *[
            standardise(F.col(c), F.col(f"_stats.{c}.mean"), F.col(f"_stats.{c}.std")).alias(
                c + suffix
            )
            for c in columns
        ],
    )


def stack_results(results: dict[str, DataFrame]) -> DataFrame:
    """Per-model prediction tables (one at least) as one long table with a ``model`` column."""
    if not results:
        raise ValueError("no model has predictions to stack")
    named = [table.withColumn("model", F.lit(name)) for name, table in results.items()]
    return reduce(lambda a, b: a.unionByName(b), named)
