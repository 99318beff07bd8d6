"""Combining forecasts: weighted ensemble, ridge stacking, best of both."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterlens.functions.scalars import clamp, total
from meterlens.operators.filters import finite_pairs
from meterlens.operators.joins import align_models
from meterlens.operators.ranks import contiguous_folds
from meterlens.operators.scores import model_metrics
from meterlens.session import settle

# Ridge penalties tried by the stacker (fixed values).
ALPHAS = [0.01, 0.1, 1.0, 10.0, 100.0]


def model_weights(metrics: DataFrame, metric: str = "rmse") -> DataFrame:
    """Weights proportional to 1 / metric^2; 1 when the metric is not positive."""
    value = F.col(metric)
    raw = F.when(value > 0, 1 / (value * value)).otherwise(1.0)
    share = F.sum("_raw").over(Window.partitionBy())
    return metrics.withColumn("_raw", raw).select("model", (F.col("_raw") / share).alias("weight"))


def weighted_ensemble(
    predictions: DataFrame, metric: str = "rmse", metrics: DataFrame | None = None
) -> DataFrame:
    """Weighted mean of all models on the rows that every valid model predicts.

    The weights are one row per model and are broadcast.
    """
    usable = finite_pairs(predictions)
    scored = metrics if metrics is not None else model_metrics(usable)
    # One row per valid model; a single model is not an ensemble.
    weights = (
        model_weights(scored, metric)
        .withColumn("models", F.count("*").over(Window.partitionBy()))
        .filter(F.col("models") >= 2)
    )
    return (
        usable.join(F.broadcast(weights), "model")
        .groupBy("building_id", "timestamp")
        .agg(
            F.max("actual").alias("actual"),
            F.sum(F.col("weight") * F.col("prediction")).alias("blend"),
            (F.count("*") == F.max("models")).alias("_complete"),
        )
        .filter("_complete")
        .select("building_id", "timestamp", "actual", clamp(F.col("blend")).alias("prediction"))
    )


@dataclass
class Stacker:
    """Fitted ridge stacker; ``apply`` is plain column arithmetic."""

    models: list[str]
    alpha: float
    coefficients: list[float]
    intercept: float
    cv_r2: dict[float, float]

    def apply(self, wide: DataFrame) -> DataFrame:
        linear = total(
            [F.lit(self.intercept)] + [F.col(m) * c for m, c in zip(self.models, self.coefficients)]
        )
        return wide.select("building_id", "timestamp", "actual", clamp(linear).alias("prediction"))


def _solve(sums: dict, alpha: float) -> tuple[np.ndarray, float]:
    """Ridge coefficients and intercept from centred sums of a training part."""
    n, sx, sy = sums["n"], sums["x"], sums["y"]
    gram = sums["xx"] - np.outer(sx, sx) / n
    rhs = sums["xy"] - sx * sy / n
    w = np.linalg.solve(gram + alpha * np.eye(len(sx)), rhs)
    return w, (sy - w @ sx) / n


def _r2(sums: dict, w: np.ndarray, b: float) -> float:
    n, sx, sy = sums["n"], sums["x"], sums["y"]
    sse = (
        sums["yy"] - 2 * (w @ sums["xy"]) - 2 * b * sy
        + w @ sums["xx"] @ w + 2 * b * (w @ sx) + n * b * b
    )
    spread = sums["yy"] - sy * sy / n
    return 1 - sse / spread if spread > 0 else 0.0


def fit_stacker(wide: DataFrame, models: list[str], alphas=ALPHAS, folds: int = 5, **sizing) -> Stacker:
    """Ridge over model predictions, penalty chosen by contiguous folds.

    One distributed pass returns ``folds`` rows of sums (count, sums, products);
    the driver only solves systems as large as the number of models.
    """
    columns = [*models, "actual"]
    means = wide.agg(*[F.avg(c).alias(c) for c in columns]).first()
    parts = contiguous_folds(wide, folds, **sizing).select(
        "fold", *[(F.col(c) - means[c]).alias(c) for c in columns]
    )
    k = len(models)
    products = [
        F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"p_{i}_{j}")
        for i in range(k + 1) for j in range(i, k + 1)
    ]
    rows = (
        parts.groupBy("fold")
        .agg(
            F.count("*").alias("n"),
            *[F.sum(c).alias(f"s_{i}") for i, c in enumerate(columns)],
            *products,
        )
        .orderBy("fold")
        .collect()  # one row of sums per fold
    )

    def unpack(row) -> dict:
        p = np.zeros((k + 1, k + 1))
        for i in range(k + 1):
            for j in range(i, k + 1):
                p[i, j] = p[j, i] = row[f"p_{i}_{j}"]
        s = np.array([row[f"s_{i}"] for i in range(k + 1)])
        return {"n": row["n"], "x": s[:k], "y": s[k], "xx": p[:k, :k], "xy": p[:k, k], "yy": p[k, k]}

    parts_sums = [unpack(r) for r in rows]
    everything = {key: sum(p[key] for p in parts_sums) for key in parts_sums[0]}
    scores = {}
    for alpha in alphas:
        fold_scores = []
        for held in parts_sums:
            train = {key: everything[key] - held[key] for key in held}
            fold_scores.append(_r2(held, *_solve(train, alpha)))
        scores[alpha] = float(np.mean(fold_scores))
    best = max(alphas, key=lambda a: scores[a])
    w, b = _solve(everything, best)
    shift = means["actual"] - sum(c * means[m] for c, m in zip(w, models))
    return Stacker(list(models), best, [float(c) for c in w], float(b + shift), scores)


def stacked_ensemble(predictions: DataFrame, models: list[str], **sizing) -> tuple[DataFrame, Stacker]:
    """Fit on the aligned rows and score the same rows.

    The aligned table is written once; fitting reads it several times.
    """
    wide = settle(align_models(predictions, sorted(models)))
    stacker = fit_stacker(wide, sorted(models), **sizing)
    return stacker.apply(wide), stacker


def best_ensemble(predictions: DataFrame, models: list[str]) -> DataFrame:
    """Weighted or stacked blend, whichever has the lower RMSE (tie: stacked).

    The choice is part of the plan: both blends are labelled, scored, and the
    winner is kept by a semi-join with one row.
    """
    weighted = weighted_ensemble(predictions).withColumn("method", F.lit("weighted"))
    stacked = stacked_ensemble(predictions, models)[0].withColumn("method", F.lit("stacked"))
    both = weighted.unionByName(stacked)
    winner = (
        model_metrics(both, ["method"])
        .agg(F.min_by("method", F.struct("rmse", F.col("method"))).alias("method"))
        .scalar()
    )
    return both.filter(F.col("method") == winner)
