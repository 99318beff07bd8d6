import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meterlens.operators import blend, joins
from meterlens.operators.scores import model_metrics

ALPHAS = [0.01, 0.1, 1.0, 10.0, 100.0]


@pytest.fixture(scope="module")
def data(spark):
    random = np.random.default_rng(11)
    n = 403
    y = random.gamma(2, 20, n)
    wide = pd.DataFrame({
        "building_id": np.arange(n) % 5,
        "timestamp": pd.date_range("2016-01-01", periods=n, freq="h"),
        "actual": y, "a": y + random.normal(0, 4, n), "b": 0.5 * y + random.normal(0, 2, n),
        "c": random.normal(30, 5, n),
    })
    long = wide.melt(["building_id", "timestamp", "actual"], ["a", "b", "c"], "model", "prediction")
    table = spark.createDataFrame(
        long, "building_id long, timestamp timestamp_ntz, actual double, model string, prediction double"
    )
    return wide, table


def _ridge(x, y, alpha):
    xm, ym = x.mean(axis=0), y.mean()
    w = np.linalg.solve((x - xm).T @ (x - xm) + alpha * np.eye(x.shape[1]), (x - xm).T @ (y - ym))
    return w, ym - xm @ w


def test_stacker_matches_ridge_cross_validation(data):
    wide, table = data
    x, y = wide[["a", "b", "c"]].to_numpy(), wide["actual"].to_numpy()
    sizes = [len(y) // 5 + (i < len(y) % 5) for i in range(5)]
    fold = np.repeat(np.arange(5), sizes)
    means = {}
    for alpha in ALPHAS:
        r2 = []
        for f in range(5):
            w, b = _ridge(x[fold != f], y[fold != f], alpha)
            yt, pt = y[fold == f], x[fold == f] @ w + b
            r2.append(1 - ((yt - pt) ** 2).sum() / ((yt - yt.mean()) ** 2).sum())
        means[alpha] = np.mean(r2)
    best = max(ALPHAS, key=means.get)
    w, b = _ridge(x, y, best)
    stacked, stacker = blend.stacked_ensemble(table, ["c", "a", "b"])
    assert stacker.alpha == best and stacker.models == ["a", "b", "c"]
    assert np.allclose(stacker.coefficients, w) and np.isclose(stacker.intercept, b)
    assert np.allclose([stacker.cv_r2[a] for a in ALPHAS], [means[a] for a in ALPHAS])
    got = stacked.orderBy("timestamp").toPandas()["prediction"]
    assert np.allclose(got, np.maximum(x @ w + b, 0))


def test_weighted_ensemble(data):
    wide, table = data
    y = wide["actual"].to_numpy()
    rmse = {m: round(np.sqrt(((y - wide[m]) ** 2).mean()), 4) for m in "abc"}
    raw = {m: 1 / v**2 for m, v in rmse.items()}
    want = sum(raw[m] / sum(raw.values()) * wide[m] for m in "abc")
    got = blend.weighted_ensemble(table).orderBy("timestamp").toPandas()["prediction"]
    assert np.allclose(got, np.maximum(want, 0))


def test_single_model_is_no_ensemble(data):
    assert blend.weighted_ensemble(data[1].filter("model = 'a'")).count() == 0


def test_zero_metric_gets_raw_weight_one(spark):
    metrics = spark.createDataFrame([("x", 0.0), ("y", 2.0)], "model string, rmse double")
    got = dict(blend.model_weights(metrics).collect())
    assert got["x"] == pytest.approx(0.8) and got["y"] == pytest.approx(0.2)


def test_best_ensemble_has_the_lower_error(data):
    table = data[1]
    best = blend.best_ensemble(table, ["a", "b", "c"])
    score = model_metrics(best, []).first()["rmse"]
    weighted = model_metrics(blend.weighted_ensemble(table), []).first()["rmse"]
    assert score <= weighted and best.select("method").distinct().count() == 1


def test_rows_missing_in_one_model_are_dropped(data):
    thinned = data[1].filter(~((F.col("model") == "b") & (F.col("building_id") == 1)))
    aligned = joins.align_models(thinned, ["a", "b", "c"])
    assert aligned.filter("building_id = 1").count() == 0
    assert blend.weighted_ensemble(thinned).filter("building_id = 1").count() == 0
