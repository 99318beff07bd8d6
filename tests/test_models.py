import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meterlens.config import ForestParams, TreeParams
from meterlens.operators.scores import model_metrics
from meterlens.plans import models

TREES = TreeParams(trees=5, depth=3)
FEATURES = ["lag_1h", "hour", "air_temperature"]


@pytest.fixture(scope="module")
def matrix(spark):
    random = np.random.default_rng(9)
    parts = []
    for building in range(4):
        n = 200
        hour = np.arange(n) % 24
        temperature = random.normal(20, 5, n)
        y = 50 + 10 * building + 2.0 * hour + temperature + random.normal(0, 1, n)
        parts.append(pd.DataFrame({
            "building_id": building, "timestamp": pd.date_range("2016-01-01", periods=n, freq="h"),
            "meter_reading": y, "lag_1h": np.r_[0, y[:-1]], "hour": hour,
            "air_temperature": temperature, "is_val": np.arange(n) >= 160,
        }))
    return spark.createDataFrame(
        pd.concat(parts),
        "building_id long, timestamp timestamp_ntz, meter_reading double, lag_1h double,"
        " hour int, air_temperature double, is_val boolean",
    ).persist()


def _r2(predictions):
    return model_metrics(predictions, []).first()["r2"]


def test_tree_models_learn(matrix, spark):
    val = matrix.filter("is_val")
    boosted = models.fit_tabular(matrix, FEATURES, models.boosted_trees(TREES))
    assert boosted.stages[-1].getNumTrees == 5
    assert _r2(models.predict(boosted, val)) > 0.3
    forest = models.fit_tabular(matrix, FEATURES, models.random_forest(ForestParams(10, 6)))
    assert _r2(models.predict(forest, val)) > 0.3
    importance = models.top_importance(models.feature_importance(boosted, FEATURES, spark), 2)
    assert importance.count() == 2
    assert sum(boosted.stages[-1].featureImportances.toArray()) == pytest.approx(1)


def test_saved_model_scores_the_same(matrix, tmp_path):
    val = matrix.filter("is_val")
    model = models.fit_tabular(matrix, FEATURES, models.boosted_trees(TREES))
    models.save_model(model, str(tmp_path / "m"))
    again = models.rescore(str(tmp_path / "m"), val, "boosted").drop("model")
    assert again.exceptAll(models.predict(model, val)).count() == 0


def test_standardised_regression_is_least_squares(matrix):
    got = models.standardised_regression(matrix, FEATURES).orderBy("building_id", "timestamp").toPandas()
    pdf = matrix.toPandas().sort_values(["building_id", "timestamp"])
    train, val = pdf[~pdf["is_val"]], pdf[pdf["is_val"]]
    x = np.column_stack([np.ones(len(train)), train[FEATURES]])
    beta = np.linalg.lstsq(x, train["meter_reading"], rcond=None)[0]
    want = np.column_stack([np.ones(len(val)), val[FEATURES]]) @ beta
    assert np.allclose(got["prediction"], want, rtol=0.02)


def test_two_branches(matrix):
    both = models.two_branch_regression(matrix, FEATURES)
    assert both.count() == matrix.filter("is_val").count()


def test_residual_model_corrects_a_repeating_error(matrix):
    weak = models.boosted_trees(TreeParams(trees=1, depth=1))
    base = models.predict(models.fit_tabular(matrix, FEATURES, weak), matrix.filter("is_val"))
    fixed = models.residual_model(matrix, FEATURES, weak, lookback=24)
    assert fixed.count() == base.count()
    assert _r2(fixed) > _r2(base)


def test_sequence_regression_covers_validation(matrix):
    assert models.sequence_regression(matrix, 24).count() == matrix.filter("is_val").count()
    with pytest.raises(ValueError):
        models.sequence_regression(matrix, 170)


def test_short_histories_keep_the_base_forecast(matrix):
    tree = models.boosted_trees(TreeParams(trees=1, depth=1))
    short = models.residual_model(matrix, FEATURES, tree, lookback=170)
    base = models.predict(models.fit_tabular(matrix, FEATURES, tree), matrix.filter("is_val"))
    assert short.exceptAll(base).count() == 0


def test_ablation(matrix):
    groups = {"lag": ["lag_1h"], "weather": ["air_temperature"]}
    result = models.ablation(matrix, FEATURES, lambda: models.boosted_trees(TREES), groups)
    got = {r["without"]: r for r in result.collect()}
    assert set(got) == {"baseline", "lag", "weather"}
    assert got["baseline"]["delta_r2"] == 0 and got["lag"]["n_features"] == 2
    assert got["lag"]["delta_r2"] == pytest.approx(got["lag"]["r2"] - got["baseline"]["r2"])


def test_suite_survives_a_failing_member(spark, matrix):
    def broken():
        raise RuntimeError("no such estimator")

    results, status = models.train_suite(spark, {
        "broken": broken, "linear": lambda: models.standardised_regression(matrix, FEATURES),
    })
    assert set(results) == {"linear"}
    got = {r["model"]: (r["status"], r["message"]) for r in status.collect()}
    assert got["broken"] == ("failed", "no such estimator") and got["linear"][0] == "ok"


def test_hanging_members_are_given_up(spark):
    started = time.monotonic()

    def hanging():
        def wait(frames):
            for frame in frames:
                time.sleep(120)
                yield frame

        return spark.range(4).mapInPandas(wait, "id long")

    results, status = models.train_suite(spark, {
        "hanging": hanging, "asleep": lambda: time.sleep(120), "first": lambda: spark.range(3),
        "broken": lambda: spark.range(3).select("nothing"), "last": lambda: spark.range(5),
    }, timeout=15, parallel=3)
    assert time.monotonic() - started < 60
    assert {n: r.count() for n, r in results.items()} == {"first": 3, "last": 5}
    assert [(r.model, r.status) for r in status.collect()] == [
        ("hanging", "timeout"), ("asleep", "timeout"), ("first", "ok"), ("broken", "failed"), ("last", "ok")]
    deadline = time.monotonic() + 20
    while spark.sparkContext.statusTracker().getActiveJobsIds() and time.monotonic() < deadline:
        time.sleep(0.5)
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()
