import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meterlens.config import BoostParams, SeasonalParams
from meterlens.operators.scores import model_metrics, stack_results
from meterlens.plans import boosting, forecast, models
from meterlens.plans.registry import STACKED, WEIGHTED, Entry, Registry, rescore_all

FEATURES = ["lag", "hour"]


@pytest.fixture(scope="module")
def matrix(spark):
    random = np.random.default_rng(2)
    hours = 300
    parts = []
    for b in (1, 2, 3):
        t = np.arange(hours)
        y = 60 + 10 * b + 20 * np.sin(2 * np.pi * t / 24) + random.normal(0, 3, hours)
        parts.append(pd.DataFrame({
            "building_id": b, "timestamp": pd.date_range("2016-01-01", periods=hours, freq="h"),
            "meter_reading": y, "lag": np.roll(y, 1), "hour": (t % 24).astype(float), "is_val": t >= 240,
        }))
    return spark.createDataFrame(
        pd.concat(parts), "building_id long, timestamp timestamp_ntz, meter_reading double, lag double, "
        "hour double, is_val boolean").persist()


@pytest.fixture(scope="module")
def fitted(matrix):
    return {
        "linear": models.fit_tabular(matrix, FEATURES, models.ridge()),
        "trees": boosting.fit_boosted(matrix, FEATURES, BoostParams(trees=6, early_stop=0, learning_rate=0.4)),
        "seasonal": forecast.fit_orders(matrix.filter("not is_val"), SeasonalParams(), [(2, 1, 1)]),
    }


def _publish(registry, fitted):
    return registry.publish([
        registry.save_pipeline("linear", fitted["linear"], FEATURES),
        registry.save_trees("trees", fitted["trees"]),
        registry.save_seasonal("seasonal", fitted["seasonal"]),
    ])


def test_saved_models_score_as_before_saving(spark, matrix, fitted, tmp_path):
    registry = Registry(spark, str(tmp_path))
    assert registry.entries().count() == 0 and registry.version() is None
    assert _publish(registry, fitted) == 1
    val = matrix.filter("is_val")
    got = {r["model"]: r for r in rescore_all(registry, val).collect()}
    assert set(got) == {"linear", "trees", "seasonal", WEIGHTED, STACKED}
    assert {k: (r["status"], r["message"], r["n"]) for k, r in got.items()} == dict.fromkeys(got, ("ok", "", 180))
    before = {
        "linear": models.predict(fitted["linear"], val),
        "trees": boosting.predict_boosted(fitted["trees"].table(spark), val),
        "seasonal": forecast.align_forecast(forecast.forecast_from(fitted["seasonal"], 60), val),
    }
    want = {r["model"]: r for r in model_metrics(stack_results(
        {k: v.select(*models.RESULT) for k, v in before.items()})).collect()}
    for name, r in want.items():
        assert [got[name][m] for m in ("r2", "rmse", "mae", "mape")] == pytest.approx(
            [r[m] for m in ("r2", "rmse", "mae", "mape")])
    assert got[STACKED]["rmse"] <= min(r["rmse"] for r in want.values()) + 1e-6
    again = {r["model"]: r["rmse"] for r in registry.results("metrics").collect()}
    assert again == {k: r["rmse"] for k, r in got.items()}
    assert registry.results("predictions").count() == 5 * 180


def test_one_model_is_replaced_and_broken_ones_are_told(spark, matrix, fitted, tmp_path):
    registry = Registry(spark, str(tmp_path))
    _publish(registry, fitted)
    worse = models.fit_tabular(matrix, ["hour"], models.ridge())
    assert registry.publish([
        registry.save_pipeline("linear", worse, ["hour"]),
        Entry("lost", "trees", ["lag"], str(tmp_path / "nowhere")),
        Entry("wide", "pipeline", ["unknown"], str(tmp_path / "nowhere")),
    ]) == 2
    names = {r["name"]: r for r in registry.entries().collect()}
    assert set(names) == {"linear", "trees", "seasonal", "lost", "wide"}
    assert names["linear"]["version"] == 2 and names["trees"]["version"] == 1
    got = {r["model"]: r for r in rescore_all(registry, matrix.filter("is_val")).collect()}
    assert {k for k, r in got.items() if r["status"] == "failed"} == {"lost", "wide"}
    assert "unknown" in got["wide"]["message"] and got["wide"]["r2"] is None
    assert got[WEIGHTED]["status"] == "ok" and got["linear"]["n"] == 180


def test_an_unfinished_version_is_not_read(spark, fitted, tmp_path):
    registry = Registry(spark, str(tmp_path))
    _publish(registry, fitted)
    before = registry.entries().count()
    registry.entries().limit(1).write.parquet(str(tmp_path / "versions" / "2"))
    (tmp_path / "versions" / "2" / "_SUCCESS").unlink()
    assert registry.version() == 1 and registry.entries().count() == before
    assert registry.publish([]) == 3  # the broken folder is passed over, not overwritten
    assert registry.entries().count() == before
    with pytest.raises(ValueError, match="scored"):
        registry.results("metrics")
    with pytest.raises(ValueError, match="twice"):
        registry.publish([Entry("a", "trees", [], "x"), Entry("a", "trees", [], "y")])
