import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlens.operators import scores
from meterlens.sources import sinks

# Metrics of eight models (fixed values): model, R2, RMSE, MAE, MAPE.
SAVED = [
    ("meta_ensemble", 0.988944, 11.5074, 7.8083, 4.2783),
    ("xgb_bilstm", 0.988049, 11.9639, 7.9541, 4.6188),
    ("xgboost", 0.987843, 12.0663, 7.9722, 4.6611),
    ("random_forest", 0.982859, 14.3279, 9.9046, 5.724),
    ("ann", 0.982253, 14.5792, 10.6775, 6.1274),
    ("cnn", 0.955706, 23.0325, 17.238, 8.6998),
    ("dual_ann", 0.955432, 23.1038, 16.9203, 12.4312),
    ("cnn_bilstm", 0.949769, 24.5276, 18.5427, 11.2118),
]
METRICS = "model string, r2 double, rmse double, mae double, mape double"


@pytest.fixture(scope="module")
def saved(spark):
    return spark.createDataFrame(sorted(SAVED), METRICS)


def _pairs(spark, actual, prediction, model="m"):
    data = [(model, *(None if v is None else float(v) for v in p)) for p in zip(actual, prediction)]
    return spark.createDataFrame(data, "model string, actual double, prediction double")


def test_metrics_match_numpy(spark):
    random = np.random.default_rng(1)
    y = random.gamma(2, 10, 500)
    p = y + random.normal(size=500)
    row = scores.model_metrics(_pairs(spark, y, p)).first()
    assert row["r2"] == round(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum(), 6)
    assert row["rmse"] == round(np.sqrt(((y - p) ** 2).mean()), 4)
    assert row["mae"] == round(np.abs(y - p).mean(), 4)
    assert row["mape"] == round(np.abs((y - p) / y).mean() * 100, 4)


def test_metrics_skip_missing_and_zero_actuals(spark):
    y = [1.0, 0.0, None, 4.0, float("nan"), 5.0, float("inf")]
    p = [2.0, 1.0, 3.0, None, 1.0, 5.0, 1.0]
    row = scores.model_metrics(_pairs(spark, y, p)).first()
    assert row["n"] == 3 and row["mape"] == 50.0
    zero = scores.model_metrics(_pairs(spark, [0.0, 0.0], [1.0, 1.0])).first()
    assert zero["mape"] == float("inf") and zero["r2"] is None


def test_leaderboard_and_best(saved):
    board = scores.leaderboard(saved).orderBy("rank").collect()
    assert [r["model"] for r in board] == [m[0] for m in SAVED]
    assert [r["rank"] for r in board] == list(range(1, 9))
    best = {r["metric"]: (r["model"], r["value"]) for r in scores.best_by_metric(saved).collect()}
    assert best == {
        "r2": ("meta_ensemble", 0.988944), "rmse": ("meta_ensemble", 11.5074),
        "mae": ("meta_ensemble", 7.8083), "mape": ("meta_ensemble", 4.2783),
    }


def test_report_and_metric_files(spark, saved, tmp_path):
    folder = str(tmp_path / "metrics")
    for name in ("xgboost", "cnn"):
        sinks.save_metrics(saved.filter(F.col("model") == name), folder)
    # The same model again replaces its file, not the others.
    sinks.save_metrics(saved.filter(F.col("model") == "cnn").withColumn("rmse", F.lit(1.0)), folder)
    (tmp_path / "metrics" / "plain.json").write_text('{"R2": 0.5, "RMSE": 2.0, "MAE": 1.0, "MAPE": 3.0}')
    (tmp_path / "metrics" / "ablation.json").write_text('{"baseline": {"x": 1}}')
    (tmp_path / "metrics" / "comparison_report.json").write_text('{"R2": 9.0}')
    loaded = sinks.load_metrics(spark, folder)
    got = {r["model"]: r["rmse"] for r in loaded.collect()}
    assert got == {"xgboost": 12.0663, "cnn": 1.0, "plain": 2.0}
    kept = sinks.registered_metrics(loaded, ["xgboost", "cnn"])
    assert kept.count() == 2
    report = scores.comparison_report(saved)
    sinks.write_report(report, str(tmp_path / "report"))
    back = spark.read.json(str(tmp_path / "report")).first()
    assert len(back["leaderboard"]) == 8
    assert back["best_by_metric"]["rmse"]["model"] == "meta_ensemble"


def test_histogram_matches_numpy(spark):
    errors = np.random.default_rng(2).normal(size=1000)
    table = _pairs(spark, errors, np.zeros(1000))
    got = scores.error_histogram(table).orderBy("bin").collect()
    want, edges = np.histogram(errors, bins=60)
    assert [r["n"] for r in got] == want.tolist()
    assert np.allclose([r["bin_start"] for r in got], edges[:-1])


def test_scaling_of_a_constant_column(spark):
    table = spark.createDataFrame([(1.0, 7.0), (2.0, 7.0), (3.0, 7.0)], "a double, b double")
    lazy = scores.add_standardised(table, ["a", "b"]).orderBy("a").collect()
    fitted = scores.add_standardised(table, ["a", "b"], scores.fit_scaler(table, ["a", "b"]))
    assert [r["b_scaled"] for r in lazy] == [0.0, 0.0, 0.0]
    assert np.allclose([r["a_scaled"] for r in lazy], (np.array([1, 2, 3]) - 2) / np.std([1, 2, 3]))
    assert [tuple(r) for r in fitted.orderBy("a").collect()] == [tuple(r) for r in lazy]
