import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meterlens.config import ORDER_GRID, SeasonalParams
from meterlens.functions.arma import lagged_gram, stable, stable_rows
from meterlens.plans import forecast
from tests import dense_arma

SHORT = SeasonalParams(history=240, horizon=24)
DEFAULT = ((2, 1, 1), (1, 0, 1), 24)


def _daily(hours: int, noise: float, seed: int = 0) -> np.ndarray:
    t = np.arange(hours)
    return 100 + 40 * np.sin(2 * np.pi * t / 24) + np.random.default_rng(seed).normal(0, noise, hours)


def _meters(spark, series: dict):
    parts = [
        pd.DataFrame({"building_id": b, "timestamp": pd.date_range("2016-03-01", periods=len(y), freq="h"),
                      "meter_reading": y})
        for b, y in series.items()
    ]
    return spark.createDataFrame(
        pd.concat(parts), "building_id long, timestamp timestamp_ntz, meter_reading double")


SERIES = {1: _daily(400, 2.0, 1), 2: _daily(300, 9.0, 2), 3: _daily(2, 1.0), 4: _daily(60, 3.0, 4),
          5: np.full(90, 7.0), 6: _daily(30, 3.0, 6), 7: np.array([5.0]), 8: np.exp(np.linspace(0, 6, 200)),
          9: _daily(12, 3.0), 10: _daily(71, 3.0), 11: _daily(8, 2.0)}


@pytest.fixture(scope="module")
def meters(spark):
    df = _meters(spark, SERIES).toPandas()
    gaps = (df.index % 17 == 3) & df["building_id"].isin([1, 2])
    return spark.createDataFrame(
        df[~gaps], "building_id long, timestamp timestamp_ntz, meter_reading double").persist()


def _by_building(df):
    out = {}
    for r in df.orderBy("building_id", "step").collect():
        out.setdefault(r["building_id"], []).append(r["prediction"])
    return out


def test_products_of_all_lags_follow_from_those_of_one():
    x = np.random.default_rng(3).normal(5, 2, 90)
    for start in (7, 12):
        columns = np.column_stack([x[start - k: len(x) - k] for k in range(8)])
        got = lagged_gram(x[start:] @ columns, x[:start], x[-8:])
        assert np.allclose(got, columns.T @ columns, rtol=1e-12)


@pytest.mark.parametrize("split", [None, 40])
def test_forecasts_are_those_of_the_whole_series(spark, monkeypatch, split):
    """Sums per building give what a solver sees that holds the series; hot series are cut."""
    if split:
        plain = forecast.history_windows
        monkeypatch.setattr(forecast, "history_windows", lambda *a, **k: plain(
            *a, **k, split_above=split, small_bytes=-1))
    got = _by_building(forecast.seasonal_forecast(_meters(spark, SERIES), SeasonalParams(horizon=30)))
    assert set(got) == set(SERIES)
    for building, y in SERIES.items():
        model = dense_arma.fit(y, *DEFAULT)
        want = np.full(30, y[-1]) if model is None else dense_arma.forecast(model, 30)
        assert got[building] == pytest.approx(want, rel=1e-5, abs=1e-5), building


def test_every_order_is_that_of_the_whole_series(spark):
    models = forecast.fit_orders(_meters(spark, SERIES))
    found = {(r["building_id"], r["p"], r["d"], r["q"]): r for r in models.collect()}
    assert len(found) == len(SERIES) * len(ORDER_GRID)
    for (building, *order), r in found.items():
        model = dense_arma.fit(SERIES[building], order, (1, 0, 1), 24, ORDER_GRID)
        assert (model is None) == (r["method"] == "last value") == (r["aic"] is None)
        if model and building not in (5, 8):  # a constant or smooth series leaves no residual to compare
            assert r["aic"] == pytest.approx(model["aic"], rel=1e-6)
            assert r["phi"] == pytest.approx(model["phi"], rel=1e-4, abs=1e-6)
            assert r["theta"] == pytest.approx(model["theta"], rel=1e-4, abs=1e-6)


def test_method_says_what_was_fitted(spark):
    models = forecast.fit_orders(_meters(spark, SERIES), orders=[(2, 1, 1)])
    method = {r["building_id"]: r["method"] for r in models.collect()}
    assert method == {1: "seasonal", 2: "seasonal", 3: "last value", 4: "plain", 5: "seasonal", 6: "plain",
                      7: "last value", 8: "seasonal", 9: "plain", 10: "plain", 11: method[11]}


def test_models_are_saved_and_told_their_order(spark, meters, tmp_path):
    models = forecast.best_models(forecast.fit_orders(meters, SHORT))
    forecast.save_models(models, str(tmp_path / "m"))
    again = forecast.load_models(spark, str(tmp_path / "m"))
    ahead = forecast.forecast_from(again, 12)
    assert _by_building(ahead) == _by_building(forecast.forecast_from(models, 12))
    orders = {r["building_id"]: (r["p"], r["d"], r["q"]) for r in models.collect()}
    best = forecast.best_orders(forecast.order_scores(meters, SHORT)).collect()
    assert {r["building_id"]: (r["p"], r["d"], r["q"]) for r in best} == {
        b: o for b, o in orders.items() if b not in (3, 7) and b in {r["building_id"] for r in best}}
    searched = forecast.seasonal_forecast(meters, SeasonalParams(history=240, order=None, horizon=12))
    assert _by_building(searched) == _by_building(ahead)


def test_daily_cycle_is_continued(spark):
    y = _daily(480, 1.0)
    got = _by_building(forecast.seasonal_forecast(_meters(spark, {1: y[:456]}), SeasonalParams(horizon=24)))[1]
    error, naive = np.array(got) - y[456:], np.full(24, y[455]) - y[456:]
    assert np.sqrt((error**2).mean()) < 0.25 * np.sqrt((naive**2).mean())


def test_autoregression_is_recovered(spark):
    random = np.random.default_rng(4)
    x = np.zeros(3000)
    for t in range(1, 3000):
        x[t] = 0.7 * x[t - 1] + random.normal()
    p = SeasonalParams(seasonal=(0, 0, 0))
    models = {r["p"]: r for r in forecast.fit_orders(
        _meters(spark, {1: x + 50}), p, [(1, 0, 0), (0, 0, 1)]).collect()}
    assert models[1]["phi"][0] == pytest.approx(0.7, abs=0.05)
    assert models[1]["aic"] < models[0]["aic"] and models[1]["method"] == "plain"


def test_all_buildings_in_one_job(meters):
    result = forecast.seasonal_forecast(meters, SHORT)
    got = result.groupBy("building_id").agg(
        F.count("*").alias("n"), F.min("timestamp").alias("first"), F.min("prediction").alias("low")
    ).orderBy("building_id").collect()
    assert [r["n"] for r in got] == [24] * len(SERIES) and all(r["low"] >= 0 for r in got)
    last = meters.filter("building_id = 1").agg(F.max("timestamp")).first()[0]
    assert got[0]["first"] - last == pd.Timedelta(hours=1)


def test_recent_hours_carry_the_value_before_a_gap(meters):
    whole = {(r[0], r[1]): r[2] for r in forecast.hourly_history(meters, None).collect()}
    recent = forecast.hourly_history(meters, 50).collect()
    assert all(whole[r[0], r[1]] == r[2] for r in recent)
    assert sum(r[0] == 1 for r in recent) == 50 and sum(r[0] == 3 for r in recent) == 2


def test_orders_beyond_one_difference_are_refused(meters):
    with pytest.raises(ValueError, match="once"):
        forecast.fit_orders(meters, orders=[(1, 2, 1)])


def test_nothing(spark):
    assert forecast.seasonal_forecast(_meters(spark, {1: []}), SHORT).collect() == []


def test_forecast_is_aligned_by_step(meters):
    cut = F.lit("2016-03-11 00:00:00").cast("timestamp_ntz")
    long = meters.filter("building_id < 3")
    result = forecast.seasonal_forecast(long.filter(F.col("timestamp") < cut), SHORT)
    pairs = forecast.align_forecast(result, long.filter(F.col("timestamp") >= cut))
    per = pairs.groupBy("building_id").count().collect()
    assert {r["building_id"]: r["count"] for r in per} == {1: 24, 2: 24}
    off = pairs.filter("building_id = 1").select(F.avg(F.abs(F.col("actual") - F.col("prediction"))))
    assert off.first()[0] < 12


def test_order_search(meters):
    scores = forecast.order_scores(meters, SHORT)
    assert scores.filter("p = 0 and q = 0").count() == 0
    assert scores.filter("building_id = 3").count() == 0
    best = forecast.best_orders(scores)
    low = {r[0]: r[1] for r in scores.groupBy("building_id").agg(F.min("aic")).collect()}
    assert {r["building_id"]: r["aic"] for r in best.collect()} == low


def test_a_series_in_stretches_has_the_same_models(spark, monkeypatch):
    whole = forecast.fit_orders(_meters(spark, SERIES)).orderBy("building_id", "p", "d", "q").collect()
    monkeypatch.setattr(forecast, "STRETCH", 64)
    cut = forecast.fit_orders(_meters(spark, SERIES)).orderBy("building_id", "p", "d", "q").collect()
    for a, b in zip(whole, cut, strict=True):
        assert (a["method"], a["n"], a["last_y"]) == (b["method"], b["n"], b["last_y"])
        if a["building_id"] not in (5, 8):  # nothing is left there to compare
            for c in ("phi", "theta", "x_tail", "e_tail"):
                assert a[c] == pytest.approx(b[c], rel=1e-6, abs=1e-8)
            assert (a["aic"] or 0) == pytest.approx(b["aic"] or 0, rel=1e-8)


def test_no_row_stands_for_an_hour_or_a_series(spark):
    """Two readings ten years apart: rows by stretch, and in each the runs of its hours and those before."""
    meters = spark.createDataFrame(pd.DataFrame({
        "building_id": [1, 1, 1], "meter_reading": [3.0, 4.0, 9.0],
        "timestamp": pd.to_datetime(["2000-01-01 00:00", "2000-01-01 05:00", "2010-01-01 00:00"]),
    }), "building_id long, meter_reading double, timestamp timestamp_ntz")
    runs = forecast.history_runs(meters, None)
    assert [r["y"] for r in runs.orderBy("timestamp").collect()] == [3.0, 4.0, 9.0]
    rows = forecast._stretches(runs, 10).orderBy("stretch").collect()
    assert len(rows) == pytest.approx(87_672 / forecast.STRETCH, abs=2)
    assert all(r["end"] - r["begin"] < forecast.STRETCH + 10 for row in rows for r in row["runs"])
    assert sum(min(r["end"] - r["begin"], r["end"] - row["stretch"]) + 1
               for row in rows for r in row["runs"] if r["end"] >= row["stretch"]) == 87_672 + 1


def test_explosive_rows_are_those_that_are_pulled_back():
    random, lags = np.random.default_rng(6), [1, 2, 24, 25, 26]
    rows = random.normal(0, 0.4, (300, len(lags)))
    want = np.array([stable(r, lags) for r in rows])
    assert 0 < (want == rows).all(axis=1).sum() < 300
    assert stable_rows(rows, lags) == pytest.approx(want)
