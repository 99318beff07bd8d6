import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meterlens.operators.windows import (
    STATISTICS, _chain, _rolling_plan, add_history_features, add_sequence_statistics, add_sequences,
)
from tests.conftest import rows

SPLIT = {"split_above": 40, "small_bytes": 0}
KEYS = ("building_id", "timestamp")


@pytest.fixture(params=[{}, SPLIT], ids=["plain", "split"])
def sizing(request):
    return request.param


def test_lags_and_rolling_match_pandas(readings, frame, sizing):
    got = rows(add_history_features(readings, lags=[1, 24], rolling=[6, 24], **sizing), *KEYS)
    want = frame.sort_values(list(KEYS)).reset_index(drop=True)
    groups = want.groupby("building_id")["meter_reading"]
    for k in (1, 24):
        assert np.allclose(got[f"lag_{k}h"], groups.shift(k).fillna(0))
    for n in (6, 24):
        rolled = groups.rolling(n, min_periods=1)
        assert np.allclose(got[f"rolling_mean_{n}h"], rolled.mean().reset_index(drop=True))
        assert np.allclose(
            got[f"rolling_std_{n}h"], rolled.std().fillna(0).reset_index(drop=True), atol=1e-6
        )


def test_rolling_without_current_row(readings, frame):
    got = rows(add_history_features(readings, lags=[], rolling=[6], include_current=False), *KEYS)
    want = frame.sort_values(list(KEYS)).groupby("building_id")["meter_reading"].transform(
        lambda x: x.shift(1).rolling(6, min_periods=1).mean()
    ).fillna(0)
    assert np.allclose(got["rolling_mean_6h"], want.reset_index(drop=True))


def test_split_keeps_every_row_once(readings):
    assert add_history_features(readings, **SPLIT).count() == readings.count()


def test_hot_building_is_cut_into_bounded_partitions(readings):
    """No window partition holds much more than the split size plus the halo."""
    from meterlens.operators.windows import _chunk_plan

    day = F.date_trunc("day", "timestamp")
    plan = _chunk_plan(readings, ["building_id"], day, 24, 40, 0)
    sizes = (
        readings.withColumn("_bucket", day)
        .join(plan, ["building_id", "_bucket"])
        .select("building_id", F.explode("_chunks").alias("chunk"))
        .groupBy("building_id", "chunk").count()
    )
    assert sizes.agg(F.max("count")).first()[0] <= 40 + 24 + 3 * 24
    assert {r[0] for r in plan.select("building_id").distinct().collect()} == {1, 2, 4}


def test_sequences(readings, frame, sizing):
    got = rows(add_sequences(readings, lookback=24, **sizing), *KEYS)
    want = []
    for _, part in frame.sort_values(list(KEYS)).groupby("building_id"):
        values = part["meter_reading"].tolist()
        want += [values[i - 24 : i] for i in range(24, len(values))]
    assert [list(s) for s in got["sequence"]] == want


def test_sequences_of_several_channels(readings):
    two = readings.withColumn("double", F.col("meter_reading") * 2)
    row = add_sequences(two, channels=["meter_reading", "double"], lookback=3).first()
    assert len(row["sequence"]) == 3
    assert row["sequence"][0]["double"] == 2 * row["sequence"][0]["meter_reading"]


def test_sizes_are_made_of_smaller_ones():
    assert _rolling_plan([6, 12, 24, 48, 168]) == {6: (6, 1), 12: (6, 2), 24: (12, 2), 48: (24, 2), 168: (24, 7)}
    assert _rolling_plan([7, 10]) == {7: (7, 1), 10: (10, 1)}
    assert _chain(168) == [3, 21, 168] and _chain(24) == [3, 24] and _chain(13) == [13] and _chain(1) == [1]


@pytest.mark.parametrize("sizes", [[6, 12, 24, 48, 168], [5, 7, 14]])
def test_rolling_of_many_sizes_matches_pandas(spark, sizes, sizing):
    """NULL values, a long flat stretch far from zero, and a jump."""
    random = np.random.default_rng(6)
    parts = []
    for b, n in ((1, 700), (2, 90), (3, 1)):
        x = random.gamma(2, 30, n)
        x[n // 3: n // 2] = 1e9 + 0.1
        x[random.random(n) < 0.1] = np.nan
        parts.append(pd.DataFrame({"building_id": b, "timestamp": pd.date_range("2016-01-01", periods=n, freq="h"),
                                   "meter_reading": x}))
    df = pd.concat(parts, ignore_index=True)
    table = spark.createDataFrame(df, "building_id long, timestamp timestamp_ntz, meter_reading double").withColumn(
        "meter_reading", F.when(~F.isnan("meter_reading"), F.col("meter_reading")))
    got = rows(add_history_features(table, lags=[], rolling=sizes, **sizing), *KEYS)
    groups = df.groupby("building_id")["meter_reading"]
    for n in sizes:
        mean = groups.transform(lambda x: x.rolling(n, min_periods=1).apply(np.nanmean)).fillna(0)
        std = groups.transform(lambda x: x.rolling(n, min_periods=2).apply(
            lambda v: np.nanstd(v, ddof=1) if np.isfinite(v).sum() > 1 else 0.0)).fillna(0)
        assert np.allclose(got[f"rolling_mean_{n}h"], mean, rtol=1e-12)
        assert np.allclose(got[f"rolling_std_{n}h"], std, rtol=1e-9, atol=1e-6)


@pytest.mark.parametrize("lookback", [1, 2, 13, 24, 168])
def test_sequence_statistics_are_those_of_the_arrays(readings, frame, sizing, lookback):
    got = rows(add_sequence_statistics(readings, lookback=lookback, **sizing), *KEYS)
    want = []
    for _, part in frame.sort_values(list(KEYS)).groupby("building_id"):
        v = part["meter_reading"].to_numpy()
        for i in range(lookback, len(v)):
            s = v[i - lookback:i]
            slope = np.polyfit(np.arange(lookback), s, 1)[0] if lookback > 1 else 0.0
            want.append((s.mean(), s.min(), s.max(), s[-1], slope))
    assert np.allclose(got[list(STATISTICS)].to_numpy(float), np.array(want), rtol=1e-9, atol=1e-9)
