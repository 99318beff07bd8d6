import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlens.config import AnomalyParams
from meterlens.functions.calendar import add_time_features
from meterlens.operators.anomalies import classify_severity, detect_zscore, severity_counts
from meterlens.operators.isolation import average_path, detect_isolation, tree_samples
from meterlens.operators.reconstruction import detect_reconstruction
from meterlens.plans.detection import detect_anomalies
from tests.conftest import rows

FEW = AnomalyParams(trees=40, sample_size=64)


@pytest.fixture(scope="module")
def spiky(spark, readings):
    """Building 1 has one reading far outside its range."""
    return add_time_features(readings.withColumn(
        "meter_reading",
        F.when(
            (F.col("building_id") == 1)
            & (F.col("timestamp") == F.lit("2016-01-10 06:00:00").cast("timestamp_ntz")),
            F.lit(5000.0),
        ).otherwise(F.col("meter_reading")),
    )).persist()


def test_zscore_matches_pandas(readings, frame):
    got = rows(detect_zscore(readings), "building_id", "timestamp")
    want = frame.sort_values(["building_id", "timestamp"])
    g = want.groupby("building_id")["meter_reading"]
    z = ((want["meter_reading"] - g.transform("mean")) / (g.transform("std") + 1e-8)).to_numpy()
    assert np.allclose(got["zscore"].astype(float), z, equal_nan=True)
    assert got["anomaly_zscore"].tolist() == (np.abs(z) > 3).astype(int).tolist()


def test_severity_uses_only_listed_flags(spark):
    table = spark.createDataFrame(
        [(1, 1, 1, 9), (1, 1, 0, 9), (0, 0, 1, 9), (0, 0, 0, 9)],
        "anomaly_if int, anomaly_zscore int, anomaly_ae int, anomaly_votes_old int",
    )
    got = [r["severity"] for r in classify_severity(table).collect()]
    assert got == ["High", "Medium", "Low", "Normal"]
    none = classify_severity(table.select("anomaly_votes_old"))
    assert {r["severity"] for r in none.collect()} == {"Normal"}
    assert severity_counts(classify_severity(table)).count() == 3


def test_isolation_flags_the_outlier_and_keeps_the_share(spiky):
    inputs = ["meter_reading", "hour", "day_of_week", "month"]
    found = detect_isolation(spiky, inputs, p=FEW).persist()
    n = spiky.count()
    assert found.count() == n
    flagged = found.agg(F.sum("anomaly_if")).first()[0]
    assert abs(flagged - 0.05 * n) <= 2
    assert found.filter("meter_reading = 5000").first()["anomaly_if"] == 1
    again = detect_isolation(spiky.repartition(3), inputs, p=FEW, small_bytes=0)
    assert again.exceptAll(found).count() == 0


def test_tree_samples_are_bounded(spark):
    many = spark.range(40_000).select("id", (F.col("id") % 97).cast("double").alias("x"))
    p = AnomalyParams(trees=10, sample_size=32)
    sizes = [r["count"] for r in tree_samples(many, ["id"], ["x"], p).groupBy("tree").count().collect()]
    assert len(sizes) == 10 and max(sizes) == 32 and min(sizes) == 32
    few = tree_samples(many.filter("id < 100"), ["id"], ["x"], p).groupBy("tree").count().collect()
    assert len(few) == 10 and all(r["count"] == 32 for r in few)


def test_average_path():
    assert average_path(1) == 0 and average_path(2) == 1
    assert average_path(256) == pytest.approx(10.2448, abs=1e-3)


def test_reconstruction_error_matches_numpy(spiky):
    inputs = ["meter_reading", "hour", "day_of_week", "month", "is_weekend"]
    got = rows(detect_reconstruction(spiky, inputs), "building_id", "timestamp")
    x = got[inputs].to_numpy(dtype=float)
    std = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(std == 0, 1, std)
    _, _, vt = np.linalg.svd(z, full_matrices=False)
    rebuilt = z @ vt[:2].T @ vt[:2]
    error = ((z - rebuilt) ** 2).mean(axis=1)
    assert np.allclose(got["recon_error"], error)
    assert got["anomaly_ae"].tolist() == (error > error.mean() + 2 * error.std()).astype(int).tolist()


def test_chain_returns_all_columns(spiky):
    found = detect_anomalies(spiky, FEW)
    for column in ("anomaly_if", "anomaly_zscore", "anomaly_ae", "severity", "deviation_pct"):
        assert column in found.columns
    assert found.filter("meter_reading = 5000").first()["severity"] == "High"
    assert found.count() == spiky.count()


def test_samples_are_the_least_hashes_at_every_size(spark):
    """One scheme: a tree's rows are those of the least hashes, however the table is cut."""
    p = AnomalyParams(trees=7, sample_size=16)
    for n in (10, 40, 3000):
        table = spark.range(n).select("id", (F.col("id") * 1.5).alias("x"))
        got = {}
        for parts in (1, 6):
            sample = tree_samples(table.repartition(parts), ["id"], ["x"], p)
            got[parts] = sorted(map(tuple, sample.collect()))
        assert got[1] == got[6]
        per = [sum(t == k for t, _ in got[1]) for k in range(7)]
        assert per == [min(n, 16)] * 7
        assert n < 100 or len({x for _, x in got[1]}) > 80  # trees draw apart from each other


def test_one_key_with_many_rows_is_bounded(spark):
    """Rows that repeat a key share their hash; a task keeps no more than a tree needs."""
    p = AnomalyParams(trees=3, sample_size=8)
    table = spark.range(4000).select(F.lit(1).alias("id"), F.col("id").cast("double").alias("x"))
    sample = tree_samples(table.repartition(4), ["id"], ["x"], p)
    assert sample.groupBy("tree").count().filter("count > 8").isEmpty()
