import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlens.operators.ranks import chronological_split, contiguous_folds, exact_quantiles, grouped_quantiles


@pytest.fixture(params=[{}, {"small_bytes": 0}], ids=["plain", "spread"])
def sizing(request):
    return request.param


@pytest.mark.parametrize("q", [0.0, 0.1, 0.5, 0.95, 1.0])
def test_quantiles_match_numpy(spark, sizing, q):
    values = np.random.default_rng(5).normal(size=5001).round(2)
    table = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
    got = spark.range(1).select(exact_quantiles(table, ["x"], q, **sizing)["x"]).first()[0]
    assert got == pytest.approx(np.quantile(values, q), abs=1e-12)


def test_quantile_of_a_dominant_value(spark):
    """A third of all rows sharing one value must not move the answer."""
    values = [1.0] * 400 + [float(v) for v in range(800)]
    table = spark.createDataFrame([(v,) for v in values], "x double")
    got = spark.range(1).select(exact_quantiles(table, ["x"], 0.5, small_bytes=0)["x"]).first()[0]
    assert got == np.quantile(values, 0.5)


def test_split_is_exact_and_chronological(readings, sizing):
    split = chronological_split(readings, **sizing).persist()
    n = readings.count()
    train, val = split.filter("not is_val"), split.filter("is_val")
    assert train.count() == int(0.8 * n) and val.count() == n - int(0.8 * n)
    last = train.agg(F.max(F.struct("timestamp", "building_id"))).first()[0]
    first = val.agg(F.min(F.struct("timestamp", "building_id"))).first()[0]
    assert tuple(last) < tuple(first)


def test_split_inside_one_crowded_hour(spark, sizing):
    """All rows share a timestamp, so the whole cut is a cut of ids."""
    crowd = spark.range(1000).select(
        F.col("id").alias("building_id"), F.lit("2020-01-01").cast("timestamp_ntz").alias("timestamp")
    )
    split = chronological_split(crowd, **sizing)
    assert split.filter("is_val").agg(F.min("building_id"), F.count("*")).first()[:] == (800, 200)


def test_folds_match_unshuffled_kfold(readings, sizing):
    folded = contiguous_folds(readings, 5, **sizing)
    n = readings.count()
    want = [n // 5 + (i < n % 5) for i in range(5)]
    got = folded.groupBy("fold").agg(
        F.count("*").alias("n"), F.min("timestamp").alias("a"), F.max("timestamp").alias("b")
    ).orderBy("fold").collect()
    assert [r["n"] for r in got] == want
    assert all(x["b"] <= y["a"] for x, y in zip(got, got[1:]))


@pytest.mark.parametrize("small_bytes", [0, 1 << 30])
@pytest.mark.parametrize("unknown", [1, 9])
def test_rows_without_time_come_last(spark, small_bytes, unknown):
    rows = [(k, None if k < unknown else f"2016-01-0{1 + k % 3} 00:00:0{k}") for k in range(10)]
    df = spark.createDataFrame(rows, "building_id long, timestamp string").withColumn(
        "timestamp", F.col("timestamp").cast("timestamp_ntz")
    )
    split = chronological_split(df, small_bytes=small_bytes).collect()
    assert sum(not r["is_val"] for r in split) == 8 and len(split) == 10
    last = sorted(split, key=lambda r: (r[1] is None, str(r[1]), r[0]))
    assert [r["is_val"] for r in last] == [False] * 8 + [True] * 2


def test_searched_quantiles_are_exact(spark):
    values = [float(np.float64(x)) for x in np.random.default_rng(3).lognormal(0, 9, 4001)]
    values += [5.0] * 3000 + [-1e300, 1e300, 1e-300]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    for q in (0.0, 0.1, 0.5, 0.9, 1.0):
        got = df.select(exact_quantiles(df, ["v"], q, small_bytes=0)["v"]).first()[0]
        assert got == pytest.approx(np.quantile(values, q), rel=1e-12)
    none = df.filter("v is null")
    assert none.select(exact_quantiles(none, ["v"], 0.5, small_bytes=0)["v"]).first()[0] is None


def _odd(spark):
    nan, inf = float("nan"), float("inf")
    values = [1.0, 2.0, 3.0, 4.0, nan, inf, -inf, 0.0, -0.0, -1.5, 1e-300, -1e300, None, 2.0, 2.0, nan]
    random = np.random.default_rng(8)
    rows = [(k, v, float(n)) for k in ("a", "b", None) for n, v in enumerate(values)]
    rows += [("hot", float(v), float(v) ** 3) for v in random.normal(size=2000)]
    rows += [("nan", nan, None), ("none", None, None), ("one", 7.0, 1.0)]
    return spark.createDataFrame(rows, "k string, x double, y double").repartition(5)


@pytest.mark.parametrize("q", [0.25, 0.95])
def test_grouped_quantiles_are_those_of_percentile(spark, q):
    """NaN above all, infinities, NULL keys, groups without values, one hot group."""
    table = _odd(spark)
    got = grouped_quantiles(table, ["k"], ["x", "y"], q)
    table = table.withColumns({c: F.col(c) + F.lit(0.0) for c in "xy"})  # -0.0 is printed apart
    want = table.groupBy("k").agg(*[F.percentile(c, F.lit(q)).alias(c) for c in "xy"])
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    whole = table.agg(*[F.percentile(c, F.lit(q)).alias(c) for c in "xy"])
    assert str(grouped_quantiles(table, [], ["x", "y"], q).first()) == str(whole.first())


def test_nan_counts_as_a_value(spark, sizing):
    table = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, 4.0, float("nan"))], "x double")
    got = spark.range(1).select(exact_quantiles(table, ["x"], 0.5, **sizing)["x"]).first()[0]
    assert got == 3.0


def test_no_values(spark, sizing):
    table = spark.createDataFrame([], "x double")
    assert spark.range(1).select(exact_quantiles(table, ["x"], 0.5, **sizing)["x"]).first()[0] is None


@pytest.mark.parametrize("small_bytes", [-1, 1 << 30])
def test_split_with_ids_of_any_type(spark, small_bytes):
    """String and date ids are ranked like numbers, in one crowded hour."""
    crowd = spark.range(1000).select(
        F.format_string("id%05d", "id").alias("s"), F.date_add(F.lit("2020-01-01"), F.col("id").cast("int")).alias("d"),
        F.lit("2020-01-01").cast("timestamp_ntz").alias("timestamp"),
    )
    for key, first in (("s", "id00800"), ("d", None)):
        split = chronological_split(crowd, key=key, small_bytes=small_bytes).filter("is_val")
        low, n = split.agg(F.min(key), F.count("*")).first()
        assert n == 200 and (first is None or low == first)
