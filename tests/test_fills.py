import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meterlens.operators.fills import fill_along_time, fill_medians, fill_weather, hourly_grid
from meterlens.sources.readers import nan_to_null
from meterlens.operators.joins import join_observations, join_weather
from tests.conftest import rows


@pytest.fixture(params=[{}, {"small_bytes": 0}], ids=["plain", "spread"])
def sizing(request):
    return request.param


@pytest.fixture(scope="module")
def gaps(spark):
    random = np.random.default_rng(3)
    parts = []
    for site in (1, 2, 3):
        n = 2000 if site == 1 else 40
        values = np.where(random.random(n) < 0.9, np.nan, random.normal(size=n))
        values[:5] = np.nan
        if site == 3:
            values[:] = np.nan
        parts.append(pd.DataFrame({
            "site_id": site, "timestamp": pd.date_range("2016-01-20", periods=n, freq="h"),
            "air_temperature": values, "wind_speed": values[::-1],
        }))
    df = pd.concat(parts, ignore_index=True)
    table = nan_to_null(spark.createDataFrame(
        df, "site_id int, timestamp timestamp_ntz, air_temperature double, wind_speed double"
    ))
    return df, table


def test_fill_matches_pandas(gaps, sizing):
    df, table = gaps
    columns = ["air_temperature", "wind_speed"]
    got = rows(fill_along_time(table, ["site_id"], columns, **sizing), "site_id", "timestamp")
    want = df.groupby("site_id")[columns].transform(lambda x: x.ffill().bfill())
    for c in columns:
        assert np.allclose(got[c].astype(float), want[c], equal_nan=True)


def test_weather_without_any_value_becomes_zero(gaps, sizing):
    filled = fill_weather(gaps[1], **sizing)
    assert filled.filter("site_id = 3 and air_temperature <> 0").count() == 0
    assert filled.filter("air_temperature is null or wind_speed is null").count() == 0


def test_median_fill(spark, sizing):
    table = spark.createDataFrame(
        [(1, 10.0), (2, None), (3, 30.0), (4, 50.0), (5, 20.0)], "id int, year double"
    )
    got = rows(fill_medians(table, ["year"], **sizing), "id")
    assert got["year"].tolist() == [10.0, 25.0, 30.0, 50.0, 20.0]


def test_hourly_grid(readings, frame, sizing):
    got = rows(hourly_grid(readings, **sizing), "building_id", "timestamp")
    want = pd.concat([
        part.set_index("timestamp")["meter_reading"].resample("h").mean().ffill().bfill()
        .reset_index().assign(building_id=b)
        for b, part in frame.groupby("building_id")
    ], ignore_index=True)
    assert np.allclose(got["meter_reading"], want["meter_reading"])


@pytest.mark.parametrize("small_bytes", [0, 1 << 30])
def test_null_keys_and_times_keep_their_rows(spark, small_bytes):
    rows = [
        (1, "2016-01-31 23:00:00", 5.0), (1, "2016-02-01 00:00:00", None), (1, None, 4.0),
        (None, "2016-01-01 00:00:00", None), (None, "2016-03-01 00:00:00", 7.0), (2, None, None),
    ]
    df = spark.createDataFrame(rows, "building_id long, timestamp string, v double").withColumn(
        "timestamp", F.col("timestamp").cast("timestamp_ntz")
    )
    filled = fill_along_time(df, ["building_id"], ["v"], small_bytes=small_bytes)
    got = {(r[0], str(r[1]), r[2]) for r in filled.collect()}
    assert got == {
        (1, "2016-01-31 23:00:00", 5.0), (1, "2016-02-01 00:00:00", 5.0), (1, "None", 4.0),
        (None, "2016-01-01 00:00:00", 7.0), (None, "2016-03-01 00:00:00", 7.0), (2, "None", None),
    }


def test_a_stray_year_makes_no_giant_row(spark):
    rows = [(1, "1999-12-31 22:30:00", 1.0), (1, "2001-01-01 00:00:00", 2.0), (2, "2001-01-01", 3.0)]
    df = spark.createDataFrame(rows, "building_id long, timestamp string, meter_reading double") \
        .withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    grid = hourly_grid(df)
    assert grid.count() == 24 * 366 + 3 + 1
    assert grid.filter("meter_reading = 2.0").count() == 1


def test_observations_as_of_a_reading_equal_filled_hours(spark, sizing):
    """Sparse observations joined as of each reading, against every hour filled and joined."""
    random = np.random.default_rng(11)
    hours = pd.date_range("2016-02-27", periods=400, freq="h")
    schema = "site_id int, timestamp timestamp_ntz, air_temperature double, wind_speed double"

    def value():
        return None if random.random() < 0.5 else float(random.normal())

    seen = [(site, hours[int(h)].to_pydatetime(), value(), value())
            for site, n in ((1, 60), (2, 3), (3, 1)) for h in sorted(random.choice(400, n, replace=False))]
    seen += [(4, hours[9].to_pydatetime(), None, None)]
    observed = spark.createDataFrame(seen, schema)
    grid = spark.createDataFrame(
        [(s, h.to_pydatetime()) for s in (1, 2, 3, 4, 5) for h in hours], "site_id int, timestamp timestamp_ntz")
    outside = [hours[0] - pd.Timedelta(hours=1), hours[-1] + pd.Timedelta(hours=1)]
    asked = spark.createDataFrame(
        [(k, s, t and t.to_pydatetime()) for k, (s, t) in enumerate(
            (s, t) for s in (1, 2, 3, 4, 5, 6, None) for t in [*hours, *outside, None])],
        "id int, site_id int, timestamp timestamp_ntz").withColumn("_carried", F.lit("own"))
    every = fill_weather(grid.join(observed, ["site_id", "timestamp"], "left"))
    want = join_weather(asked, every)
    first, last = (F.lit(h.to_pydatetime()).cast("timestamp_ntz") for h in (hours[0], hours[-1]))
    got = join_observations(asked, observed, first, last, **sizing)
    pd.testing.assert_frame_equal(rows(got.select(*want.columns), "id"), rows(want, "id"))
    none = join_observations(asked, observed.limit(0), first, last)
    assert none.filter("air_temperature <> 0 or wind_speed <> 0").isEmpty() and none.count() == asked.count()
