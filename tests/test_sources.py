import pytest
from pyspark.sql import functions as F

from meterlens.config import SAMPLE_BUILDINGS
from meterlens.operators import filters, joins
from meterlens.plans.features import feature_branches, feature_columns, run_pipeline, without_group
from meterlens.sources import readers, sinks

READINGS_CSV = """building_id,meter,timestamp,meter_reading
6,0,2016-01-01 00:00:00,10.5
6,0,2016-01-01 01:00:00,0
6,1,2016-01-01 00:00:00,99
7,0,2016-01-01 00:00:00,
12,0,2016-01-01 02:00:00,NaN
12,0,2016-01-01 03:00:00,4
"""
BUILDINGS_CSV = """site_id,building_id,primary_use,square_feet,year_built,floor_count
1,6,Lodging/residential,1000,1990,
1,12,Lodging/residential,3000,,4
2,7,Office,500,2000,2
"""
WEATHER_CSV = """site_id,timestamp,air_temperature,cloud_coverage,dew_temperature,precip_depth_1_hr,sea_level_pressure,wind_direction,wind_speed
1,2016-01-01 00:00:00,25.0,6.0,20.0,,1019.7,0.0,0.0
1,2016-01-01 01:00:00,,,21.1,-1.0,1020.2,70.0,1.5
1,2016-01-01 03:00:00,24.4,,21.1,0.0,1020.2,,0.0
"""


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    for name, text in (("r", READINGS_CSV), ("b", BUILDINGS_CSV), ("w", WEATHER_CSV)):
        (folder / f"{name}.csv").write_text(text)
    return (
        readers.read_readings(spark, str(folder / "r.csv")),
        readers.read_buildings(spark, str(folder / "b.csv")),
        readers.read_weather(spark, str(folder / "w.csv")),
    )


def test_csv_types_and_missing_values(raw):
    readings, buildings, weather = raw
    assert dict(readings.dtypes)["timestamp"] == "timestamp_ntz"
    assert readings.filter("meter_reading is null").count() == 2
    assert readings.filter(F.isnan("meter_reading")).count() == 0
    assert buildings.filter("year_built is null").count() == 1
    assert weather.filter("air_temperature is null").count() == 1


def test_selection_by_list_and_by_buildings(raw):
    readings, buildings, _ = raw
    every = filters.select_readings(readings, buildings)
    assert {r["building_id"] for r in every.collect()} == {6, 12}
    listed = filters.select_readings(readings, buildings, [6])
    assert [r["meter_reading"] for r in listed.collect()] == [10.5]
    assert filters.in_buildings(readings, SAMPLE_BUILDINGS).count() == 5


def test_list_filter_reaches_the_scan(spark, tmp_path, readings):
    path = str(tmp_path / "readings")
    readings.write.parquet(path)
    table = readers.read_table(spark, path)
    kept = filters.positive(filters.in_buildings(table, [1, 2])).select("meter_reading")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "In(building_id" in plan and "GreaterThan(meter_reading,0.0)" in plan
    assert "timestamp" not in plan.split("ReadSchema")[1]


def test_empty_input_is_an_error(raw):
    with pytest.raises(ValueError):
        readers.require_rows(raw[0].filter("building_id = 99"))
    assert readers.require_rows(raw[0]).count() == 6


def test_pipeline_has_43_features(raw):
    matrix = run_pipeline(*raw)
    features = feature_columns(matrix)
    assert len(features) == 43
    temporal, context = feature_branches(features)
    assert len(context) == 10 and len(temporal) == 33
    assert len(without_group(features, "rolling")) == 33
    assert len(without_group(features, "calendar")) == 40
    got = {(r["building_id"], r["timestamp"].hour): r for r in matrix.collect()}
    assert set(got) == {(6, 0), (12, 3)}
    assert got[(6, 0)]["precip_depth_1_hr"] == -1.0 and got[(12, 3)]["wind_direction"] == 70.0
    assert got[(6, 0)]["floor_count"] == 4 and got[(12, 3)]["year_built"] == 1990
    assert [got[k]["is_val"] for k in sorted(got)] == [False, True]


def test_listed_buildings_without_metadata_stay(raw):
    matrix = run_pipeline(*raw, ids=[6, 7, 12])
    assert {r["building_id"] for r in matrix.select("building_id").collect()} == {6, 12}
    readings = raw[0].fillna(3.0, subset=["meter_reading"])
    wide = run_pipeline(readings, *raw[1:], ids=[6, 7, 12])
    office = wide.filter("building_id = 7").first()
    assert office["site_id"] is None and office["square_feet"] == 3000.0


def test_load_or_build(spark, tmp_path, readings):
    path, calls = str(tmp_path / "matrix"), []

    def build():
        calls.append(1)
        return readings.withColumn("is_val", F.col("building_id") == 2)

    first = readers.load_or_build(spark, path, build, ["is_val"])
    second = readers.load_or_build(spark, path, build, ["is_val"])
    assert len(calls) == 1 and first.count() == second.count() == readings.count()
    pruned = second.filter("is_val")._jdf.queryExecution().executedPlan().toString()
    assert "as boolean)], PushedFilters" in pruned
    assert second.filter("is_val").count() == readings.filter("building_id = 2").count()


def test_versions_are_never_overwritten(spark, tmp_path, readings):
    root = str(tmp_path / "matrix")
    sinks.write_split(readings.withColumn("is_val", F.lit(False)), root + "/v1")
    new = readers.read_table(spark, root + "/v1").withColumn("anomaly", F.lit(0))
    assert new.filter("is_val").count() == 0
    path = sinks.write_version(new, root, "v2")
    assert spark.read.parquet(path).count() == readings.count()
    with pytest.raises(Exception):
        sinks.write_version(new, root, "v2")


def test_scenarios_as_json(spark, tmp_path):
    table = spark.createDataFrame([(h, float(h)) for h in range(24)], "hour int, load double")
    mapped = table.agg(F.to_json(sinks.hour_map("hour", "load")).alias("profile"))
    sinks.write_scenarios({"plan": mapped}, str(tmp_path))
    assert '"23":23.0' in spark.read.json(str(tmp_path / "plan")).first()["profile"]


def test_filters(readings, frame):
    last = filters.tail_rows(readings, ["building_id"], 10)
    want = frame.sort_values("timestamp").groupby("building_id").tail(10)
    assert last.count() == len(want)
    assert last.agg(F.sum("meter_reading")).first()[0] == pytest.approx(want["meter_reading"].sum())
    plan = last._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    sizes = frame.groupby("building_id").size()
    kept = filters.with_history(readings, ["building_id"], 100)
    assert kept.count() == sizes[sizes > 100].sum()
    a = filters.subsample(readings, ["building_id", "timestamp"], 50)
    b = filters.subsample(readings.repartition(5), ["building_id", "timestamp"], 50)
    assert a.count() == 50 and a.exceptAll(b).count() == 0


def test_stacked_inputs(readings):
    assert readers.stack([readings, readings, readings]).count() == 3 * readings.count()


def test_medians_weigh_buildings_by_their_readings(spark, readings):
    """Both ways to the medians agree when one building dominates the rows."""
    buildings = spark.createDataFrame(
        [(1, 1, 10.0, 1950.0, 1.0), (1, 2, 30.0, 1990.0, 3.0), (2, 4, None, None, 9.0)],
        "site_id int, building_id long, square_feet double, year_built double, floor_count double",
    )
    weather = spark.createDataFrame(
        [], "site_id int, timestamp timestamp_ntz, air_temperature double"
    )
    plain = joins.enrich(readings, buildings, weather)
    weighted = joins.enrich(readings, buildings, weather, small_bytes=0)
    assert plain.exceptAll(weighted).count() == 0 and weighted.count() == readings.count()
    filled = plain.filter("building_id = 4").first()
    assert (filled["square_feet"], filled["year_built"]) == (10.0, 1950.0)


def test_csv_files_of_another_column_order_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("building_id,meter,timestamp,meter_reading\n1,0,2016-01-01 00:00:00,2.5\n")
    (tmp_path / "b.csv").write_text("meter,building_id,timestamp,meter_reading\n0,6,2016-01-01 00:00:00,2.5\n")
    with pytest.raises(Exception, match="(?i)header"):
        readers.read_readings(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).collect()


def test_csv_values_of_another_type_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("building_id,meter,timestamp,meter_reading\n1,0,2016-01-01 00:00:00,x\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_readings(spark, str(tmp_path / "a.csv")).collect()
