"""Sources and sinks as queries: written to the shared folder of the session and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from meterlens.catalog.base import Query, lodging_rooms, rounded, selected, sql
from meterlens.catalog.readings import CALENDAR_SQL, HOLIDAY_SQL
from meterlens.functions.calendar import add_holiday_flag, add_time_features, holiday_calendar
from meterlens.functions.scalars import hour_label
from meterlens.operators import profiles, scores
from meterlens.operators.ranks import chronological_split
from meterlens.plans.load import stagger_profile, stagger_summary
from meterlens.session import shared_folder
from meterlens.sources import readers, sinks, tables
from meterlens.sources.schemas import BUILDINGS, READINGS, WEATHER


def _new(spark) -> str:
    return f"{shared_folder(spark).rstrip('/')}/meterlens-{uuid.uuid4().hex}"


def _csv(spark, table, read, names):
    """A table as CSV with its columns turned round, read by header name."""
    path = _new(spark)
    table.select(*reversed(table.columns)).write.option("header", True).csv(path)
    return read(spark, path).select(*names)


def _split(spark, d):
    path = _new(spark)
    sinks.write_split(chronological_split(selected(spark, d)), path)
    return readers.read_table(spark, path)


def _built_once(spark, d):
    """The second call must find what the first one wrote."""
    path = _new(spark)
    readers.load_or_build(spark, path, lambda: selected(spark, d))
    return readers.load_or_build(spark, path, lambda: selected(spark, d).limit(0))


def _version(spark, d):
    root = _new(spark)
    derived = selected(spark, d).withColumn("label", hour_label(F.hour("timestamp")))
    return readers.read_table(spark, sinks.write_version(derived, root, "labelled"))


def _metrics(spark, d):
    """Metrics of all models, beside a report and a model that is not registered."""
    folder = _new(spark)
    metrics = scores.model_metrics(tables.predictions(spark, d))
    sinks.save_metrics(metrics, folder)
    sinks.write_report(scores.comparison_report(metrics), f"{folder}/report")
    loaded = sinks.load_metrics(spark, folder)
    return sinks.registered_metrics(loaded, ["lag1", "roll24"])


def _report(spark, d):
    """The leaderboard of a comparison report, as its JSON document tells it."""
    folder = _new(spark)
    sinks.write_report(scores.comparison_report(scores.model_metrics(tables.predictions(spark, d))), folder)
    entry = "rank: int, model: string, r2: double, rmse: double, mae: double, mape: double"
    return spark.read.schema(f"leaderboard array<struct<{entry}>>").json(folder).select(F.inline("leaderboard"))


def _predictions(spark, d):
    folder = _new(spark)
    sinks.write_predictions(scores.finite_pairs(tables.predictions(spark, d)), folder)
    back = spark.read.schema(
        "building_id long, timestamp timestamp_ntz, actual double, prediction double, model string"
    ).json(folder)
    return back.select("building_id", "timestamp", "actual", "model", "prediction")


def _importance(spark, d):
    """The share of squared load that each building carries, as an importance table."""
    folder = _new(spark)
    means = profiles.building_means(selected(spark, d))
    sinks.write_importance(means.select(
        F.col("building_id").cast("string").alias("feature"), F.col("mean_load").alias("importance")
    ), folder)
    return rounded(spark.read.schema("feature string, importance double").json(folder))


def _scenarios(spark, d):
    folder = _new(spark)
    rooms = lodging_rooms(spark, d)
    sinks.write_scenarios({
        "staggering": stagger_profile(rooms, ["building_id"]),
        "summary": stagger_summary(rooms, ["building_id"]),
    }, folder)
    return spark.read.schema("building_id long").json(f"{folder}/summary").select("building_id")


def _orders(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select(
        F.col("o_orderkey").cast("long").alias("o_orderkey"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("timestamp"),
    )


def _holiday_orders(spark, d):
    flagged = add_holiday_flag(_orders(spark, d), holiday_calendar(spark))
    return flagged.groupBy(F.to_date("timestamp").alias("day"), "is_holiday").agg(
        F.count("*").alias("n"))


ROUNDTRIPS = {
    "csv_roundtrip": Query(
        lambda s, d: _csv(s, tables.readings(s, d), readers.read_readings, READINGS.names),
        sql("select * from readings", "readings")),
    "buildings_csv_roundtrip": Query(
        lambda s, d: _csv(s, tables.buildings(s, d), readers.read_buildings, BUILDINGS.names),
        sql("select * from buildings", "buildings")),
    "weather_csv_roundtrip": Query(
        lambda s, d: _csv(s, tables.weather(s, d), readers.read_weather, WEATHER.names),
        sql("select * from weather", "weather")),
    "report_roundtrip": Query(_report, sql("""select cast(row_number() over
          (order by r2 desc nulls last, model) as integer) as rank, model, r2, rmse, mae, mape
          from metrics""", "metrics")),
    "split_roundtrip": Query(
        _split, sql("select building_id, timestamp, meter_reading, is_val from split", "split")),
    "load_or_build": Query(
        _built_once, sql("select building_id, timestamp, meter_reading from sel", "sel")),
    "version_roundtrip": Query(
        _version, sql("""select building_id, timestamp, meter_reading,
          lpad(cast(hour(timestamp) as varchar), 2, '0') as label from sel""", "sel")),
    "metrics_roundtrip": Query(
        _metrics, sql("""select model, r2, rmse, mae, mape from metrics
          where model in ('lag1', 'roll24')""", "metrics")),
    "predictions_roundtrip": Query(
        _predictions,
        sql("select building_id, timestamp, actual, model, prediction from pairs", "pairs")),
    "importance_roundtrip": Query(
        _importance, sql("""select cast(building_id as varchar) as feature,
          round(mean_load, 6) as importance from means""", "means")),
    "scenario_roundtrip": Query(_scenarios, sql("select building_id from lodging", "lodging")),
    "site_audit": Query(
        lambda s, d: profiles.site_audit(tables.readings(s, d), tables.buildings(s, d)),
        sql("""select count(distinct site_id) as n_sites, count(distinct r.building_id) as n_buildings,
          cast(count(*) filter (where site_id is null) as bigint) as n_unplaced
          from readings r left join buildings b on r.building_id = b.building_id""",
            "readings", "buildings")),
    "calendar_orders": Query(
        lambda s, d: rounded(add_time_features(_orders(s, d))),
        f"""select o_orderkey::bigint as o_orderkey, timestamp, {CALENDAR_SQL}
          from (select o_orderkey, o_orderdate::timestamp as timestamp from orders) o"""),
    "holiday_orders": Query(
        _holiday_orders,
        f"""select d as day, {HOLIDAY_SQL} as is_holiday, count(*) as n
          from (select cast(o_orderdate as date) as d from orders) o group by 1, 2"""),
}
