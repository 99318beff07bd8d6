"""What a registered query is, and the shared views of the check SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from meterlens.operators.filters import select_readings
from meterlens.operators.joins import join_buildings, join_weather
from meterlens.operators.fills import fill_weather
from meterlens.plans.features import filled_buildings
from meterlens.sources import tables


@dataclass(frozen=True)
class Query:
    """``run(spark, folder)`` and, where SQL can express it, the check SQL."""

    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def rounded(df: DataFrame, places: int = 6, fine: str = "-") -> DataFrame:
    """All double columns rounded for comparison, half away from zero.

    Columns that begin with ``fine`` keep 8 places: a mean of cents over 16 or 32
    rows ends there, where 6 places would leave ties that its last bit decides.
    """
    return df.select(*[
        (F.round(f.name, 8 if f.name.startswith(fine) else places) + F.lit(0.0)).alias(f.name)
        if isinstance(f.dataType, DoubleType)
        else f.name
        for f in df.schema.fields
    ])


def selected(spark: SparkSession, folder: str) -> DataFrame:
    """Positive electricity readings of all lodging buildings."""
    return select_readings(
        tables.readings(spark, folder), tables.buildings(spark, folder)
    ).select("building_id", "timestamp", "meter_reading")


def located(spark: SparkSession, folder: str) -> DataFrame:
    """Selected readings with site and filled weather."""
    with_site = join_buildings(
        selected(spark, folder), filled_buildings(tables.buildings(spark, folder))
    ).select("building_id", "timestamp", "meter_reading", "site_id")
    return join_weather(with_site, fill_weather(tables.weather(spark, folder)))


def lodging_rooms(spark: SparkSession, folder: str) -> DataFrame:
    """(building_id, rooms) of all lodging buildings."""
    return filled_buildings(tables.buildings(spark, folder)).select(
        "building_id", (50 + (F.col("building_id") * 7) % 200).alias("rooms")
    )


# Views of the check SQL: name -> (views it needs, text).
VIEWS = {
    "readings": ([], """
        select building_id, meter, timestamp,
               case when (building_id + hour(timestamp)) % 25 = 0 then 0.0
                    else total end as meter_reading
        from (select user_id as building_id,
                     cast(case when event_type = 'error' then 1 else 0 end as integer) as meter,
                     date_trunc('hour', ts) as timestamp, round(sum(value), 6) as total
              from events group by 1, 2, 3) e"""),
    "buildings": ([], """
        select c_custkey as building_id, cast(c_nationkey as integer) as site_id,
               case when c_mktsegment = 'FURNITURE' then 'Office'
                    else 'Lodging/residential' end as primary_use,
               abs(c_acctbal) * 10 as square_feet,
               case when c_custkey % 7 = 0 then null
                    else cast(1950 + c_custkey % 70 as double) end as year_built,
               case when c_custkey % 5 = 0 then null
                    else cast(1 + c_custkey % 12 as double) end as floor_count
        from customer"""),
    "elec": (["readings"], """
        select building_id, timestamp, meter_reading
        from readings where meter = 0 and meter_reading > 0"""),
    "lodging": (["buildings"], """
        select building_id, site_id, primary_use, square_feet,
               coalesce(year_built, median(year_built) over ()) as year_built,
               coalesce(floor_count, median(floor_count) over ()) as floor_count
        from buildings where primary_use = 'Lodging/residential'"""),
    "sel": (["elec", "lodging"], """
        select * from elec where building_id in (select building_id from lodging)"""),
    "weather_obs": ([], """
        select cast(c_nationkey as integer) as site_id, date_trunc('hour', ts) as timestamp,
               round(avg(value), 6) as air_temperature,
               cast(max(event_id % 10) as double) as cloud_coverage,
               case when c_nationkey % 5 = 0 then null else min(value) end as precip_depth_1_hr,
               round(avg(value) / 2, 6) as dew_temperature,
               max(value) as sea_level_pressure,
               cast(max(event_id % 360) as double) as wind_direction,
               min(value) / 4 as wind_speed
        from events join customer on user_id = c_custkey
        where event_type = 'error' group by c_nationkey, date_trunc('hour', ts)"""),
    "weather": (["weather_obs"], """
        select g.site_id, g.timestamp, o.* exclude (site_id, timestamp)
        from (select s.site_id, unnest(generate_series(h.a, h.b, interval 1 hour)) as timestamp
              from (select distinct cast(c_nationkey as integer) as site_id from customer) s,
                   (select date_trunc('hour', min(ts)) as a,
                           date_trunc('hour', max(ts)) as b from events) h) g
        left join weather_obs o on g.site_id = o.site_id and g.timestamp = o.timestamp"""),
    "filled_weather": (["weather"], "select site_id, timestamp, " + ", ".join(
        f"""coalesce(last_value({c} ignore nulls) over (partition by site_id order by timestamp
              rows between unbounded preceding and current row),
            first_value({c} ignore nulls) over (partition by site_id order by timestamp
              rows between unbounded preceding and unbounded following), 0) as {c}"""
        for c in ("air_temperature", "cloud_coverage", "dew_temperature", "precip_depth_1_hr",
                  "sea_level_pressure", "wind_direction", "wind_speed")) + " from weather"),
    "located": (["sel", "lodging", "filled_weather"], """
        select s.building_id, s.timestamp, s.meter_reading, l.site_id,
               """ + ", ".join(f"coalesce(w.{c}, 0) as {c}" for c in (
        "air_temperature", "cloud_coverage", "dew_temperature", "precip_depth_1_hr",
        "sea_level_pressure", "wind_direction", "wind_speed")) + """
        from sel s left join lodging l on s.building_id = l.building_id
        left join filled_weather w on l.site_id = w.site_id and s.timestamp = w.timestamp"""),
    "predictions": (["elec"], """
        select building_id, timestamp, meter_reading as actual, p.model,
               case p.model when 'lag1' then l1 when 'lag24' then l24 else r24 end as prediction
        from (select *, lag(meter_reading, 1) over w as l1, lag(meter_reading, 24) over w as l24,
                     round(avg(meter_reading) over (partition by building_id order by timestamp
                           rows between 24 preceding and 1 preceding), 6) as r24
              from elec window w as (partition by building_id order by timestamp)) x
        cross join (select 'lag1' as model union all select 'lag24' union all select 'roll24') p"""),
    "pairs": (["predictions"], "select * from predictions where prediction is not null"),
    "raw_metrics": (["pairs"], """
        select model,
               case when var_pop(actual) > 0 then
                 1 - sum((actual - prediction) * (actual - prediction))
                     / (var_pop(actual) * count(*)) end as r2,
               sqrt(avg((actual - prediction) * (actual - prediction))) as rmse,
               avg(abs(actual - prediction)) as mae,
               avg(case when actual <> 0 then abs((actual - prediction) / actual) end) * 100 as mape,
               count(*) as n
        from pairs group by model"""),
    "metrics": (["raw_metrics"], """
        select model, round(r2, 6) as r2, round(rmse, 4) as rmse, round(mae, 4) as mae,
               round(mape, 4) as mape, n from raw_metrics"""),
    "split": (["sel"], """
        select *, row_number() over (order by timestamp, building_id)
                    > floor(count(*) over () * 0.8::double) as is_val from sel"""),
    "profile": (["sel"], """
        select cast(hour(timestamp) as integer) as hour, avg(meter_reading) as load
        from sel group by 1"""),
    "profile_b": (["sel"], """
        select building_id, cast(hour(timestamp) as integer) as hour, avg(meter_reading) as load
        from sel group by 1, 2"""),
    "means": (["sel"], """
        select building_id, avg(meter_reading) as mean_load from sel group by 1"""),
    "scored": (["sel"], """
        select *, (meter_reading - mean) / (std + 1e-8) as zscore,
               (meter_reading - mean) / (mean + 1e-8) * 100 as deviation_pct
        from (select *, avg(meter_reading) over (partition by building_id) as mean,
                     stddev_samp(meter_reading) over (partition by building_id) as std
              from sel) s"""),
}


def sql(text: str, *views: str) -> str:
    """Check SQL with the listed views (and those they need) in front."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in VIEWS[name][0]:
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for view in views:
        visit(view)
    head = ", ".join(f"{v} as ({VIEWS[v][1].strip()})" for v in ordered)
    body = text.strip()
    if not head:
        return body
    return f"with {head}, {body[5:]}" if body.startswith("with ") else f"with {head} {body}"
