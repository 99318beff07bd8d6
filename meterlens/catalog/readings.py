"""Queries on readings: scans, features, profiles and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterlens.catalog.base import Query, located, rounded, selected, sql
from meterlens.config import LAGS, ROLLING, WEATHER_FEATURES
from meterlens.functions.calendar import add_holiday_flag, add_time_features
from meterlens.operators import filters, profiles, scores
from meterlens.operators.fills import fill_weather, hourly_grid
from meterlens.operators.joins import enrich, join_buildings, join_observations
from meterlens.operators.ranks import chronological_split, contiguous_folds
from meterlens.operators.windows import (
    add_history_features, add_sequence_statistics, add_sequences,
)
from meterlens.plans.features import add_log_target, feature_matrix, filled_buildings, run_pipeline
from meterlens.plans.load import savings_calculator
from meterlens.sources import tables

W24 = "(partition by building_id order by timestamp rows between 24 preceding and 1 preceding)"
CALENDAR_SQL = """
    cast(hour(timestamp) as integer) as hour, cast(isodow(timestamp) - 1 as integer) as day_of_week,
    cast(day(timestamp) as integer) as day_of_month, cast(month(timestamp) as integer) as month,
    cast(week(timestamp) as integer) as week_of_year,
    cast(quarter(timestamp) as integer) as quarter,
    cast(case when isodow(timestamp) >= 6 then 1 else 0 end as integer) as is_weekend,
    cast(case when month(timestamp) between 1 and 5 then 1
              when month(timestamp) between 8 and 12 then 2 else 0 end as integer)
      as semester_period,
    round(sin(2 * pi() * hour(timestamp) / 24), 6) + 0.0 as hour_sin,
    round(cos(2 * pi() * hour(timestamp) / 24), 6) + 0.0 as hour_cos,
    round(sin(2 * pi() * (isodow(timestamp) - 1) / 7), 6) + 0.0 as dow_sin,
    round(cos(2 * pi() * (isodow(timestamp) - 1) / 7), 6) + 0.0 as dow_cos,
    round(sin(2 * pi() * month(timestamp) / 12), 6) + 0.0 as month_sin,
    round(cos(2 * pi() * month(timestamp) / 12), 6) + 0.0 as month_cos"""


def _fixed(month: int, day: int) -> str:
    """Is the date a fixed holiday or its weekday stand-in?"""
    that = f"make_date(year(d), {month}, {day})"
    return (
        f"d = {that} or (d = {that} - 1 and isodow({that}) = 6)"
        f" or (d = {that} + 1 and isodow({that}) = 7)"
    )


HOLIDAY_SQL = f"""cast(case when
    {_fixed(1, 1)} or (year(d) >= 2021 and ({_fixed(6, 19)})) or {_fixed(7, 4)} or {_fixed(11, 11)} or {_fixed(12, 25)}
    or (month(d) = 12 and day(d) = 31 and isodow(d) = 5)
    or (isodow(d) = 1 and ((month(d) = 1 and day(d) between 15 and 21)
      or (month(d) = 2 and day(d) between 15 and 21) or (month(d) = 5 and day(d) >= 25)
      or (month(d) = 9 and day(d) <= 7) or (month(d) = 10 and day(d) between 8 and 14)))
    or (isodow(d) = 4 and month(d) = 11 and day(d) between 22 and 28)
  then 1 else 0 end as integer)"""


def _lag_sql(sizes) -> str:
    return ", ".join(
        f"coalesce(lag(meter_reading, {k}) over (partition by building_id order by timestamp), 0)"
        f" as lag_{k}h" for k in sizes
    )


def _rolling_sql(sizes) -> str:
    items = []
    for n in sizes:
        frame = (
            f"(partition by building_id order by timestamp rows between {n - 1} preceding"
            " and current row)"
        )
        items.append(f"round(avg(meter_reading) over {frame}, 8) as rolling_mean_{n}h")
        items.append(
            f"coalesce(round(stddev_samp(meter_reading) over {frame}, 8), 0) as rolling_std_{n}h"
        )
    return ", ".join(items)


def _matrix(spark, d):
    return feature_matrix(
        tables.readings(spark, d), tables.buildings(spark, d), tables.weather(spark, d)
    )


def _busiest(spark, d):
    rows = selected(spark, d)
    return profiles.mean_by_timestamp(
        filters.in_buildings(rows, profiles.top_buildings(rows, 1).select("building_id"))
    )


def _sequences(df):
    total = F.aggregate("sequence", F.lit(0.0), lambda a, b: a + b)
    return rounded(df.select(
        "building_id", "timestamp", "meter_reading",
        F.size("sequence").alias("n"), total.alias("seq_sum"),
        F.element_at("sequence", 1).alias("seq_first"),
        F.element_at("sequence", -1).alias("seq_last"),
    ))


def _lookback(spark, d):
    return _sequences(add_sequences(selected(spark, d), lookback=24))


def _sites(spark, d):
    """Hourly sums per site, with the site as building: histories long enough for a week."""
    return located(spark, d).groupBy("site_id", "timestamp").agg(
        F.round(F.sum("meter_reading"), 6).alias("meter_reading")
    ).withColumnRenamed("site_id", "building_id")


def _site_lookback(spark, d):
    return _sequences(add_sequences(_sites(spark, d), lookback=168)).withColumnRenamed("building_id", "site_id")


def _site_statistics(spark, d, **splitting):
    found = add_sequence_statistics(_sites(spark, d), **splitting)
    return rounded(found.withColumnRenamed("building_id", "site_id").drop("meter_reading"), 6)


def _val_sequences(spark, d):
    split = chronological_split(selected(spark, d))
    train = split.filter(~F.col("is_val"))
    enough = filters.with_history(train, ["building_id"], 24).select("building_id").distinct()
    rows = add_sequences(split, lookback=24).filter("is_val")
    return _sequences(filters.in_buildings(rows, enough))


def _scaled(spark, d):
    rows = add_time_features(selected(spark, d)).select(
        "building_id", "timestamp", "meter_reading", "hour"
    )
    return rounded(scores.add_standardised(rows, ["meter_reading", "hour"]))


def _calculator(spark, d):
    """Sums, means and products of readings as decimals, rounded once."""
    kwh = selected(spark, d).groupBy("building_id").agg(
        F.sum(F.col("meter_reading").cast("decimal(20,6)")).cast("decimal(20,6)").alias("kwh"),
        F.count_distinct(F.to_date("timestamp")).cast("decimal(10,0)").alias("days"),
    )
    daily = kwh.select("building_id", (F.col("kwh") / F.col("days")).alias("daily_kwh"))
    saved = savings_calculator(daily)
    return saved.select("building_id", *(
        F.round(c, 4).cast("double").alias(c) for c in saved.columns if c != "building_id"
    ))


def _rational(numerator: int, denominator: int, name: str) -> str:
    """SQL of a share of the daily mean t / n (t in millionths), rounded half up to 4 places."""
    above, below = 2 * 10_000 * numerator, 1_000_000 * denominator
    return f"((t * {above} + n * {below}) // (2 * n * {below}))::double / 10000 as {name}"


def _weather_asof(spark, d):
    """Weather from observations alone, equal to the join on the filled hours of all sites."""
    sited = join_buildings(selected(spark, d), filled_buildings(tables.buildings(spark, d))).select(
        "building_id", "timestamp", "meter_reading", "site_id")
    span = tables.weather_span(spark, d)
    return rounded(join_observations(
        sited, tables.weather_observations(spark, d), span["first"], span["last"]))


def _holidays(spark, d):
    days = selected(spark, d)
    flagged = add_holiday_flag(days)
    return rounded(flagged.groupBy(F.to_date("timestamp").alias("day"), "is_holiday").agg(
        F.count("*").alias("n"), F.avg("meter_reading").alias("mean_load")
    ))


HOURLY_SQL = """
          select g.building_id, g.timestamp,
            round(coalesce(last_value(meter_reading ignore nulls) over (partition by g.building_id
              order by g.timestamp rows between unbounded preceding and current row),
            first_value(meter_reading ignore nulls) over (partition by g.building_id
              order by g.timestamp rows between unbounded preceding and unbounded following)), 6)
            as meter_reading
          from (select building_id, unnest(generate_series(min(timestamp), max(timestamp),
                  interval 1 hour)) as timestamp from sel group by building_id) g
          left join sel s on g.building_id = s.building_id and g.timestamp = s.timestamp"""

SEQ_SQL = """select building_id, timestamp, meter_reading, cast(len(s) as integer) as n,
  round(list_sum(s), 6) as seq_sum, s[1] as seq_first, s[-1] as seq_last"""

SITE_STATISTICS_SQL = """select site_id, timestamp, round(list_avg(s), 6) as seq_mean,
    round(list_min(s), 6) as seq_min, round(list_max(s), 6) as seq_max, round(s[168], 6) as seq_last,
    round((list_sum(list_transform(s, lambda x, i: x * (i - 1))) - 83.5 * list_sum(s))
      / (168 * (168 * 168 - 1) / 12.0), 6) as seq_slope
  from (select *, list(meter_reading) over
      (partition by site_id order by timestamp rows between 168 preceding and 1 preceding) as s
    from (select site_id, timestamp, round(sum(meter_reading), 6) as meter_reading
      from located group by 1, 2) y) x where len(s) = 168"""

READINGS = {
    "hourly_profile": Query(
        lambda s, d: rounded(profiles.hourly_profile(selected(s, d))),
        sql("select hour, round(load, 6) as load from profile", "profile"),
    ),
    "hourly_profile_by_building": Query(
        lambda s, d: rounded(profiles.hourly_profile(selected(s, d), ["building_id"])),
        sql("select building_id, hour, round(load, 6) as load from profile_b", "profile_b"),
    ),
    "kpi_overview": Query(
        lambda s, d: rounded(profiles.kpi_row(selected(s, d)), 4),
        sql("""select round(sum(meter_reading), 4) as total_kwh,
          (select round(avg(t), 4) from (select sum(meter_reading) as t from sel
             group by cast(timestamp as date))) as avg_daily_kwh,
          max(meter_reading) as peak_kw, count(distinct building_id) as n_buildings from sel""",
            "sel"),
    ),
    "selected_readings": Query(
        lambda s, d: selected(s, d),
        sql("select building_id, timestamp, meter_reading from sel", "sel"),
    ),
    "load_audit": Query(
        lambda s, d: profiles.load_audit(filters.target_meter(tables.readings(s, d))),
        sql("""select count(*) as rows_read, count(*) filter (where meter_reading > 0) as rows_kept,
          count(*) filter (where not meter_reading > 0) as rows_removed,
          count(distinct building_id) as n_buildings, min(timestamp) as first_ts,
          max(timestamp) as last_ts from readings where meter = 0""", "readings"),
    ),
    "time_features": Query(
        lambda s, d: rounded(add_log_target(add_time_features(selected(s, d)))),
        sql(f"""select building_id, timestamp, meter_reading, {CALENDAR_SQL},
          round(ln(1 + meter_reading), 6) as meter_reading_log from sel""", "sel"),
    ),
    "holiday_load": Query(
        _holidays,
        sql(f"""select d as day, {HOLIDAY_SQL} as is_holiday, count(*) as n,
          round(avg(meter_reading), 6) as mean_load
          from (select *, cast(timestamp as date) as d from sel) x group by 1, 2""", "sel"),
    ),
    "building_fill": Query(
        lambda s, d: rounded(filled_buildings(tables.buildings(s, d))),
        sql("""select building_id, site_id, primary_use, round(square_feet, 6) as square_feet,
          year_built, floor_count from lodging""", "lodging"),
    ),
    "weather_fill": Query(
        lambda s, d: rounded(fill_weather(tables.weather(s, d))),
        sql("select site_id, timestamp, " + ", ".join(
            f"round({c}, 6) as {c}" for c in WEATHER_FEATURES) + " from filled_weather",
            "filled_weather"),
    ),
    "weather_asof": Query(
        _weather_asof,
        sql("select building_id, timestamp, meter_reading, site_id, " + ", ".join(
            f"round({c}, 6) as {c}" for c in WEATHER_FEATURES) + " from located", "located"),
    ),
    "enriched_readings": Query(
        lambda s, d: rounded(enrich(
            filters.positive(filters.target_meter(tables.readings(s, d))).drop("meter"),
            filled_buildings(tables.buildings(s, d)),
            fill_weather(tables.weather(s, d)),
        )),
        sql("""select e.building_id, e.timestamp, e.meter_reading, l.site_id,
          round(coalesce(l.square_feet, median(l.square_feet) over ()), 6) as square_feet,
          coalesce(l.year_built, median(l.year_built) over ()) as year_built,
          coalesce(l.floor_count, median(l.floor_count) over ()) as floor_count, """
            + ", ".join(f"round(coalesce(w.{c}, 0), 6) as {c}" for c in WEATHER_FEATURES) + """
          from elec e left join lodging l on e.building_id = l.building_id
          left join filled_weather w on l.site_id = w.site_id and e.timestamp = w.timestamp""",
            "elec", "lodging", "filled_weather"),
    ),
    "lag_features": Query(
        lambda s, d: add_history_features(selected(s, d), rolling=[]),
        sql(f"select building_id, timestamp, meter_reading, {_lag_sql(LAGS)} from sel", "sel"),
    ),
    "rolling_features": Query(
        lambda s, d: rounded(add_history_features(selected(s, d), lags=[]), 8),
        sql(f"select building_id, timestamp, meter_reading, {_rolling_sql(ROLLING)} from sel",
            "sel"),
    ),
    "feature_matrix": Query(
        lambda s, d: rounded(_matrix(s, d), fine="rolling_"),
        sql(f"""select m.building_id, m.timestamp, m.meter_reading, l.site_id,
          m.* exclude (building_id, timestamp, meter_reading),
          round(l.square_feet, 6) as square_feet, l.year_built, l.floor_count, """
            + ", ".join(f"round(coalesce(w.{c}, 0), 6) as {c}" for c in WEATHER_FEATURES) + f"""
          from (select building_id, timestamp, meter_reading, {_lag_sql(LAGS)},
            {_rolling_sql(ROLLING)}, {CALENDAR_SQL}, {HOLIDAY_SQL} as is_holiday,
            round(ln(1 + meter_reading), 6) as meter_reading_log
            from (select *, cast(timestamp as date) as d from sel) x) m
          join lodging l on m.building_id = l.building_id
          left join filled_weather w on l.site_id = w.site_id and m.timestamp = w.timestamp""",
            "sel", "lodging", "filled_weather"),
    ),
    "chronological_split": Query(
        lambda s, d: chronological_split(selected(s, d)),
        sql("select building_id, timestamp, meter_reading, is_val from split", "split"),
    ),
    "split_audit": Query(
        lambda s, d: profiles.split_audit(chronological_split(selected(s, d))),
        sql("""select is_val, count(*) as n, min(timestamp) as first_ts,
          max(timestamp) as last_ts from split group by is_val""", "split"),
    ),
    "lookback_sequences": Query(
        _lookback,
        sql(f"""{SEQ_SQL} from (select *, list(meter_reading) over {W24} as s from sel) x
          where len(s) = 24""", "sel"),
    ),
    "site_week_sequences": Query(
        _site_lookback,
        sql(f"""{SEQ_SQL.replace('building_id', 'site_id')} from (select *, list(meter_reading) over
            (partition by site_id order by timestamp rows between 168 preceding and 1 preceding)
            as s from (select site_id, timestamp, round(sum(meter_reading), 6) as meter_reading
              from located group by 1, 2) y) x where len(s) = 168""", "located"),
    ),
    "sequence_statistics": Query(_site_statistics, sql(SITE_STATISTICS_SQL, "located")),
    "sequence_statistics_split": Query(
        lambda s, d: _site_statistics(s, d, split_above=60, small_bytes=0),
        sql(SITE_STATISTICS_SQL, "located")),
    "validation_sequences": Query(
        _val_sequences,
        sql(f"""{SEQ_SQL} from (select *, list(meter_reading) over {W24} as s from split) x
          where len(s) = 24 and is_val and building_id in
            (select building_id from split where not is_val group by 1 having count(*) > 24)""",
            "split"),
    ),
    "tail_readings": Query(
        lambda s, d: filters.tail_rows(selected(s, d), ["building_id"], 24),
        sql("""select building_id, timestamp, meter_reading from (select *, row_number() over
          (partition by building_id order by timestamp desc) as rn from sel) x where rn <= 24""",
            "sel"),
    ),
    "buildings_with_history": Query(
        lambda s, d: filters.with_history(selected(s, d), ["building_id"], 48),
        sql("""select building_id, timestamp, meter_reading from sel where building_id in
          (select building_id from sel group by 1 having count(*) > 48)""", "sel"),
    ),
    "stacked_split": Query(
        lambda s, d: (lambda x: x.filter(~F.col("is_val")).unionByName(x.filter("is_val")))(
            chronological_split(selected(s, d))),
        sql("select building_id, timestamp, meter_reading, is_val from split", "split"),
    ),
    "hourly_regularise": Query(
        lambda s, d: rounded(hourly_grid(selected(s, d))),
        sql(HOURLY_SQL, "sel"),
    ),
    "building_means": Query(
        lambda s, d: rounded(profiles.building_means(selected(s, d))),
        sql("select building_id, round(mean_load, 6) as mean_load from means", "means"),
    ),
    "imbalance": Query(
        lambda s, d: rounded(profiles.imbalance(profiles.building_means(selected(s, d)))),
        sql("""select round(stddev_samp(mean_load) / (avg(mean_load) + 1e-8), 6) as imbalance,
          count(*) as n_buildings from means""", "means"),
    ),
    "mean_by_timestamp": Query(
        lambda s, d: rounded(profiles.mean_by_timestamp(selected(s, d))),
        sql("""select timestamp, round(avg(meter_reading), 6) as mean_load
          from sel group by timestamp""", "sel"),
    ),
    "busiest_building_timeline": Query(
        lambda s, d: rounded(_busiest(s, d)),
        sql("""select timestamp, round(avg(meter_reading), 6) as mean_load from sel
          where building_id = (select building_id from means order by mean_load desc, building_id
            limit 1) group by timestamp""", "sel", "means"),
    ),
    "heatmap": Query(
        lambda s, d: rounded(profiles.weekday_hour_heatmap(selected(s, d)), 8),
        sql("select cast(isodow(timestamp) - 1 as integer) as day_of_week, " + ", ".join(
            f"round(avg(meter_reading) filter (where hour(timestamp) = {h}), 8) as h{h:02d}"
            for h in range(24)) + " from sel group by 1", "sel"),
    ),
    "monthly_mean": Query(
        lambda s, d: rounded(profiles.mean_by_month(selected(s, d))),
        sql("""select cast(month(timestamp) as integer) as month,
          round(avg(meter_reading), 6) as mean_load from sel group by 1""", "sel"),
    ),
    "top_buildings": Query(
        lambda s, d: rounded(profiles.top_buildings(selected(s, d))),
        sql("""select building_id, 'B' || building_id as label, round(mean_load, 6) as mean_load
          from means order by means.mean_load desc, building_id limit 12""", "means"),
    ),
    "scaler_fit": Query(
        lambda s, d: rounded(scores.scaler(
            add_time_features(selected(s, d)), ["meter_reading", "hour", "day_of_week"])),
        sql("""select 'meter_reading' as feature, round(avg(meter_reading), 6) as mean,
            round(stddev_pop(meter_reading), 6) as std from sel
          union all select 'hour', round(avg(hour(timestamp)), 6),
            round(stddev_pop(hour(timestamp)), 6) from sel
          union all select 'day_of_week', round(avg(isodow(timestamp) - 1), 6),
            round(stddev_pop(isodow(timestamp) - 1), 6) from sel""", "sel"),
    ),
    "standardised_readings": Query(
        _scaled,
        sql("""select building_id, timestamp, meter_reading,
          cast(hour(timestamp) as integer) as hour,
          round((meter_reading - avg(meter_reading) over ()) / stddev_pop(meter_reading) over (), 6)
            + 0.0 as meter_reading_scaled,
          round((hour(timestamp) - avg(hour(timestamp)) over ())
            / stddev_pop(hour(timestamp)) over (), 6) + 0.0 as hour_scaled from sel""", "sel"),
    ),
    # The plans for large tables, forced on the same rows.
    "building_fill_spread": Query(
        lambda s, d: rounded(filled_buildings(tables.buildings(s, d), small_bytes=0)),
        sql("""select building_id, site_id, primary_use, round(square_feet, 6) as square_feet,
          year_built, floor_count from lodging""", "lodging"),
    ),
    "weather_fill_spread": Query(
        lambda s, d: rounded(fill_weather(tables.weather(s, d), small_bytes=0)),
        sql("select site_id, timestamp, " + ", ".join(
            f"round({c}, 6) as {c}" for c in WEATHER_FEATURES) + " from filled_weather",
            "filled_weather"),
    ),
    "enriched_readings_spread": Query(
        lambda s, d: rounded(enrich(
            filters.positive(filters.target_meter(tables.readings(s, d))).drop("meter"),
            filled_buildings(tables.buildings(s, d), small_bytes=0),
            fill_weather(tables.weather(s, d), small_bytes=0), small_bytes=0,
        )),
        sql("""select e.building_id, e.timestamp, e.meter_reading, l.site_id,
          round(coalesce(l.square_feet, median(l.square_feet) over ()), 6) as square_feet,
          coalesce(l.year_built, median(l.year_built) over ()) as year_built,
          coalesce(l.floor_count, median(l.floor_count) over ()) as floor_count, """
            + ", ".join(f"round(coalesce(w.{c}, 0), 6) as {c}" for c in WEATHER_FEATURES) + """
          from elec e left join lodging l on e.building_id = l.building_id
          left join filled_weather w on l.site_id = w.site_id and e.timestamp = w.timestamp""",
            "elec", "lodging", "filled_weather"),
    ),
    "lag_features_split": Query(
        lambda s, d: add_history_features(
            selected(s, d), rolling=[], split_above=40, small_bytes=0),
        sql(f"select building_id, timestamp, meter_reading, {_lag_sql(LAGS)} from sel", "sel"),
    ),
    "rolling_features_split": Query(
        lambda s, d: rounded(add_history_features(
            selected(s, d), lags=[], split_above=40, small_bytes=0), 8),
        sql(f"select building_id, timestamp, meter_reading, {_rolling_sql(ROLLING)} from sel",
            "sel"),
    ),
    "chronological_split_spread": Query(
        lambda s, d: chronological_split(selected(s, d), small_bytes=0),
        sql("select building_id, timestamp, meter_reading, is_val from split", "split"),
    ),
    "contiguous_folds_spread": Query(
        lambda s, d: contiguous_folds(selected(s, d), small_bytes=0),
        sql("""select building_id, timestamp, meter_reading,
            cast(case when rn <= (size + 1) * extra then (rn - 1) // (size + 1)
              else extra + (rn - 1 - (size + 1) * extra) // size end as integer) as fold
          from (select *, row_number() over (order by timestamp, building_id) as rn,
            count(*) over () // 5 as size, count(*) over () % 5 as extra from sel) x""", "sel"),
    ),
    "hourly_regularise_spread": Query(
        lambda s, d: rounded(hourly_grid(selected(s, d), small_bytes=0)),
        sql(HOURLY_SQL, "sel"),
    ),
    "savings_calculator": Query(
        _calculator,
        sql(f"""select building_id, {_rational(1, 1, 'daily_kwh')},
          {_rational(20, 100, 'saved_kwh')}, {_rational(20 * 82, 100 * 100, 'co2_kg')},
          {_rational(20 * 8 * 30, 100, 'monthly_cost_saved')},
          {_rational(20 * 82 * 365, 100 * 100 * 1000, 'annual_co2_tonnes')}
          from (select building_id, sum(cast(round(meter_reading * 1000000) as hugeint)) as t,
              count(distinct cast(timestamp as date))::hugeint as n from sel group by 1) y""", "sel"),
    ),
    "feature_split": Query(
        lambda s, d: run_pipeline(
            tables.readings(s, d), tables.buildings(s, d), tables.weather(s, d)
        ).groupBy("is_val").agg(
            F.count("*").alias("n"), F.round(F.sum("rolling_mean_24h"), 2).alias("sum_rolling"),
            F.round(F.sum("air_temperature"), 2).alias("sum_temperature"),
        ),
        sql("""select s.is_val, count(*) as n, round(sum(r), 2) as sum_rolling,
          round(sum(l.air_temperature), 2) as sum_temperature
          from (select *, avg(meter_reading) over (partition by building_id order by timestamp
             rows between 23 preceding and current row) as r from split) s
          join located l on s.building_id = l.building_id and s.timestamp = l.timestamp
          group by s.is_val""", "split", "located"),
    ),
}
