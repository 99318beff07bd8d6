"""Queries on load plans, for the fleet and for every building at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterlens.catalog.base import Query, located, lodging_rooms, rounded, selected, sql
from meterlens.config import APPLIANCES
from meterlens.operators.profiles import building_means, hourly_profile, peak_stats
from meterlens.plans import load
from meterlens.sources import tables

B = ["building_id"]


def _by(keys: str) -> tuple[str, str, str]:
    """(select prefix, partition clause, group clause) for the grouping keys."""
    return (f"{keys}, ", f"partition by {keys}", f"group by {keys}") if keys else ("", "", "")


def _shaved(view: str, keys: str) -> str:
    k, part, _ = _by(keys)
    limit = (
        f"(select {keys} as g, quantile_cont(load, 0.9) as thr from {view} group by 1) q"
        f" on q.g = {view}.{keys}" if keys
        else f"(select quantile_cont(load, 0.9) as thr from {view}) q on true"
    )
    return f"""select {k}hour, load, thr, is_peak,
        case when is_peak = 1 then load * (1 - 0.25::double)
             else load + sum(case when is_peak = 1 then load * 0.25::double end) over ({part})
                         / sum(1 - is_peak) over ({part}) end as shaved_load
      from (select {view}.*, thr, cast(case when load >= thr then 1 else 0 end as integer)
              as is_peak from {view} join {limit}) s"""


def _shaving_summary(view: str, keys: str) -> str:
    k, _, group = _by(keys)
    rate = "case when hour >= 9 and hour < 21 then 8.0::double else 4.5::double end"
    return f"""select {k}max(load) as peak_before_kw, max(shaved_load) as peak_after_kw,
        (max(load) - max(shaved_load)) / max(load) * 100 as peak_reduction_pct,
        avg(load) / (max(load) + 1e-8) as load_factor_before,
        avg(shaved_load) / (max(shaved_load) + 1e-8) as load_factor_after,
        sum(load * {rate}) - sum(shaved_load * {rate}) as cost_savings_daily
      from ({_shaved(view, keys)}) v {group}"""


def _netload(keys: str, cloud: bool = True) -> str:
    """Solar output and net load over 24 hours per group of ``located``."""
    k, _, _ = _by(keys)
    groups = f"(select distinct {keys} from located) g cross join" if keys else ""
    match = f"and p.{keys} = g.{keys}" if keys else ""
    sky = "greatest(0.2::double, 1 - p.cloud / 10)" if cloud else "0.85::double"
    head = f"g.{keys}, " if keys else ""
    return f"""select *, greatest(0, coalesce(load, 0) - solar_kw) as net_load from (
      select {head}cast(h.hour as integer) as hour, p.load,
        100 * 0.18::double * (case when h.hour between 10 and 15
          then exp(-((h.hour - 12.5::double) * (h.hour - 12.5::double)) / 12.5::double)
          else 0::double end) * {sky} as solar_kw
      from {groups} (select unnest(range(0, 24)) as hour) h
      left join (select {k}hour(timestamp) as hour, avg(meter_reading) as load,
                   avg(cloud_coverage) as cloud from located group by all) p
        on p.hour = h.hour {match}) z"""


def _solar_summary(keys: str) -> str:
    k, _, group = _by(keys)
    return f"""select {k}sum(solar_kw) as total_solar_kwh,
        (coalesce(sum(load), 0) - sum(net_load)) / (coalesce(sum(load), 0) + 1e-8) * 100
          as solar_savings_pct,
        sum(solar_kw) * 4.5::double as solar_cost_savings_daily,
        sum(solar_kw) * 0.82::double as carbon_reduced_kg
      from ({_netload(keys)}) n {group}"""


ROOMS_SQL = "(select building_id, 50 + (building_id * 7) % 200 as rooms from lodging)"
CATALOGUE_SQL = " union all ".join(
    f"select '{n}' as appliance, {kw}::double as kw, {a} as a, {b} as b, {p}::double as p"
    for n, kw, a, b, p in APPLIANCES
)
STAGGER_SQL = f"""
    select building_id, hour, sum(o) as original_load, sum(s) as staggered_load from (
      select building_id, (a + k) % 24 as hour, users * kw / len as o, 0::double as s from runs
      union all
      select building_id, (a + k + g * greatest(1, len // 3)) % 24,
             0::double, floor(users / 3) * kw / len
      from runs cross join (select unnest(range(0, 3)) as g) gg
      union all select building_id, h, 0::double, 0::double
      from {ROOMS_SQL} r cross join (select unnest(range(0, 24)) as h) hh) u
    group by building_id, hour"""
RUNS_SQL = f"""
    runs as (select building_id, a, kw, len, floor(rooms * p) as users,
               unnest(range(0, len)) as k
             from (select *, case when a < b then b - a else 24 - a + b end as len
                   from {ROOMS_SQL} r cross join ({CATALOGUE_SQL}) c) x)"""
STAGGER_SUMMARY_SQL = f"""
    select building_id, max(original_load) as stagger_peak_before_kw,
      max(staggered_load) as stagger_peak_after_kw,
      (max(original_load) - max(staggered_load)) / max(original_load) * 100
        as stagger_reduction_pct,
      avg(original_load) / (max(original_load) + 1e-8) as stagger_factor_before,
      avg(staggered_load) / (max(staggered_load) + 1e-8) as stagger_factor_after
    from ({STAGGER_SQL}) s group by building_id"""


def _round_sql(body: str, plain: str, values: list[str], places: int = 6) -> str:
    columns = ", ".join(f"round({v}, {places}) + 0.0 as {v}" for v in values)
    return f"select {plain}{columns} from ({body}) final"


SHAVED = ["load", "shaved_load"]
SUMMARY = ["peak_before_kw", "peak_after_kw", "peak_reduction_pct", "load_factor_before",
           "load_factor_after", "cost_savings_daily"]
NET = ["load", "solar_kw", "net_load"]
SOLAR = ["total_solar_kwh", "solar_savings_pct", "solar_cost_savings_daily", "carbon_reduced_kg"]
STAGGER = ["stagger_peak_before_kw", "stagger_peak_after_kw", "stagger_reduction_pct",
           "stagger_factor_before", "stagger_factor_after"]
PLAN = ["total_daily_savings", "total_peak_reduction_pct", "carbon_reduced_kg"]

TIMESHIFT_SQL = """
    select {k}hour, load,
      case when hour between 10 and 15 then load + sum(moved) over ({part}) / 6
           else load - moved end as optimized_load,
      sum(moved) over ({part}) as total_shifted_kwh
    from (select *, case when hour between 10 and 15 then 0
                    else greatest(load - avg(load) over ({part}), 0) * 0.3::double end as moved
          from {view}) m"""


def _profile(s, d, by=()):
    return hourly_profile(selected(s, d), by)


def _cloudy(s, d, by=()):
    return hourly_profile(located(s, d), by, cloud="cloud_coverage")


def _summaries(s, d, by=()):
    shaving = load.peak_shaving_summary(load.peak_shaving(_profile(s, d, by), by), by)
    solar = load.solar_summary(load.solar_netload(_cloudy(s, d, by), by), by)
    return shaving, solar


def _fleet_rooms(s, d):
    """All lodging rooms as one campus."""
    return lodging_rooms(s, d).agg(F.sum("rooms").alias("rooms"))


def _plan_b(s, d):
    shaving, solar = _summaries(s, d, B)
    return load.combined_plan(shaving, solar, load.stagger_summary(lodging_rooms(s, d), B), B)


PLAN_B_SQL = f"""
    select a.building_id, a.cost_savings_daily + b.solar_cost_savings_daily as total_daily_savings,
      (a.peak_reduction_pct + c.stagger_reduction_pct) / 2 as total_peak_reduction_pct,
      b.carbon_reduced_kg
    from ({_shaving_summary('profile_b', 'building_id')}) a
    join ({_solar_summary('building_id')}) b on a.building_id = b.building_id
    join ({STAGGER_SUMMARY_SQL}) c on a.building_id = c.building_id"""


def _stats_sql(view: str, keys: str) -> str:
    k, _, group = _by(keys)
    return f"""select {k}max(load) as peak_load_kw, avg(load) as avg_load_kw,
        min(load) as min_load_kw, max(load) / (avg(load) + 1e-8) as peak_to_avg_ratio,
        avg(load) / (max(load) + 1e-8) as load_factor, sum(load) as total_energy_kwh
      from {view} {group}"""


STATS = ["peak_load_kw", "avg_load_kw", "min_load_kw", "peak_to_avg_ratio", "load_factor",
         "total_energy_kwh"]


def _site_means(s, d):
    return building_means(located(s, d), ["site_id"])


SITE_MEANS_SQL = """(select site_id, building_id, avg(meter_reading) as mean_load
    from located group by 1, 2) m"""

PLANNING = {
    "peak_stats": Query(
        lambda s, d: rounded(peak_stats(_profile(s, d))),
        sql(_round_sql(_stats_sql("profile", ""), "", STATS), "profile"),
    ),
    "peak_stats_by_building": Query(
        lambda s, d: rounded(peak_stats(_profile(s, d, B), B)),
        sql(_round_sql(_stats_sql("profile_b", "building_id"), "building_id, ", STATS),
            "profile_b"),
    ),
    "hour_classes": Query(
        lambda s, d: rounded(load.classify_hours(_profile(s, d))),
        sql(f"""select hour, round(load, 6) as load, round(thr, 6) as threshold, is_peak
          from ({_shaved('profile', '')}) x""", "profile"),
    ),
    "above_mean_hours": Query(
        lambda s, d: rounded(load.above_mean_hours(_profile(s, d, B), B)),
        sql("""select building_id, hour, round(load, 6) as load, cast(case when load
            > avg(load) over (partition by building_id) then 1 else 0 end as integer)
            as above_mean from profile_b""", "profile_b"),
    ),
    "energy_cost": Query(
        lambda s, d: rounded(_profile(s, d, B).groupBy("building_id").agg(
            load.energy_cost("load").alias("daily_cost"))),
        sql("""select building_id, round(sum(load * case when hour >= 9 and hour < 21
          then 8.0::double else 4.5::double end), 6) as daily_cost
          from profile_b group by 1""", "profile_b"),
    ),
    "peak_shaving": Query(
        lambda s, d: rounded(load.peak_shaving(_profile(s, d))),
        sql(_round_sql(_shaved("profile", ""), "hour, is_peak, ", SHAVED), "profile"),
    ),
    "peak_shaving_by_building": Query(
        lambda s, d: rounded(load.peak_shaving(_profile(s, d, B), B)),
        sql(_round_sql(_shaved("profile_b", "building_id"), "building_id, hour, is_peak, ",
                       SHAVED), "profile_b"),
    ),
    "peak_shaving_summary": Query(
        lambda s, d: rounded(load.peak_shaving_summary(load.peak_shaving(_profile(s, d)))),
        sql(_round_sql(_shaving_summary("profile", ""), "", SUMMARY), "profile"),
    ),
    "peak_shaving_summary_by_building": Query(
        lambda s, d: rounded(load.peak_shaving_summary(
            load.peak_shaving(_profile(s, d, B), B), B), 8),
        sql(_round_sql(_shaving_summary("profile_b", "building_id"), "building_id, ", SUMMARY, 8),
            "profile_b"),
    ),
    "solar_netload": Query(
        lambda s, d: rounded(load.solar_netload(_cloudy(s, d))),
        sql(_round_sql(_netload(""), "hour, ", NET), "located"),
    ),
    "solar_netload_by_site": Query(
        lambda s, d: rounded(load.solar_netload(_cloudy(s, d, ["site_id"]), ["site_id"])),
        sql(_round_sql(_netload("site_id"), "site_id, hour, ", NET), "located"),
    ),
    "solar_netload_clear_sky": Query(
        lambda s, d: rounded(load.solar_netload(_profile(s, d, B), B)),
        sql(_round_sql(_netload("building_id", cloud=False), "building_id, hour, ", NET),
            "located"),
    ),
    "solar_summary": Query(
        lambda s, d: rounded(load.solar_summary(load.solar_netload(_cloudy(s, d)))),
        sql(_round_sql(_solar_summary(""), "", SOLAR), "located"),
    ),
    "solar_summary_by_building": Query(
        lambda s, d: rounded(load.solar_summary(load.solar_netload(_cloudy(s, d, B), B), B)),
        sql(_round_sql(_solar_summary("building_id"), "building_id, ", SOLAR), "located"),
    ),
    "cloud_by_hour": Query(
        lambda s, d: rounded(_cloudy(s, d)),
        sql("""select cast(hour(timestamp) as integer) as hour,
          round(avg(meter_reading), 6) as load, round(avg(cloud_coverage), 6) as cloud
          from located group by 1""", "located"),
    ),
    "stagger_profile": Query(
        lambda s, d: rounded(load.stagger_profile(lodging_rooms(s, d), B)),
        sql(f"""with {RUNS_SQL.strip()} {_round_sql(STAGGER_SQL,
            'building_id, cast(hour as integer) as hour, ', ['original_load', 'staggered_load'])}""",
            "lodging"),
    ),
    "stagger_summary": Query(
        lambda s, d: rounded(load.stagger_summary(lodging_rooms(s, d), B)),
        sql(f"""with {RUNS_SQL.strip()}
            {_round_sql(STAGGER_SUMMARY_SQL, 'building_id, ', STAGGER)}""", "lodging"),
    ),
    "strategy_a": Query(
        lambda s, d: rounded(load.solar_timeshift(_profile(s, d))),
        sql(_round_sql(TIMESHIFT_SQL.format(k="", part="", view="profile"), "hour, ",
                       ["load", "optimized_load", "total_shifted_kwh"]), "profile"),
    ),
    "strategy_a_by_building": Query(
        lambda s, d: rounded(load.solar_timeshift(_profile(s, d, B), B), 8),
        sql(_round_sql(TIMESHIFT_SQL.format(
            k="building_id, ", part="partition by building_id", view="profile_b"),
            "building_id, hour, ", ["load", "optimized_load", "total_shifted_kwh"], 8), "profile_b"),
    ),
    "strategy_b": Query(
        lambda s, d: rounded(load.building_balance(building_means(selected(s, d)))),
        sql("""select building_id, round(mean_load, 6) as mean_load,
          round(avg(mean_load) over (), 6) as balanced_load from means""", "means"),
    ),
    "strategy_b_by_site": Query(
        lambda s, d: rounded(load.building_balance(_site_means(s, d), ["site_id"])),
        sql(f"""select site_id, building_id, round(mean_load, 6) as mean_load,
          round(avg(mean_load) over (partition by site_id), 6) as balanced_load
          from {SITE_MEANS_SQL}""", "located"),
    ),
    "strategy_b_summary_by_site": Query(
        lambda s, d: rounded(load.balance_summary(_site_means(s, d), ["site_id"])),
        sql(f"""select site_id, count(*) as n_buildings,
          round(stddev_samp(mean_load) / (avg(mean_load) + 1e-8), 6) as imbalance_before,
          0::double as imbalance_after from {SITE_MEANS_SQL} group by site_id""", "located"),
    ),
    "strategy_c": Query(
        lambda s, d: rounded(load.combined_plan(
            *_summaries(s, d), load.stagger_summary(_fleet_rooms(s, d)))),
        sql(f"""with {RUNS_SQL.replace(ROOMS_SQL,
                f'(select 0 as building_id, sum(rooms) as rooms from {ROOMS_SQL} rr)').strip()}
            {_round_sql(f'''select a.cost_savings_daily + b.solar_cost_savings_daily
                as total_daily_savings,
              (a.peak_reduction_pct + c.stagger_reduction_pct) / 2 as total_peak_reduction_pct,
              b.carbon_reduced_kg
            from ({_shaving_summary('profile', '')}) a, ({_solar_summary('')}) b,
              ({STAGGER_SUMMARY_SQL.replace(ROOMS_SQL, '(select 0 as building_id)')}) c''',
              '', PLAN)}""", "profile", "located"),
    ),
    "strategy_c_by_building": Query(
        lambda s, d: rounded(_plan_b(s, d)),
        sql(f"with {RUNS_SQL.strip()} {_round_sql(PLAN_B_SQL, 'building_id, ', PLAN)}",
            "profile_b", "located"),
    ),
    "savings_projection": Query(
        lambda s, d: rounded(load.savings_projection(_plan_b(s, d)), 4),
        sql(f"with {RUNS_SQL.strip()}" + _round_sql(f"""select *,
            total_daily_savings * 30 as monthly_savings, total_daily_savings * 365
            as annual_savings from ({PLAN_B_SQL}) p""", " building_id, ",
            [*PLAN, "monthly_savings", "annual_savings"], 4), "profile_b", "located"),
    ),
}
