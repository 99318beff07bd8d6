"""Load plans: peak shaving, solar, staggering and balancing.

Every plan takes an hourly profile (one row per group and hour of day, column
``load``) and ``by``, the grouping columns; ``by=[]`` plans the whole fleet.
A group has at most 24 rows, so windows over it are bounded.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlens.config import APPLIANCES, EPS, PlanParams
from meterlens.functions.scalars import cloud_factor, solar_factor, tariff, total
from meterlens.operators.profiles import building_means, hourly_profile, imbalance
from meterlens.session import bounded_broadcast, settle

DEFAULT = PlanParams()


def classify_hours(profile: DataFrame, by: list[str] = (), p: PlanParams = DEFAULT) -> DataFrame:
    """Add the peak threshold (a percentile of the hourly loads) and ``is_peak``."""
    whole = Window.partitionBy(*by)
    threshold = F.percentile("load", F.lit(p.peak_percentile / 100)).over(whole)
    return profile.withColumn("threshold", threshold).withColumn(
        "is_peak", (F.col("load") >= F.col("threshold")).cast("int")
    )


def above_mean_hours(profile: DataFrame, by: list[str] = ()) -> DataFrame:
    mean = F.avg("load").over(Window.partitionBy(*by))
    return profile.select("*", (F.col("load") > mean).cast("int").alias("above_mean"))


def peak_shaving(profile: DataFrame, by: list[str] = (), p: PlanParams = DEFAULT) -> DataFrame:
    """Move a share of every peak hour equally onto the other hours."""
    whole = Window.partitionBy(*by)
    peak = F.col("is_peak") == 1
    moved = F.sum(F.when(peak, F.col("load") * p.shift_share)).over(whole)
    others = F.sum((~peak).cast("int")).over(whole)
    return classify_hours(profile, by, p).select(
        *by,
        "hour",
        "load",
        "is_peak",
        F.when(peak, F.col("load") * (1 - p.shift_share))
        .otherwise(F.col("load") + moved / others)
        .alias("shaved_load"),
    )


def energy_cost(load: str, p: PlanParams = DEFAULT) -> Column:
    """Aggregate: cost of a day with the given hourly loads."""
    return F.sum(F.col(load) * tariff(F.col("hour"), p))


def peak_shaving_summary(
    shaved: DataFrame, by: list[str] = (), p: PlanParams = DEFAULT
) -> DataFrame:
    """Peak reduction (may be negative) and daily cost saving, with both peaks."""
    before, after = F.max("load"), F.max("shaved_load")
    return shaved.groupBy(*by).agg(
        before.alias("peak_before_kw"),
        after.alias("peak_after_kw"),
        ((before - after) / before * 100).alias("peak_reduction_pct"),
        (F.avg("load") / (before + EPS)).alias("load_factor_before"),
        (F.avg("shaved_load") / (after + EPS)).alias("load_factor_after"),
        (energy_cost("load", p) - energy_cost("shaved_load", p)).alias("cost_savings_daily"),
    )


def full_day(profile: DataFrame, by: list[str] = ()) -> DataFrame:
    """All 24 hours of every group; hours without readings have NULL values."""
    values = [c for c in profile.columns if c not in (*by, "hour")]
    days = profile.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct("hour", F.struct(*values)))).alias("_day")
    )
    hours = days.select(
        *by, "_day", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour")
    )
    return hours.select(*by, "hour", *[
        F.try_element_at("_day", F.col("hour"))[v].alias(v) for v in values
    ])


def solar_netload(profile: DataFrame, by: list[str] = (), p: PlanParams = DEFAULT) -> DataFrame:
    """Solar output and remaining grid load of every hour.

    A ``cloud`` column in the profile dims the panels; a missing hour counts as
    no load.
    """
    day = full_day(profile, by)
    cloud = F.col("cloud") if "cloud" in profile.columns else None
    solar = (
        F.lit(p.panel_kw * p.panel_efficiency) * solar_factor(F.col("hour"), p)
        * cloud_factor(cloud, p)
    )
    return day.withColumn("solar_kw", solar).select(
        *by,
        "hour",
        "load",
        "solar_kw",
        F.greatest(F.lit(0.0), F.coalesce("load", F.lit(0.0)) - F.col("solar_kw")).alias("net_load"),
    )


def solar_summary(netload: DataFrame, by: list[str] = (), p: PlanParams = DEFAULT) -> DataFrame:
    """Daily solar energy, savings and avoided CO2."""
    solar, original = F.sum("solar_kw"), F.coalesce(F.sum("load"), F.lit(0.0))
    return netload.groupBy(*by).agg(
        solar.alias("total_solar_kwh"),
        ((original - F.sum("net_load")) / (original + EPS) * 100).alias("solar_savings_pct"),
        (solar * p.rate_offpeak).alias("solar_cost_savings_daily"),
        (solar * p.carbon_factor).alias("carbon_reduced_kg"),
    )


def stagger_profile(
    rooms: DataFrame, by: list[str] = (), p: PlanParams = DEFAULT, appliances=APPLIANCES
) -> DataFrame:
    """Appliance load by hour with and without three shifted user groups.

    ``rooms`` has one row per group with its number of rooms. Users that do
    not fill a third of a group drop out of the shifted profile. How often an
    appliance runs in an hour depends on the catalogue alone, so both loads
    are weighted sums of user counts in generated code: no join, no shuffle.
    """
    usual_terms, spread_terms = [], []
    hour = F.col("hour")
    for _, power, start, end, share in appliances:
        length = end - start if start < end else 24 - start + end
        shift = max(1, length // p.stagger_groups)
        usual, spread = [0] * 24, [0] * 24
        for k in range(length):
            usual[(start + k) % 24] += 1
            for group in range(p.stagger_groups):
                spread[(start + k + group * shift) % 24] += 1
        users = F.floor(F.col("rooms") * F.lit(share))
        parts = F.floor(users / p.stagger_groups)
        usual_terms.append(users * power / length * F.get(F.expr(f"array{tuple(usual)}"), hour))
        spread_terms.append(parts * power / length * F.get(F.expr(f"array{tuple(spread)}"), hour))
    return rooms.select(
        *by, "rooms", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour")
    ).select(
        *by, "hour",
        total(usual_terms).alias("original_load"),
        total(spread_terms).alias("staggered_load"),
    )


def stagger_summary(
    rooms: DataFrame, by: list[str] = (), p: PlanParams = DEFAULT, appliances=APPLIANCES
) -> DataFrame:
    """Peak reduction and load factors; the 24 hours of a group merge map-side."""
    before, after = F.max("original_load"), F.max("staggered_load")
    return stagger_profile(rooms, by, p, appliances).groupBy(*by).agg(
        before.alias("stagger_peak_before_kw"),
        after.alias("stagger_peak_after_kw"),
        ((before - after) / before * 100).alias("stagger_reduction_pct"),
        (F.avg("original_load") / (before + EPS)).alias("stagger_factor_before"),
        (F.avg("staggered_load") / (after + EPS)).alias("stagger_factor_after"),
    )


def solar_timeshift(profile: DataFrame, by: list[str] = (), p: PlanParams = DEFAULT) -> DataFrame:
    """Strategy A: part of the above-mean excess moves into the sunny hours."""
    whole = Window.partitionBy(*by)
    sunny = F.col("hour").between(p.solar_first, p.solar_last)
    excess = F.greatest(F.col("load") - F.avg("load").over(whole), F.lit(0.0))
    moved = F.when(sunny, 0.0).otherwise(excess * p.timeshift_share)
    hours = p.solar_last - p.solar_first + 1
    shifted = F.sum("_moved").over(whole)
    return profile.withColumn("_moved", moved).select(
        *by,
        "hour",
        "load",
        F.when(sunny, F.col("load") + shifted / hours)
        .otherwise(F.col("load") - F.col("_moved"))
        .alias("optimized_load"),
        shifted.alias("total_shifted_kwh"),
    )


def building_balance(means: DataFrame, by: list[str] = ()) -> DataFrame:
    """Strategy B: every building gets the mean load of its group."""
    if not by:
        level = means.agg(F.avg("mean_load").alias("m")).scalar()
        return means.select("building_id", "mean_load", level.alias("balanced_load"))
    levels = means.groupBy(*by).agg(F.avg("mean_load").alias("balanced_load"))
    return means.join(bounded_broadcast(levels), list(by))


def balance_summary(means: DataFrame, by: list[str] = ()) -> DataFrame:
    """Imbalance before; after balancing it is 0 by construction."""
    return imbalance(means, by).select(
        *by, "n_buildings", F.col("imbalance").alias("imbalance_before"),
        F.lit(0.0).alias("imbalance_after"),
    )


def combined_plan(
    shaving: DataFrame, solar: DataFrame, stagger: DataFrame, by: list[str] = ()
) -> DataFrame:
    """Strategy C: savings of shaving and solar, mean of both peak reductions."""
    if by:
        rows = shaving.join(solar, list(by)).join(stagger, list(by))
    else:
        names = ["solar_cost_savings_daily", "carbon_reduced_kg"]
        sun = solar.select(F.struct(*names).alias("s")).scalar()
        cut = stagger.select("stagger_reduction_pct").scalar()
        rows = shaving.select(
            "*", *[sun[n].alias(n) for n in names], cut.alias("stagger_reduction_pct")
        )
    return rows.select(
        *by,
        (F.col("cost_savings_daily") + F.col("solar_cost_savings_daily")).alias(
            "total_daily_savings"
        ),
        ((F.col("peak_reduction_pct") + F.col("stagger_reduction_pct")) / 2).alias(
            "total_peak_reduction_pct"
        ),
        "carbon_reduced_kg",
    )


def savings_projection(plan: DataFrame, column: str = "total_daily_savings") -> DataFrame:
    """Daily saving scaled to a month of 30 and a year of 365 days."""
    return plan.select(
        "*",
        (F.col(column) * 30).alias("monthly_savings"),
        (F.col(column) * 365).alias("annual_savings"),
    )


def savings_calculator(daily: DataFrame, savings_pct: float = 20.0, p: PlanParams = DEFAULT) -> DataFrame:
    """Energy, CO2 and cost saved when a share of ``daily_kwh`` is avoided.

    Parameters enter as decimals, so a decimal ``daily_kwh`` gives exact results.
    """
    share, carbon, rate = (F.lit(Decimal(str(x))) for x in (savings_pct, p.carbon_factor, p.rate_peak))
    saved = F.col("daily_kwh") * share / 100
    return daily.select(
        "*",
        saved.alias("saved_kwh"),
        (saved * carbon).alias("co2_kg"),
        (saved * rate * 30).alias("monthly_cost_saved"),
        (saved * carbon * 365 / 1000).alias("annual_co2_tonnes"),
    )


def run_load_plans(
    df: DataFrame, rooms: DataFrame, by: list[str] = (), p: PlanParams = DEFAULT
) -> dict[str, DataFrame]:
    """All plans from one profile, which is computed and written once."""
    cloud = "cloud_coverage" if "cloud_coverage" in df.columns else None
    profile = settle(hourly_profile(df, by, cloud=cloud))
    means = building_means(df, by=[c for c in by if c != "building_id"])
    shaved = peak_shaving(profile, by, p)
    netload = solar_netload(profile, by, p)
    shaving, solar = peak_shaving_summary(shaved, by, p), solar_summary(netload, by, p)
    stagger = stagger_summary(rooms, by, p)
    level = [c for c in by if c != "building_id"]
    return {
        "peak_shaving": shaved,
        "peak_shaving_summary": shaving,
        "solar": netload,
        "solar_summary": solar,
        "staggering": stagger_profile(rooms, by, p),
        "stagger_summary": stagger,
        "strategy_a": solar_timeshift(profile, by, p),
        "strategy_b": building_balance(means, level),
        "strategy_c": combined_plan(shaving, solar, stagger, by),
    }
