"""Load plans against published results of one campus (fixed values)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlens.config import PlanParams
from meterlens.operators.profiles import peak_stats
from meterlens.plans import load

LOAD = [
    274.0761886876155, 264.9280019230769, 255.95860684931506, 249.1821663091716,
    245.1876554609404, 241.93373163152052, 238.62210637037037, 232.71369030706623,
    231.8994472807991, 241.2351283918669, 249.30381368849427, 257.8978733456562,
    265.7236923475046, 271.50306068786983, 274.8971079881657, 278.30386746676515,
    281.207886316568, 283.12059549316587, 285.9054025773196, 291.69473799414345,
    290.8673242546927, 287.5535150533677, 283.2649371365477, 279.7496042357274,
]
SOLAR = {
    10: 7.4100409432328345, 11: 9.97914768067296, 12: 10.802695293586567,
    13: 11.078130005815, 14: 9.306714141081128, 15: 6.579558589260826,
}
MEANS = {
    6: 104.08009485851674, 12: 228.8978311954942, 27: 277.32957469946365, 33: 510.504040477071,
    34: 299.2210544109488, 35: 242.0910391826923, 36: 149.437027871278, 37: 207.94870778620307,
    49: 178.16532032550398, 56: 235.13262751988165, 57: 363.32806288145, 58: 383.28163917144445,
}


@pytest.fixture(scope="module")
def profile(spark):
    return spark.createDataFrame(list(enumerate(LOAD)), "hour int, load double")


@pytest.fixture(scope="module")
def cloudy(spark, profile):
    """The cloud cover that gives the published solar output."""
    p = PlanParams()
    data = []
    for h in range(24):
        bell = np.exp(-((h - 12.5) ** 2) / 12.5) * 18
        data.append((h, float(10 * (1 - SOLAR[h] / bell)) if h in SOLAR else 5.0))
    assert p.panel_kw * p.panel_efficiency == 18
    return profile.join(spark.createDataFrame(data, "hour int, cloud double"), "hour")


def test_peak_shaving(profile):
    shaved = load.peak_shaving(profile).orderBy("hour").collect()
    assert [r["hour"] for r in shaved if r["is_peak"]] == [19, 20, 21]
    assert shaved[0]["shaved_load"] == pytest.approx(284.4347074650227)
    assert shaved[19]["shaved_load"] == pytest.approx(218.7710534956076)
    assert sum(r["shaved_load"] for r in shaved) == pytest.approx(sum(LOAD))
    row = load.peak_shaving_summary(load.peak_shaving(profile)).first()
    assert row["peak_reduction_pct"] == pytest.approx(-1.5664263921946635)
    assert row["cost_savings_daily"] == pytest.approx(147.19364725847845)


def test_peak_stats(profile):
    row = peak_stats(profile).first()
    assert row["peak_to_avg_ratio"] == pytest.approx(1.101301070744414)
    assert row["load_factor"] == pytest.approx(0.9080169142594422)
    assert row["total_energy_kwh"] == pytest.approx(6356.7301417977305)


def test_solar(cloudy):
    net = load.solar_netload(cloudy)
    got = {r["hour"]: r for r in net.collect()}
    assert got[12]["net_load"] == pytest.approx(254.92099705391803)
    assert got[3]["net_load"] == pytest.approx(LOAD[3]) and len(got) == 24
    row = load.solar_summary(net).first()
    assert row["total_solar_kwh"] == pytest.approx(55.15628665364932)
    assert row["solar_savings_pct"] == pytest.approx(0.86768331238243)
    assert row["solar_cost_savings_daily"] == pytest.approx(248.20328994142193)
    assert row["carbon_reduced_kg"] == pytest.approx(45.22815505599244)


def test_missing_hours_and_clear_sky(profile):
    day = load.solar_netload(profile.filter("hour not in (3, 12)"))
    got = {r["hour"]: r for r in day.collect()}
    assert got[3]["load"] is None and got[3]["net_load"] == 0
    assert got[12]["solar_kw"] == pytest.approx(18 * 0.85 * np.exp(-0.25 / 12.5))


def test_staggering(spark):
    rooms = spark.createDataFrame([(200,)], "rooms int")
    got = load.stagger_profile(rooms).orderBy("hour").collect()
    original = [r["original_load"] for r in got]
    assert original[8] == pytest.approx(199.5) and original[0] == pytest.approx(1.309090909090909)
    assert original[12] == 0 and original[20] == pytest.approx(25.475757575757576)
    staggered = [r["staggered_load"] for r in got]
    assert staggered[7] == pytest.approx(138.07272727272726)
    assert staggered[23] == pytest.approx(17.822727272727278)
    # Users beyond a multiple of three are dropped: energy may only shrink.
    assert sum(original) * 0.95 <= sum(staggered) <= sum(original) + 1e-9
    row = load.stagger_summary(rooms).first()
    assert row["stagger_reduction_pct"] == pytest.approx(2.9710640236956074)
    assert row["stagger_factor_before"] == pytest.approx(0.19076858812744682)
    assert row["stagger_factor_after"] == pytest.approx(0.1944359648610398)


def test_strategy_a(profile):
    got = load.solar_timeshift(profile).orderBy("hour").collect()
    assert got[0]["optimized_load"] == pytest.approx(271.31245885380247)
    assert got[12]["optimized_load"] == pytest.approx(274.4102240769964)
    assert got[0]["total_shifted_kwh"] == pytest.approx(52.11919037695113)


def test_strategy_b(spark):
    means = spark.createDataFrame(list(MEANS.items()), "building_id long, mean_load double")
    assert {round(r["balanced_load"], 6) for r in load.building_balance(means).collect()} == {
        264.951418
    }
    row = load.balance_summary(means).first()
    assert row["imbalance_before"] == pytest.approx(0.42277358410512994)
    assert row["imbalance_after"] == 0


def test_strategy_c(spark, profile, cloudy):
    shaving = load.peak_shaving_summary(load.peak_shaving(profile))
    solar = load.solar_summary(load.solar_netload(cloudy))
    stagger = load.stagger_summary(spark.createDataFrame([(200,)], "rooms int"))
    row = load.savings_projection(load.combined_plan(shaving, solar, stagger)).first()
    assert row["total_daily_savings"] == pytest.approx(395.3969371999004)
    assert row["total_peak_reduction_pct"] == pytest.approx(0.702318815750472)
    assert row["monthly_savings"] == pytest.approx(395.3969371999004 * 30)


def test_grouped_plans_equal_single_plans(profile):
    two = profile.withColumn("building_id", F.lit(1)).unionByName(
        profile.select("hour", (F.col("load") * 2).alias("load"), F.lit(2).alias("building_id"))
    )
    grouped = load.peak_shaving_summary(
        load.peak_shaving(two, ["building_id"]), ["building_id"]
    ).orderBy("building_id").collect()
    assert grouped[0]["cost_savings_daily"] == pytest.approx(147.19364725847845)
    assert grouped[1]["cost_savings_daily"] == pytest.approx(2 * 147.19364725847845)


def test_run_all(spark, readings):
    rooms = readings.select("building_id").distinct().withColumn("rooms", F.lit(100))
    plans = load.run_load_plans(readings, rooms, ["building_id"])
    assert plans["strategy_c"].count() == 4
    assert set(plans) >= {"peak_shaving", "solar", "staggering", "strategy_a", "strategy_b"}


def test_savings_calculator(spark):
    row = load.savings_calculator(spark.createDataFrame([(1500.0,)], "daily_kwh double")).first()
    assert row["saved_kwh"] == 300 and row["co2_kg"] == pytest.approx(246)
    assert row["monthly_cost_saved"] == 72000
    assert row["annual_co2_tonnes"] == pytest.approx(89.79)
