"""Small column functions shared by operators and plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterlens.config import EPS, PlanParams


def total(columns: list[Column]) -> Column:
    """Sum of several columns of one row."""
    return reduce(lambda a, b: a + b, columns)


def out(value: Column, places: int = 6) -> Column:
    """Rounded output value, half away from zero, without negative zero."""
    return F.round(value, places) + F.lit(0.0)


def is_finite(name) -> Column:
    value = F.col(name) if isinstance(name, str) else name
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def clamp(value: Column) -> Column:
    """Negative forecasts become 0; NULL stays NULL."""
    return F.when(value.isNotNull(), F.greatest(value, F.lit(0.0)))


def corrected(base: Column, correction: Column) -> Column:
    """Base forecast plus residual correction (missing = 0), never negative."""
    return F.greatest(base + F.coalesce(correction, F.lit(0.0)), F.lit(0.0))


def standardise(value: Column, mean: Column, std: Column) -> Column:
    """Scale by population std; a constant column is only centred."""
    return (value - mean) / F.when(std == 0, 1.0).otherwise(std)


def unstandardise(value: Column, mean: Column, std: Column) -> Column:
    return value * F.when(std == 0, 1.0).otherwise(std) + mean


def zscore(value: Column, mean: Column, std: Column) -> Column:
    return (value - mean) / (std + EPS)


def deviation_pct(value: Column, mean: Column) -> Column:
    return (value - mean) / (mean + EPS) * 100


def hour_label(hour: Column) -> Column:
    return F.lpad(hour.cast("string"), 2, "0")


def building_label(building: Column) -> Column:
    return F.concat(F.lit("B"), building.cast("string"))


def tariff(hour: Column, p: PlanParams = PlanParams()) -> Column:
    """Cost of a kWh in the given hour of day."""
    peak = (hour >= p.rate_start) & (hour < p.rate_end)
    return F.when(peak, p.rate_peak).otherwise(p.rate_offpeak)


def solar_factor(hour: Column, p: PlanParams = PlanParams()) -> Column:
    """Bell curve around solar noon, 0 outside the sunny hours."""
    offset = hour - p.solar_noon
    bell = F.exp(-(offset * offset) / (2 * p.solar_sigma**2))
    return F.when(hour.between(p.solar_first, p.solar_last), bell).otherwise(0.0)


def cloud_factor(cloud: Column | None, p: PlanParams = PlanParams()) -> Column:
    """Share of light that passes an average cloud cover in tenths.

    Without a cloud column the sky counts as 85 % clear.
    """
    if cloud is None:
        return F.lit(p.clear_sky)
    return F.greatest(F.lit(p.cloud_floor), 1 - cloud / 10)


def rounded_metrics() -> dict[str, int]:
    """Decimal places of reported metrics."""
    return {"r2": 6, "rmse": 4, "mae": 4, "mape": 4}
