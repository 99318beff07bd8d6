"""Missing values: medians, forward/backward fill, zeros, hourly grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlens.config import TARGET, WEATHER_FEATURES
from meterlens.operators.ranks import exact_medians
from meterlens.session import SMALL_BYTES, is_small


def fill_medians(
    df: DataFrame, columns: list[str], medians: Column | None = None, **sizing
) -> DataFrame:
    """NULLs become the exact median of the column over the rows of ``df``.

    ``medians`` may carry them ready-made, as a struct of the columns.
    """
    if medians is None:
        medians = exact_medians(df, columns, **sizing)
    return df.select("*", medians.alias("_medians")).select(
        *[
            F.coalesce(F.col(c), F.col(f"_medians.{c}")).alias(c) if c in columns else F.col(c)
            for c in df.columns
        ]
    )


def fill_zero(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.fillna(0.0, subset=[c for c in columns if c in df.columns])


def fill_zero_prefixed(df: DataFrame, prefixes: tuple[str, ...] = ("lag_", "rolling_")) -> DataFrame:
    return df.fillna(0.0, subset=[c for c in df.columns if c.startswith(prefixes)])


def fill_along_time(
    df: DataFrame,
    keys: list[str],
    columns: list[str],
    order: str = "timestamp",
    chunk: str = "month",
    small_bytes: int = SMALL_BYTES,
) -> DataFrame:
    """Forward fill, then backward fill, per group.

    Back filling only reaches rows before the first value, so it equals the
    first value of the group. Larger tables are filled in (group, month)
    chunks: the value carried into a chunk comes from a small table with the
    last value of every chunk, so a hot group is spread over many tasks. Rows
    with a NULL key are a group, rows with a NULL time come first in theirs.
    """
    if is_small(df, small_bytes):
        w = Window.partitionBy(*keys).orderBy(order)
        forward = w.rowsBetween(Window.unboundedPreceding, 0)
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return df.select(
            *[
                F.coalesce(
                    F.last(c, ignorenulls=True).over(forward),
                    F.first(c, ignorenulls=True).over(whole),
                ).alias(c)
                if c in columns
                else F.col(c)
                for c in df.columns
            ]
        )
    placed = df.withColumn("_chunk", F.date_trunc(chunk, F.col(order)))

    def known(c: str):
        return F.when(F.col(c).isNotNull(), F.struct(order))  # NULL times order first

    chunks = placed.groupBy(*keys, "_chunk").agg(
        *[F.max_by(c, known(c)).alias(f"_last_{c}") for c in columns],
        *[F.min_by(c, known(c)).alias(f"_first_{c}") for c in columns],
    )
    over = Window.partitionBy(*keys).orderBy("_chunk")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    whole = over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = chunks.select(
        *keys,
        "_chunk",
        *[
            F.coalesce(
                F.last(f"_last_{c}", ignorenulls=True).over(before),
                F.first(f"_first_{c}", ignorenulls=True).over(whole),
            ).alias(f"_carry_{c}")
            for c in columns
        ],
    )
    inside = (
        Window.partitionBy(*keys, "_chunk")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    named = carried.select(
        *[F.col(k).alias(f"_at_{k}") for k in (*keys, "_chunk")], *[f"_carry_{c}" for c in columns]
    )
    same = [F.col(k).eqNullSafe(F.col(f"_at_{k}")) for k in (*keys, "_chunk")]
    return placed.join(named, same, "left").select(
        *[
            F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(f"_carry_{c}")).alias(c)
            if c in columns
            else F.col(c)
            for c in df.columns
        ]
    )


def fill_weather(weather: DataFrame, key: str = "site_id", **sizing) -> DataFrame:
    """Fill every weather column along time per site, leftovers become 0."""
    present = [c for c in WEATHER_FEATURES if c in weather.columns]
    return fill_zero(fill_along_time(weather, [key], present, **sizing), present)


def hourly_runs(
    df: DataFrame,
    keys: list[str] = ("building_id",),
    target: str = TARGET,
    ts: str = "timestamp",
    **sizing,
) -> DataFrame:
    """One row per group and hour with a reading; it holds up to the hour ``_upto``.

    Readings of the same hour are averaged and gaps filled along time. The runs of a group
    follow one another without a gap from its first reading to its last.
    """
    keys = list(keys)
    hourly = df.groupBy(
        *keys, F.date_trunc("hour", F.col(ts)).cast("timestamp_ntz").alias(ts)
    ).agg(F.avg(target).alias(target)).filter(F.col(ts).isNotNull())
    filled = fill_along_time(hourly, keys, [target], ts, **sizing)
    upto = F.lead(ts).over(Window.partitionBy(*keys).orderBy(ts)) - F.expr("interval 1 hour")
    return filled.withColumn("_upto", F.coalesce(upto, F.col(ts)))


def hourly_grid(
    df: DataFrame,
    keys: list[str] = ("building_id",),
    target: str = TARGET,
    ts: str = "timestamp",
    **sizing,
) -> DataFrame:
    """One row per group and hour between its first and last reading.

    Readings of the same hour are averaged and gaps filled along time: every
    reading is repeated up to the next one, so no row holds more than one gap.
    A group has one row per hour of the calendar here, not per reading.
    """
    keys = list(keys)
    hours = F.sequence(F.col(ts), F.col("_upto"), F.expr("interval 1 hour"))
    return hourly_runs(df, keys, target, ts, **sizing).select(*keys, F.explode(hours).alias(ts), target)
