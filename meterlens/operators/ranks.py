"""Exact order statistics and chronological cuts without a global sort."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlens.functions.scalars import total
from meterlens.session import SMALL_BYTES, bounded_broadcast, is_small, settle

# Bits that one round of a quantile search tells apart.
DIGIT = 16
# Ranges that the ids of a crowded hour are ranked in.
ID_RANGES = 200
_MAGNITUDE = (1 << 63) - 1
_BOX = "java.lang.Double"


def exact_quantiles(
    df: DataFrame, columns: list[str], q: float, small_bytes: int = SMALL_BYTES
) -> Column:
    """Exact linearly interpolated quantiles, as one scalar struct of columns.

    A small table uses ``percentile``, which keeps every distinct value in one
    buffer; it saves four jobs. A large one goes through ``grouped_quantiles``.
    NULLs are skipped, NaN is above all other values.
    """
    if is_small(df, small_bytes):
        return df.agg(
            F.struct(*[F.percentile(c, F.lit(q)).alias(c) for c in columns]).alias("q")
        ).scalar()
    found = grouped_quantiles(df, [], columns, q).first()
    return F.struct(*[F.lit(found[c]).cast("double").alias(c) for c in columns])


def _image(value: Column) -> Column:
    """The 64 bits of a double as a long of the same order; NaN comes last, -0.0 is 0.0."""
    plain = F.coalesce(value.cast("double"), F.lit(0.0)) + F.lit(0.0)  # the method takes no NULL
    bits = F.java_method(F.lit(_BOX), F.lit("doubleToLongBits"), plain).cast("long")
    return F.when(value.isNotNull(), F.when(bits < 0, bits.bitwiseXOR(F.lit(_MAGNITUDE))).otherwise(bits))


def _value(image: Column) -> Column:
    bits = F.when(image < 0, image.bitwiseXOR(F.lit(_MAGNITUDE))).otherwise(image)
    return F.java_method(F.lit(_BOX), F.lit("longBitsToDouble"), bits).cast("double")


def _joined(rows: DataFrame, other: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join on columns of which the keys may be NULL; ``other`` is small beside ``rows``."""
    named = other.select(*[F.col(c).alias(f"_of_{c}" if c in on else c) for c in other.columns])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in on])
    joined = rows.join(bounded_broadcast(named), same, how)
    return joined.drop(*[f"_of_{c}" for c in on])


def grouped_quantiles(df: DataFrame, keys: list[str], columns: list[str], q: float) -> DataFrame:
    """(keys, columns): exact linearly interpolated quantiles per group, by radix selection.

    All columns and groups take part in each of four rounds. A round counts values by the
    next 16 bits of their image and goes on with those that share the bits of the wanted
    rank, so no task ranks a group, and counts are added up before they travel. Without
    keys there is one row. A column without values gives NULL.
    """
    each = F.array(*[F.struct(F.lit(k).alias("_column"), _image(F.col(c)).alias("_image"))
                     for k, c in enumerate(columns)])
    values = settle(
        df.select(*keys, F.explode(each).alias("_v")).select(*keys, "_v.*").filter("_image is not null")
    )
    on = [*keys, "_column"]
    place = (F.col("_n") - 1) * F.lit(float(q))
    wanted = values.groupBy(*on).agg(F.count("*").alias("_n")).withColumn("_place", place).select(
        *on, "_place",
        F.explode(F.array(F.floor("_place"), F.ceil("_place"))).alias("_rank"),
    ).distinct().withColumn("_first", F.col("_rank"))
    wanted = settle(wanted.select(*on, "_place", "_first", "_rank", F.lit(None).cast("long").alias("_prefix")))
    for shift in range(64 - DIGIT, -1, -DIGIT):
        last = shift == 64 - DIGIT
        prefix = F.lit(None).cast("long") if last else F.shiftright("_image", shift + DIGIT)
        rows = values.select(*on, prefix.alias("_prefix"), F.shiftright("_image", shift).alias("_next"))
        if not last:
            rows = _joined(rows, wanted.select(*on, "_prefix").distinct(), [*on, "_prefix"], "inner")
        counted = rows.groupBy(*on, "_prefix", "_next").agg(F.count("*").alias("_n"))
        upto = F.sum("_n").over(Window.partitionBy(*on, "_prefix").orderBy("_next"))
        begun = counted.select(*on, "_prefix", "_next", (upto - F.col("_n")).alias("_begin"), upto.alias("_end"))
        wanted = settle(
            _joined(begun, wanted, [*on, "_prefix"], "inner")
            .filter((F.col("_rank") >= F.col("_begin")) & (F.col("_rank") < F.col("_end")))
            .select(*on, "_place", "_first", (F.col("_rank") - F.col("_begin")).alias("_rank"),
                    F.col("_next").alias("_prefix"))
        )
    ends = wanted.select(*on, "_place", F.struct("_first", _value(F.col("_prefix")).alias("x")).alias("_end")) \
        .groupBy(*on, "_place").agg(F.min("_end").alias("_low"), F.max("_end").alias("_high"))
    low, high, share = F.col("_low.x"), F.col("_high.x"), F.col("_place")
    between = F.when(low == high, low).otherwise(
        (F.col("_high._first") - share) * low + (share - F.col("_low._first")) * high
    )
    found = ends.select(*on, between.alias("_q")).groupBy(*keys).agg(*[
        F.max(F.when(F.col("_column") == k, F.col("_q"))).alias(c) for k, c in enumerate(columns)
    ])
    if not keys:
        return found
    return _joined(df.select(*keys).distinct(), found, list(keys), "left").select(*keys, *columns)


def exact_medians(df: DataFrame, columns: list[str], **sizing) -> Column:
    return exact_quantiles(df, columns, 0.5, **sizing)


def _ranked_ids(at: DataFrame, ts: str, key: str, small_bytes: int) -> DataFrame:
    """Position ``_pos`` of every row of the boundary hours within its hour.

    Large hours are ranked in ranges of ids, one task per range, cut by Spark's own
    sample of the keys, whatever their type.
    """
    if is_small(at, small_bytes):
        return at.withColumn("_pos", F.row_number().over(Window.partitionBy(ts).orderBy(key)))
    binned = settle(
        at.repartitionByRange(ID_RANGES, ts, key).withColumn("_bin", F.spark_partition_id())
    )
    sizes = binned.groupBy(ts, "_bin").count()
    starts = sizes.withColumn(
        "_start",
        F.sum("count").over(Window.partitionBy(ts).orderBy("_bin")) - F.col("count"),
    ).drop("count")
    inside = F.row_number().over(Window.partitionBy(ts, "_bin").orderBy(key))
    named = starts.toDF("_at", "_of", "_start")
    same = F.col(ts).eqNullSafe(F.col("_at")) & (F.col("_bin") == F.col("_of"))
    return binned.join(F.broadcast(named), same).withColumn("_pos", inside + F.col("_start")) \
        .drop("_at", "_of")


def chronological_cuts(
    df: DataFrame,
    positions: Callable[[Column], Column],
    ts: str = "timestamp",
    key: str = "building_id",
    small_bytes: int = SMALL_BYTES,
) -> list[tuple[str, int]]:
    """The (ts, key) of the rows at given positions of a table ordered by both.

    ``positions(n)`` maps the row count to an array column of row numbers.
    (key, ts) must be unique; rows with a NULL time come last. Three jobs fetch
    a handful of boundary values: the first sums counts per day in order, the
    second counts per time within the boundary days, the third reads only the
    boundary times, by a filter that reaches the scan, and ranks their rows.
    """
    day = F.date_trunc("day", F.col(ts))
    everything = Window.orderBy("day").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    days = (
        df.groupBy(day.alias("day"))
        .agg(F.count("*").alias("n"))
        .withColumn("upto", F.sum("n").over(Window.orderBy(F.col("day").asc_nulls_last())))
        .withColumn("rows", F.sum("n").over(everything))
        .withColumn("cut", F.explode(positions(F.col("rows"))))
        .filter((F.col("upto") >= F.col("cut")) & (F.col("upto") - F.col("n") < F.col("cut")))
        .select(F.col("day").cast("string").alias("day"), (F.col("cut") - F.col("upto") + F.col("n")).alias("rank"))
        .distinct()
        .collect()  # one row per cut
    )
    if not days:
        return []
    of_day = F.col("day").cast("string")
    within = reduce(lambda a, b: a | b, [
        of_day.eqNullSafe(F.lit(r["day"])) & (F.col("cut") == r["rank"]) for r in days
    ])
    boundary = (
        df.filter(_one_of(day.cast("string"), [r["day"] for r in days]))
        .groupBy(day.alias("day"), ts)
        .agg(F.count("*").alias("n"))
        .withColumn("upto", F.sum("n").over(Window.partitionBy("day").orderBy(ts)))
        .withColumn("cut", F.explode(F.array(*[F.lit(r["rank"]) for r in days])))
        .filter(within)
        .filter((F.col("upto") >= F.col("cut")) & (F.col("upto") - F.col("n") < F.col("cut")))
        .select(F.col(ts).cast("string").alias("at"), (F.col("cut") - F.col("upto") + F.col("n")).alias("rank"))
        .distinct()
        .collect()  # one row per cut
    )
    kind = df.schema[ts].dataType
    hours = {row["at"] for row in boundary}
    at = df.select(ts, key).filter(
        _one_of(F.col(ts), [h and F.lit(h).cast(kind) for h in hours])
    )
    if not is_small(at, small_bytes):
        at = settle(at)
    wanted = [
        F.col(ts).eqNullSafe(F.lit(row["at"]).cast(kind)) & (F.col("_pos") == row["rank"])
        for row in boundary
    ]
    found = (
        _ranked_ids(at, ts, key, small_bytes)
        .filter(reduce(lambda a, b: a | b, wanted))
        .select(F.col(ts).cast("string").alias("at"), F.col(key).alias("key"))
        .collect()  # one row per cut
    )
    return sorted(
        ((row["at"], row["key"]) for row in found),
        key=lambda cut: (cut[0] is None, cut[0] or "", cut[1] is not None, cut[1]),
    )


def _one_of(value: Column, wanted: list) -> Column:
    """Is the value among ``wanted``, of which one may be NULL?"""
    known = [w for w in wanted if w is not None]
    found = value.isin(*known) if known else F.lit(False)
    return (found | value.isNull()) if len(known) < len(wanted) else found


def _after(df: DataFrame, cut: tuple[str | None, int | None], ts: str, key: str) -> Column:
    """Does a row come after the cut row? NULL times come last, NULL keys first."""
    later = F.col(key).isNotNull() if cut[1] is None else F.coalesce(F.col(key) > cut[1], F.lit(False))
    if cut[0] is None:
        return F.col(ts).isNull() & later
    hour = F.lit(cut[0]).cast(df.schema[ts].dataType)
    return F.coalesce(F.col(ts) > hour, F.lit(True)) | (F.col(ts).eqNullSafe(hour) & later)


def chronological_split(
    df: DataFrame,
    ratio: float = 0.8,
    ts: str = "timestamp",
    key: str = "building_id",
    keys_from: DataFrame | None = None,
    **sizing,
) -> DataFrame:
    """Add ``is_val``: false for the first ``floor(ratio * n)`` rows in time.

    ``keys_from`` may name a cheaper table with the same (ts, key) rows, such
    as the readings a wide matrix was built from.
    """
    cuts = chronological_cuts(
        df if keys_from is None else keys_from,
        lambda n: F.array(F.floor(n * ratio).cast("long")), ts, key, **sizing,
    )
    # No boundary row means an empty training part.
    is_val = _after(df, cuts[0], ts, key) if cuts else F.lit(True)
    return df.select("*", is_val.alias("is_val"))


def contiguous_folds(
    df: DataFrame,
    folds: int = 5,
    ts: str = "timestamp",
    key: str = "building_id",
    **sizing,
) -> DataFrame:
    """Add ``fold``: ``folds`` unshuffled parts in time order, sizes within 1."""

    def last_rows(n: Column) -> Column:
        size, extra = F.floor(n / folds), n % folds
        return F.array(
            *[
                (size * i + F.least(F.lit(i), extra)).cast("long")
                for i in range(1, folds)
            ]
        )

    cuts = chronological_cuts(df, last_rows, ts, key, **sizing)
    passed = total([F.lit(0), *[_after(df, cut, ts, key).cast("int") for cut in cuts]])
    return df.select("*", passed.alias("fold"))
