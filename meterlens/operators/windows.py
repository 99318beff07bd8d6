"""Row windows over time series: lags, rolling statistics and sequences.

A window over a whole building would put a hot building into one task. When
the table is not provably small, groups above ``split_above`` rows are cut into
consecutive chunks. Every chunk also receives (as non-home rows) at least the
``halo`` rows before it, so each home row sees the same frame as in the
unsplit window and results are exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from meterlens.config import LAGS, LOOKBACK, ROLLING, TARGET
from meterlens.functions.scalars import total
from meterlens.operators.fills import fill_zero_prefixed
from meterlens.session import SMALL_BYTES, bounded_broadcast, is_small

SPLIT_ABOVE = 250_000


def _chunk_plan(
    df: DataFrame, keys: list[str], bucket: Column, halo: int, split_above: int, small_bytes: int
) -> DataFrame | None:
    """(keys, bucket) -> home chunk and receiving chunks, for hot groups only.

    Buckets are days. A bucket belongs to the chunk in which its first row
    falls, counted in rows from the start of the group. It is also sent to the
    chunk that may start within the next ``halo`` rows; as chunks are longer
    than the halo, only the two chunks around its end can. The plan has one row
    per day of a hot group. Returns None when no group is hot.
    """
    if is_small(df, small_bytes):
        return None
    placed = df.select(*keys, bucket.alias("_bucket"))
    hot = placed.groupBy(*keys).count().filter(F.col("count") > split_above).select(*keys)
    if hot.isEmpty():
        return None
    days = placed.join(bounded_broadcast(hot), keys, "left_semi").groupBy(*keys, "_bucket").count()
    length = max(split_above, halo)
    end = F.sum("count").over(Window.partitionBy(*keys).orderBy("_bucket"))
    home = F.floor((F.col("_end") - F.col("count")) / length)
    return (
        days.withColumn("_end", end)
        .withColumn("_home", home)
        .select(
            *keys,
            "_bucket",
            "_home",
            F.array_distinct(
                F.array(
                    F.col("_home"),
                    F.greatest("_home", F.floor(F.col("_end") / length)),
                    F.greatest("_home", F.floor((F.col("_end") + halo - 1) / length)),
                )
            ).alias("_chunks"),
        )
    )


def history_windows(
    df: DataFrame,
    keys: list[str],
    build: Callable[[WindowSpec], dict[str, Column] | list[dict[str, Column]]],
    halo: int,
    order: str = "timestamp",
    split_above: int = SPLIT_ABOVE,
    small_bytes: int = SMALL_BYTES,
) -> DataFrame:
    """Append window columns whose frames reach at most ``halo`` rows back.

    ``build`` gets the ordered window and returns name -> column, or a list of
    such levels, each of which may use the columns of those before. All share one
    shuffle and one sort. Columns named ``_level...`` do not stay.
    """
    day = F.date_trunc("day", F.col(order))
    plan = _chunk_plan(df, keys, day, halo, split_above, small_bytes)
    if plan is None:
        return _with_levels(df, build(Window.partitionBy(*keys).orderBy(order)))[0]
    placed = (
        df.withColumn("_bucket", day)
        .join(bounded_broadcast(plan, small_bytes=small_bytes), [*keys, "_bucket"], "left")
        .select(
            *df.columns,
            F.coalesce("_home", F.lit(0)).alias("_home"),
            F.explode(F.coalesce("_chunks", F.array(F.lit(0).cast("long")))).alias("_chunk"),
        )
    )
    w = Window.partitionBy(*keys, "_chunk").orderBy(order)
    whole, columns = _with_levels(placed, build(w))
    return whole.filter(F.col("_chunk") == F.col("_home")).select(*df.columns, *columns)


def _with_levels(df: DataFrame, levels) -> tuple[DataFrame, list[str]]:
    """``df`` with the columns of all levels, and the names of those that stay."""
    kept = []
    for columns in levels if isinstance(levels, list) else [levels]:
        df = df.select("*", *[c.alias(n) for n, c in columns.items()])
        kept += [n for n in columns if not n.startswith("_level")]
    return df.drop(*[c for c in df.columns if c.startswith("_level")]), kept


def lag_columns(w: WindowSpec, target: str = TARGET, lags: list[int] = LAGS) -> dict[str, Column]:
    """Value ``k`` rows earlier; NULL before the start of the history."""
    return {f"lag_{k}h": F.lag(target, k).over(w) for k in lags}


def _rolling_plan(sizes: list[int]) -> dict[int, tuple[int, int]]:
    """Size -> (smaller size it is made of, how many of these); itself once if by its own rows."""
    plan: dict[int, tuple[int, int]] = {}
    for n in sorted(set(sizes)):
        parts = [m for m in plan if n % m == 0]
        plan[n] = (max(parts), n // max(parts)) if parts else (n, 1)
    return plan


def rolling_levels(
    w: WindowSpec,
    target: str = TARGET,
    sizes: list[int] = ROLLING,
    include_current: bool = True,
) -> list[dict[str, Column]]:
    """Mean and sample std of the last ``n`` rows, at least one row, in levels.

    Rows, mean and squared deviations of a size come from those of a smaller size that
    divides it, some rows back: 168 from seven times 24, 24 from twice 12, and so on. So a
    row costs a few lags, not its whole frame, and nothing is subtracted, so nothing
    cancels. A size that no smaller one divides goes through its own frame.
    """
    plan, done, levels = _rolling_plan(sizes), set(), []

    def name(n: int, part: str) -> str:
        return f"_level_{n}_{part}"

    while len(done) < len(plan):
        ready = [n for n, (m, _) in plan.items() if n not in done and (m == n or m in done)]
        pieces, merged, spread = {}, {}, {}
        for n in ready:
            m, times = plan[n]
            if m == n:
                frame = w.rowsBetween(1 - n, 0)
                rows = F.count(target).over(frame)
                merged |= {name(n, "n"): rows, name(n, "mean"): F.avg(target).over(frame),
                           name(n, "square"): F.var_pop(target).over(frame) * rows}
                continue
            back = [[F.lag(name(m, part), k * m).over(w) if k else F.col(name(m, part))
                     for part in ("n", "mean", "square")] for k in range(times)]
            pieces |= {name(n, f"{part}{k}"): c for k, three in enumerate(back)
                       for part, c in zip(("n", "mean", "square"), three)}
            own = [[F.coalesce(name(n, f"{part}{k}"), F.lit(0)) for k in range(times)]
                   for part in ("n", "mean", "square")]
            rows = total(own[0])
            # Beside the mean of one part: equal parts give that very mean.
            beside = F.coalesce(*[name(n, f"mean{k}") for k in range(times)])
            merged |= {name(n, "n"): rows, name(n, "mean"): beside + F.try_divide(
                total([c * (mean - beside) for c, mean in zip(*own[:2])]), rows)}
            spread[name(n, "square")] = total([
                square + c * (mean - F.col(name(n, "mean"))) * (mean - F.col(name(n, "mean")))
                for c, mean, square in zip(*own)
            ])
        levels += [level for level in (pieces, merged, spread) if level]
        done |= set(ready)
    shown = {}
    for n in sizes:
        rows, mean, square = (F.col(name(n, part)) for part in ("n", "mean", "square"))
        deviation = F.when(rows > 1, F.sqrt(square / (rows - 1)))
        shown |= {f"rolling_mean_{n}h": mean, f"rolling_std_{n}h": deviation}
    if include_current:
        return [*levels, shown]
    now = {f"_level_now_{c}": column for c, column in shown.items()}
    return [*levels, now, {c: F.lag(f"_level_now_{c}", 1).over(w) for c in shown}]


def add_history_features(
    df: DataFrame,
    keys: list[str] = ("building_id",),
    target: str = TARGET,
    lags: list[int] = LAGS,
    rolling: list[int] = ROLLING,
    include_current: bool = True,
    **splitting,
) -> DataFrame:
    """All lag and rolling features from one shuffle and one sort; gaps are 0."""
    with_gaps = history_windows(
        df,
        list(keys),
        lambda w: [lag_columns(w, target, lags), *rolling_levels(w, target, rolling, include_current)],
        halo=max([*lags, *rolling, 1]),
        **splitting,
    )
    return fill_zero_prefixed(with_gaps)


def add_sequences(
    df: DataFrame,
    keys: list[str] = ("building_id",),
    channels: list[str] = (TARGET,),
    lookback: int = LOOKBACK,
    order: str = "timestamp",
    **splitting,
) -> DataFrame:
    """``sequence``: the previous ``lookback`` rows, for rows that have them.

    One channel gives an array of doubles, several an array of structs. The
    current row is the target and is not part of its sequence.
    """
    if len(channels) == 1:
        item = F.coalesce(F.col(channels[0]).cast("double"), F.lit(0.0))
    else:
        item = F.struct(*[F.col(c).cast("double").alias(c) for c in channels])
    return history_windows(
        df,
        list(keys),
        lambda w: {"sequence": F.collect_list(item).over(w.rowsBetween(-lookback, -1))},
        halo=lookback,
        order=order,
        **splitting,
    ).filter(F.size("sequence") == lookback)


STATISTICS = ("seq_mean", "seq_min", "seq_max", "seq_last", "seq_slope")
# Rows that a frame goes through by itself.
OWN_FRAME = 8


def _chain(n: int) -> list[int]:
    """Sizes up to ``n``, each a small multiple of the one before, the first short if it can be."""
    sizes = [n]
    while sizes[0] > OWN_FRAME:
        factor = next((f for f in range(OWN_FRAME, 1, -1) if sizes[0] % f == 0), None)
        if factor is None:
            break
        sizes.insert(0, sizes[0] // factor)
    return sizes


def sequence_levels(w: WindowSpec, target: str = TARGET, lookback: int = LOOKBACK) -> list[dict[str, Column]]:
    """Statistics of the previous ``lookback`` rows, NULL without that many, in levels.

    Sum, least, most and moment (value times place) of a stretch of rows come from those of
    shorter stretches that it is made of, so a row costs a few lags and no array is built.
    A NULL value counts as 0, as in ``add_sequences``.
    """
    value = F.coalesce(F.col(target).cast("double"), F.lit(0.0))
    parts = ("sum", "min", "max", "moment")

    def name(n: int, part: str) -> str:
        return f"_level_{n}_{part}"

    first, *rest = _chain(lookback)
    frame = w.rowsBetween(1 - first, 0)
    row = F.row_number().over(w)
    levels = [{"_level_x": value, "_level_row": row}, {
        name(first, "sum"): F.sum("_level_x").over(frame),
        name(first, "min"): F.min("_level_x").over(frame),
        name(first, "max"): F.max("_level_x").over(frame),
        # Places count from the oldest row of the stretch.
        name(first, "moment"): total([
            F.coalesce(F.lag("_level_x", first - 1 - k).over(w) * k, F.lit(0.0)) for k in range(first)
        ]),
    }]
    for m, n in zip([first, *rest], rest):
        times = n // m
        levels.append({
            name(n, f"{part}{k}"): F.lag(name(m, part), k * m).over(w) if k else F.col(name(m, part))
            for k in range(times) for part in parts
        })

        def pieces(part: str, n=n, times=times) -> list[Column]:
            return [F.col(name(n, f"{part}{k}")) for k in range(times)]

        levels.append({
            name(n, "sum"): total(pieces("sum")),
            name(n, "min"): F.least(*pieces("min")),
            name(n, "max"): F.greatest(*pieces("max")),
            name(n, "moment"): total([
                moment + (times - 1 - k) * m * piece
                for k, (moment, piece) in enumerate(zip(pieces("moment"), pieces("sum")))
            ]),
        })
    whole = F.col("_level_row") > lookback
    before = {part: F.lag(name(lookback, part), 1).over(w) for part in parts}
    levels.append({f"_level_before_{part}": c for part, c in before.items()} | {
        "_level_last": F.lag("_level_x", 1).over(w)})
    amount, moment = F.col("_level_before_sum"), F.col("_level_before_moment")
    centre, spread = (lookback - 1) / 2, lookback * (lookback * lookback - 1) / 12
    shown = {
        "seq_mean": amount / lookback, "seq_min": F.col("_level_before_min"),
        "seq_max": F.col("_level_before_max"), "seq_last": F.col("_level_last"),
        "seq_slope": (moment - centre * amount) / spread if spread else F.lit(0.0),
    }
    return [*levels, {c: F.when(whole, column) for c, column in shown.items()}]


def add_sequence_statistics(
    df: DataFrame,
    keys: list[str] = ("building_id",),
    target: str = TARGET,
    lookback: int = LOOKBACK,
    order: str = "timestamp",
    **splitting,
) -> DataFrame:
    """``STATISTICS`` of the previous ``lookback`` rows, for rows that have them."""
    return history_windows(
        df, list(keys), lambda w: sequence_levels(w, target, lookback), halo=lookback, order=order,
        **splitting,
    ).filter(F.col("seq_mean").isNotNull())
