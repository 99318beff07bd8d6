"""Per-building seasonal forecasts for all buildings, from grouped sums.

Seasonal ARMA by two least-squares steps (Hannan-Rissanen). A long autoregression gives
estimates of the shocks; the model is then a regression on lagged values and lagged shocks.
Both steps need only sums of products per building. A series is kept as runs of equal hours,
in stretches of bounded length with the hours before them that lags reach; Arrow batches of
stretches give their sums, Spark adds these up per building, and the small systems are solved
many at once. So no task holds a whole series, however long it is, no row stands for an hour,
and all orders of a search share one pass: their systems are parts of one matrix of sums.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlens.config import ORDER_GRID, TARGET, SeasonalParams
from meterlens.functions.arma import fit_from_sums, go_on, lag_set, lagged_gram, solve, stable_rows
from meterlens.operators.fills import hourly_runs
from meterlens.operators.windows import history_windows
from meterlens.session import bounded_broadcast, settle

WEEK = 168
LEAST_HOURS = 8
# Hours of a series that one row holds.
STRETCH = 2048
SERIES = ["building_id", "d"]
_FLOATS, _INTS = pa.list_(pa.float64()), pa.list_(pa.int32())


@dataclass(frozen=True)
class Lags:
    """Lags that the orders at hand use together."""

    ar: list[int]
    ma: list[int]

    @property
    def reach(self) -> int:
        return max([*self.ar, *self.ma, 1])

    @classmethod
    def of(cls, orders: list[tuple], p: SeasonalParams, seasonal: bool) -> Lags:
        def union(place: int, times: int) -> list[int]:
            return sorted({k for o in orders for k in lag_set(o[place], times, p.season)})

        return cls(union(0, p.seasonal[0] * seasonal), union(2, p.seasonal[2] * seasonal))


def history_runs(train: DataFrame, hours: int | None, target: str = TARGET) -> DataFrame:
    """(building_id, timestamp, upto, y): stretches of equal hours of each building, without gaps,
    or of its last ``hours``."""
    runs = hourly_runs(train, target=target).filter(F.col(target).isNotNull()).select(
        "building_id", "timestamp", F.col("_upto").alias("upto"), F.col(target).cast("double").alias("y")
    )
    if hours is None:
        return runs
    last = runs.groupBy("building_id").agg(F.max("upto").alias("_last"))
    begin = F.timestamp_add("HOUR", F.lit(1 - hours), "_last").cast("timestamp_ntz")
    return runs.join(bounded_broadcast(last), "building_id").filter(F.col("upto") >= begin).withColumn(
        "timestamp", F.greatest("timestamp", begin)
    ).drop("_last")


def hourly_history(train: DataFrame, hours: int | None, target: str = TARGET) -> DataFrame:
    """(building_id, timestamp, y): gap-free hours of each building, or its last ``hours`` of them."""
    each = F.sequence("timestamp", "upto", F.expr("interval 1 hour"))
    return history_runs(train, hours, target).select("building_id", F.explode(each).alias("timestamp"), "y")


def _hour(ts: str) -> Column:
    """Number of an hour, from 1970 on."""
    return F.timestamp_diff("HOUR", F.lit("1970-01-01").cast("timestamp_ntz"), ts)


def _sizes(runs: DataFrame, orders: list[tuple], p: SeasonalParams, degrees: list[int]) -> DataFrame:
    """Per building and degree of differencing: rows, mean, and where its sums begin."""
    whole, plain = Lags.of(orders, p, True), Lags.of(orders, p, False)
    n, seasonal = F.col("n"), F.col("seasonal")

    def by_season(of) -> Column:
        return F.when(seasonal, of(whole)).otherwise(of(plain))

    mean = F.when(F.col("d") == 0, F.col("mean")).otherwise(
        F.try_divide(F.col("last_y") - F.col("first_y"), F.col("hours") - 1)
    )
    length = F.col("upto") - F.col("begin") + 1
    return (
        runs.select("*", _hour("timestamp").alias("begin")).withColumn("upto", _hour("upto"))
        .groupBy("building_id").agg(
            F.sum(length).alias("hours"), (F.sum(F.col("y") * length) / F.sum(length)).alias("mean"),
            F.min("begin").alias("first_hour"), F.max("timestamp").alias("last_time"),
            F.min_by("y", "timestamp").alias("first_y"), F.max_by("y", "timestamp").alias("last_y"),
        )
        .withColumn("d", F.explode(F.array(*map(F.lit, degrees))))
        .withColumn("n", F.col("hours") - F.col("d"))
        .withColumn("seasonal", n >= 3 * p.season)
        .withColumn("reach", by_season(lambda lags: F.lit(lags.reach)))
        .withColumn("long", F.least(F.col("reach") + 2, F.floor(n / 3)).cast("int"))
        .withColumn("start", F.least(
            F.col("reach") + F.col("long"),
            n - by_season(lambda lags: F.lit(len(lags.ar) + len(lags.ma))) - 2,
        ).cast("int"))
        .withColumn("fits", (n >= LEAST_HOURS) & (F.col("start") >= F.col("reach")))
        .select(*SERIES, "n", mean.alias("mean"), "seasonal", "long", "start", "fits", "last_y", "last_time",
                "first_hour")
    )


def _stretches(runs: DataFrame, halo: int) -> DataFrame:
    """(building_id, stretch, runs): runs of ``STRETCH`` hours from hour ``stretch`` on, and of ``halo`` before.

    A run is an array of its first hour, its last and the value, in order of time. However
    long a series is, a row holds no more than these hours of it.
    """
    own = F.col("stretch")
    placed = runs.filter("building_id is not null").select(
        "building_id", _hour("timestamp").alias("begin"), _hour("upto").alias("end"), "y"
    ).withColumn("stretch", F.explode(F.sequence(
        F.floor(F.col("begin") / STRETCH) * STRETCH, F.floor((F.col("end") + halo) / STRETCH) * STRETCH,
        F.lit(STRETCH).cast("long"),
    )))
    run = F.struct(F.greatest("begin", own - halo).alias("begin"),
                   F.least("end", own + (STRETCH - 1)).alias("end"), "y")
    return placed.groupBy("building_id", "stretch").agg(F.array_sort(F.collect_list(run)).alias("runs"))


@dataclass
class Stretch:
    """Deviations ``x`` of one stretch and the hours before it; ``x[0]`` is number ``t0`` of its
    series and ``x[home]`` the first of its own."""

    row: int
    x: np.ndarray
    t0: int
    home: int

    def at(self, t: int) -> int:
        """Where the own values from number ``t`` on begin."""
        return min(max(self.home, t - self.t0), len(self.x))


def _read(batch: pa.RecordBatch) -> Iterator[Stretch]:
    """Stretches that have values of their own, hour by hour."""
    runs, ends = batch.column("runs").flatten(), batch.column("runs").offsets.to_numpy()
    begin, end, y = (runs.field(k).to_numpy(zero_copy_only=False) for k in range(3))
    ends = ends - ends[0]
    own, first, degree, mean = (
        batch.column(c).to_numpy() for c in ("stretch", "first_hour", "d", "mean"))
    for row in range(batch.num_rows):
        part = slice(ends[row], ends[row + 1])
        values = np.diff(np.repeat(y[part], end[part] - begin[part] + 1), n=degree[row])
        t0 = begin[ends[row]] - first[row]
        home = max(0, own[row] - first[row] - degree[row] - t0)
        if home < len(values):
            yield Stretch(row, values - mean[row], int(t0), int(home))


def _lists(rows: list) -> pa.Array:
    return pa.array(rows, _FLOATS)


def _lag_products(longest: int):
    """Sums of x[t] * x[t-k] of each stretch, and its values at the ends of the series."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, long = batch.column("n").to_numpy(), batch.column("long").to_numpy()
            rows, products, head, tail = [], [], [], []
            for s in _read(batch):
                begin = s.at(long[s.row])
                before = np.concatenate([np.zeros(longest), s.x])[begin:]
                rows.append(s.row)
                products.append(np.correlate(before, s.x[begin:], "valid")[::-1] if begin < len(s.x)
                                else np.zeros(longest + 1))
                head.append(s.x[s.home:begin])
                tail.append(s.x[s.at(n[s.row] - longest):])
            given = batch.select([*SERIES, "stretch", "long"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*given.columns, _lists(products), _lists(head), _lists(tail)],
                names=[*given.schema.names, "products", "head", "tail"])

    return run


def _added(column: str, many: int) -> Column:
    return F.array(*[F.sum(F.get(column, F.lit(k))) for k in range(many)])


def _chained(column: str) -> Column:
    """The values of all stretches of a series, in order."""
    parts = F.array_sort(F.collect_list(F.struct("stretch", column)))
    return F.flatten(F.transform(parts, lambda r: r[column]))


def _stacked(column: pa.Array, rows: np.ndarray) -> np.ndarray:
    """Lists of equal length of some rows, as a matrix."""
    lists = column.take(pa.array(rows, pa.int64()))
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def _long_fits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list = [None] * batch.num_rows
        long = batch.column("long").to_numpy()
        ends = batch.column("tail").value_lengths().to_numpy()
        for size, end in {*zip(long.tolist(), ends.tolist())}:
            rows = np.flatnonzero((long == size) & (ends == end))
            first, head, tail = (_stacked(batch.column(c), rows) for c in ("products", "head", "tail"))
            gram = lagged_gram(first[:, :size + 1], head, tail)
            for row, phi in zip(rows, solve(gram[:, 1:, 1:], gram[:, 0, 1:])):
                out[row] = phi
        yield pa.RecordBatch.from_arrays(
            [batch.column("building_id"), batch.column("d"), _lists(out)], names=[*SERIES, "phi"])


def _order_products(lags: Lags):
    """Matrices of sums of each stretch over values, their lags and lagged shocks.

    A shock is what the long autoregression leaves, zero where it cannot reach.
    """
    reach, (a, b) = lags.reach, np.triu_indices(1 + len(lags.ar) + len(lags.ma))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, long, start = (batch.column(c).to_numpy() for c in ("n", "long", "start"))
            fits = batch.column("phi")
            rows, counts, products, x_tail, e_tail = [], [], [], [], []
            for s in _read(batch):
                phi = fits[s.row].values.to_numpy()
                e = np.convolve(s.x, np.concatenate([[1.0], -phi]))[:len(s.x)]
                e[:max(0, long[s.row] - s.t0)] = 0.0
                begin, end = s.at(start[s.row]), s.at(n[s.row] - reach)
                x, shocks = (np.concatenate([np.zeros(reach), v]) for v in (s.x, e))
                columns = np.stack([
                    *(x[begin + reach - k:len(x) - k] for k in (0, *lags.ar)),
                    *(shocks[begin + reach - k:len(x) - k] for k in lags.ma),
                ])
                rows.append(s.row)
                counts.append(len(s.x) - begin)
                products.append((columns @ columns.T)[a, b])
                x_tail.append(s.x[end:])
                e_tail.append(e[end:])
            given = batch.select([*SERIES, "stretch"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*given.columns, pa.array(counts, pa.int64()), *map(_lists, (products, x_tail, e_tail))],
                names=[*given.schema.names, "rows", "products", "x_tail", "e_tail"])

    return run


MODEL = (
    "building_id long, p int, d int, q int, method string, n long, mean double, aic double, "
    "ar array<int>, ma array<int>, phi array<double>, theta array<double>, "
    "x_tail array<double>, e_tail array<double>, last_y double, last_time timestamp_ntz"
)
PLAIN, SEASONAL, LAST = "plain", "seasonal", "last value"


def _order_fits(orders: list[tuple], p: SeasonalParams, columns: list[str]):
    """Solves every order of many series at once, each from the one matrix of sums of its series."""
    place = {c: k for k, c in enumerate(columns)}
    lags = {(o, s): Lags.of([o], p, s) for o in orders for s in (True, False)}
    upper = np.triu_indices(len(columns))

    def models(batch: pa.RecordBatch, rows: np.ndarray, order: tuple, method: str | None = None,
               aic=None, own=Lags([], []), phi=None, theta=None) -> pa.RecordBatch:
        """Models of some rows; without a method the last value is the model."""
        given = batch.take(pa.array(rows, pa.int64()))
        many = len(rows)

        def same(value, kind) -> pa.Array:
            return pa.array([value] * many, kind)

        out = {c: same(v, pa.int32()) for c, v in zip("pdq", order)} | {
            "method": same(method or LAST, pa.string()), "aic": pa.array(aic if method else [None] * many, pa.float64()),
            "ar": same(own.ar, _INTS), "ma": same(own.ma, _INTS),
        }
        for c, values in (("phi", phi), ("theta", theta)):
            out[c] = _lists(list(values) if method else [[]] * many)
        for c in ("x_tail", "e_tail"):
            out[c] = given.column(c) if method else same([], _FLOATS)
        return pa.RecordBatch.from_arrays(
            [(out[f.name] if f.name in out else given.column(f.name)).cast(f.type) for f in _ARROW_MODEL],
            schema=_ARROW_MODEL)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            degree = batch.column("d").to_numpy()
            known = batch.column("products").is_valid().to_numpy(zero_copy_only=False)
            seasonal = batch.column("seasonal").to_numpy(zero_copy_only=False).astype(bool)
            where = np.cumsum(known) - 1
            gram = np.zeros((known.sum(), len(columns), len(columns)))
            sums = _stacked(batch.column("products"), np.flatnonzero(known)) if known.any() else 0.0
            gram[:, upper[0], upper[1]] = gram[:, upper[1], upper[0]] = sums
            for order in orders:
                last = (degree == order[1]) & ~known
                for s in (True, False):
                    rows = np.flatnonzero((degree == order[1]) & known & (seasonal == s))
                    if not len(rows):
                        continue
                    own = lags[order, s]
                    chosen = [place[f"x{k}"] for k in own.ar] + [place[f"e{k}"] for k in own.ma]
                    n = batch.column("rows").take(pa.array(rows)).to_numpy(zero_copy_only=False)
                    with np.errstate(all="ignore"):
                        beta, aic = fit_from_sums(gram[where[rows]], chosen, n)
                    good = np.isfinite(aic)
                    last[rows[~good]] = True
                    method = SEASONAL if s and (p.seasonal[0] or p.seasonal[2]) else PLAIN
                    beta = beta[good]
                    yield models(batch, rows[good], order, method, aic[good], own,
                                 stable_rows(beta[:, :len(own.ar)], own.ar), beta[:, len(own.ar):])
                yield models(batch, np.flatnonzero(last), order)

    return run


_ARROW_MODEL = pa.schema([
    ("building_id", pa.int64()), ("p", pa.int32()), ("d", pa.int32()), ("q", pa.int32()),
    ("method", pa.string()), ("n", pa.int64()), ("mean", pa.float64()), ("aic", pa.float64()),
    ("ar", _INTS), ("ma", _INTS), ("phi", _FLOATS), ("theta", _FLOATS), ("x_tail", _FLOATS),
    ("e_tail", _FLOATS), ("last_y", pa.float64()), ("last_time", pa.timestamp("us")),
])


def fit_orders(
    train: DataFrame, p: SeasonalParams = SeasonalParams(), orders: list[tuple] = ORDER_GRID,
    target: str = TARGET,
) -> DataFrame:
    """One model per building and order: coefficients, AIC and what a forecast goes on from.

    All orders are fitted on the same rows of a series, so their AIC compare. ``method`` says
    what could be fitted: a series under three seasons has no seasonal terms, and one that is
    shorter than its lags has the last value for a model and no AIC.
    """
    orders = [tuple(o) for o in orders]
    if any(o[1] not in (0, 1) for o in orders):
        raise ValueError("series are differenced once at most")
    lags = Lags.of(orders, p, True)
    longest = lags.reach + 2
    runs = settle(history_runs(train, p.history, target))
    sizes = settle(_sizes(runs, orders, p, sorted({o[1] for o in orders})))
    of = sizes.filter("fits").select(*SERIES, "n", "mean", "long", "start", "first_hour")
    # Shocks of lagged rows reach back by both lags, and differences by one more.
    series = settle(_stretches(runs, lags.reach + longest + 1).join(bounded_broadcast(of), "building_id"))
    products = series.mapInArrow(_lag_products(longest), (
        "building_id long, d int, stretch long, long int, "
        "products array<double>, head array<double>, tail array<double>"
    )).groupBy(*SERIES).agg(
        F.first("long").alias("long"), _added("products", longest + 1).alias("products"),
        _chained("head").alias("head"), _chained("tail").alias("tail"),
    )
    long = settle(products.mapInArrow(_long_fits, "building_id long, d int, phi array<double>"))
    columns = ["x", *(f"x{k}" for k in lags.ar), *(f"e{k}" for k in lags.ma)]
    sums = series.join(bounded_broadcast(long), SERIES).mapInArrow(_order_products(lags), (
        "building_id long, d int, stretch long, rows long, "
        "products array<double>, x_tail array<double>, e_tail array<double>"
    )).groupBy(*SERIES).agg(
        F.sum("rows").alias("rows"), _added("products", len(columns) * (len(columns) + 1) // 2).alias("products"),
        _chained("x_tail").alias("x_tail"), _chained("e_tail").alias("e_tail"),
    )
    return settle(sizes.join(sums, SERIES, "left").select(
        *SERIES, "n", "mean", "seasonal", "last_y", "last_time", "rows", "products", "x_tail", "e_tail"
    ).mapInArrow(_order_fits(orders, p, columns), MODEL))


def best_models(models: DataFrame) -> DataFrame:
    """The model with the lowest AIC of each building; the last value where none could be fitted."""
    every = F.struct(*models.columns)
    worse = F.struct(F.col("aic").isNull(), "aic", "p", "d", "q")
    return models.groupBy("building_id").agg(F.min_by(every, worse).alias("m")).select("m.*")


def save_models(models: DataFrame, path: str) -> None:
    models.write.mode("overwrite").parquet(path)


def load_models(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MODEL).parquet(path)


def _forecasts(horizon: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last_y, mean = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("last_y", "mean"))
            degree = batch.column("d").to_numpy()
            out = np.repeat(last_y[:, None], horizon, axis=1)
            alike: dict[tuple, list[int]] = {}
            for row, (method, ar, ma, x) in enumerate(zip(
                *(batch.column(c).to_pylist() for c in ("method", "ar", "ma")),
                batch.column("x_tail").value_lengths().to_pylist(),
            )):
                if method != LAST:
                    alike.setdefault((tuple(ar), tuple(ma), x, degree[row]), []).append(row)
            for (ar, ma, _, d), rows in alike.items():
                x, e, phi, theta = (
                    _stacked(batch.column(c), rows) for c in ("x_tail", "e_tail", "phi", "theta"))
                future = go_on(x, e, phi, ar, theta, ma, horizon) + mean[rows, None]
                out[rows] = out[rows] + np.cumsum(future, axis=1) if d else future
            values = pa.ListArray.from_arrays(
                np.arange(0, out.size + 1, horizon, dtype=np.int32), np.maximum(out, 0.0).reshape(-1))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("building_id", "p", "d", "q", "method", "last_time")), values],
                names=["building_id", "p", "d", "q", "method", "last_time", "values"],
            )

    return run


def forecast_from(models: DataFrame, horizon: int = WEEK) -> DataFrame:
    """(building_id, p, d, q, method, step, timestamp, prediction) for the next ``horizon`` hours."""
    values = models.mapInArrow(
        _forecasts(horizon),
        "building_id long, p int, d int, q int, method string, last_time timestamp_ntz, values array<double>",
    )
    return values.select("*", F.posexplode("values").alias("_place", "prediction")).select(
        "building_id", "p", "d", "q", "method", (F.col("_place") + 1).alias("step"),
        F.timestamp_add("HOUR", F.col("_place") + 1, "last_time").cast("timestamp_ntz").alias("timestamp"),
        "prediction",
    )


def seasonal_forecast(
    train: DataFrame, p: SeasonalParams = SeasonalParams(), target: str = TARGET
) -> DataFrame:
    """Forecasts of the next ``horizon`` hours (None: a week), of one order for all buildings
    or (``order`` None) of the best of the grid for each."""
    orders = ORDER_GRID if p.order is None else [p.order]
    return forecast_from(best_models(fit_orders(train, p, orders, target)), p.horizon or WEEK)


def order_scores(
    train: DataFrame, p: SeasonalParams = SeasonalParams(), grid: list[tuple] = ORDER_GRID,
    target: str = TARGET,
) -> DataFrame:
    """(building_id, p, d, q, aic) of every order that could be fitted."""
    return fit_orders(train, p, grid, target).filter("aic is not null").select(
        "building_id", "p", "d", "q", "aic"
    )


def best_orders(scores: DataFrame) -> DataFrame:
    """The order with the lowest AIC per building."""
    best = F.min_by(F.struct("p", "d", "q"), F.struct("aic", "p", "d", "q"))
    return scores.groupBy("building_id").agg(
        best.alias("o"), F.min("aic").alias("aic"), F.count("*").alias("n_orders")
    ).select("building_id", "o.p", "o.d", "o.q", "aic", "n_orders")


def hours_ahead(val: DataFrame, target: str = TARGET) -> int:
    """Hours of the longest validation series: the horizon that covers all of them."""
    hours = F.sum(_hour("_upto") - _hour("timestamp") + 1)
    spans = hourly_runs(val, target=target).groupBy("building_id").agg(hours.alias("count"))
    return spans.agg(F.max("count")).first()[0] or 1


def align_forecast(forecast: DataFrame, val: DataFrame, target: str = TARGET) -> DataFrame:
    """Forecast steps next to the regularised validation hours, in order."""
    runs = hourly_runs(val, target=target)
    first = runs.groupBy("building_id").agg(F.min("timestamp").alias("_first"))
    each = F.sequence("timestamp", "_upto", F.expr("interval 1 hour"))
    steps = runs.join(first, "building_id").select(
        "building_id", F.explode(each).alias("timestamp"), F.col(target).alias("actual"), "_first"
    ).select(
        "building_id",
        "timestamp",
        "actual",
        ((F.timestamp_diff("HOUR", "_first", "timestamp")) + 1).cast("int").alias("step"),
    )
    return steps.join(forecast.select("building_id", "step", "prediction"), ["building_id", "step"])


def seasonal_naive(df: DataFrame, season: int = 24, target: str = TARGET, **splitting) -> DataFrame:
    """The value one season of rows earlier, as a baseline forecast."""
    return history_windows(
        df, ["building_id"], lambda w: {"prediction": F.lag(target, season).over(w)},
        halo=season, **splitting,
    ).withColumnRenamed(target, "actual")
