"""Queries on forecasts: metrics, comparisons and ensembles."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterlens.catalog.base import Query, rounded, sql
from meterlens.functions.scalars import clamp, corrected
from meterlens.operators import blend, filters, joins, scores
from meterlens.operators.ranks import chronological_split, contiguous_folds
from meterlens.plans.forecast import seasonal_naive
from meterlens.sources import tables

MODELS = ["lag1", "lag24", "roll24"]
PRED = "p.prediction"

WEIGHTS_SQL = """
    select model, w / sum(w) over () as weight
    from (select model, case when rmse > 0 then 1 / (rmse * rmse) else 1.0 end as w
          from metrics) x"""

BLEND_SQL = f"""
    select p.building_id, p.timestamp, max(p.actual) as actual,
           greatest(sum(w.weight * p.prediction), 0) as prediction
    from pairs p join ({WEIGHTS_SQL}) w on p.model = w.model
    group by p.building_id, p.timestamp having count(*) = (select count(*) from metrics)"""


def _metrics(s, d):
    return scores.model_metrics(tables.predictions(s, d))


def _pairs(s, d):
    return filters.finite_pairs(tables.predictions(s, d))


def _corrected(s, d):
    """Base forecast corrected by the previous residual of the building."""
    base = tables.predictions(s, d).filter(F.col("model") == "roll24")
    other = tables.predictions(s, d).filter(F.col("model") == "lag24").select(
        "building_id", "timestamp", (F.col("actual") - F.col("prediction")).alias("correction")
    )
    both = base.filter(F.col("prediction").isNotNull()).join(other, ["building_id", "timestamp"])
    return rounded(both.select(
        "building_id", "timestamp", "actual",
        corrected(F.col("prediction"), -F.col("correction") / 2).alias("prediction"),
    ))


def _scattered(s, d):
    rows = chronological_split(tables.electricity(s, d)).filter("is_val").select(
        "building_id", "timestamp", F.col("meter_reading").alias("actual")
    )
    lag24 = _pairs(s, d).filter(F.col("model") == "lag24")
    return joins.scatter_predictions(rows, lag24)


def _pending(s, d):
    """Every known forecast against the models that have a full-length history."""
    wanted = tables.predictions(s, d).select("model").distinct()
    counts = tables.predictions(s, d).groupBy("model").agg(
        F.count("prediction").alias("known"), F.count("*").alias("rows")
    )
    done = counts.filter(F.col("known") > F.col("rows") * 0.9).select("model")
    return filters.pending_models(wanted, done)


def _stacked_tables(s, d):
    results = {
        "naive1": seasonal_naive(tables.electricity(s, d), 1),
        "naive24": seasonal_naive(tables.electricity(s, d), 24),
    }
    return scores.stack_results(results)


def _folds(s, d):
    folded = contiguous_folds(tables.electricity(s, d), 5)
    return rounded(folded.groupBy("fold").agg(
        F.count("*").alias("n"), F.sum("meter_reading").alias("total"),
        F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"),
    ), 4)


EVALUATION = {
    "model_metrics": Query(_metrics, sql("select * from metrics", "metrics")),
    "finite_pairs": Query(
        lambda s, d: _pairs(s, d), sql("select * from pairs", "pairs"),
    ),
    "leaderboard": Query(
        lambda s, d: scores.leaderboard(_metrics(s, d)),
        sql("""select cast(row_number() over (order by r2 desc nulls last, model) as integer)
          as rank, model, r2, rmse, mae, mape from metrics""", "metrics"),
    ),
    "best_by_metric": Query(
        lambda s, d: scores.best_by_metric(_metrics(s, d)),
        sql("""select 'r2' as metric, arg_max(model, r2) as model, max(r2) as value from metrics
          union all select 'rmse', arg_min(model, rmse), min(rmse) from metrics
          union all select 'mae', arg_min(model, mae), min(mae) from metrics
          union all select 'mape', arg_min(model, mape), min(mape) from metrics""", "metrics"),
    ),
    "metric_comparison": Query(
        lambda s, d: scores.compare_two(_metrics(s, d), "lag1", "roll24"),
        sql(" union all ".join(
            f"""select '{m}' as metric, max(case when model = 'lag1' then {m} end) as lag1,
              max(case when model = 'roll24' then {m} end) as roll24 from metrics"""
            for m in ("r2", "rmse", "mae", "mape")), "metrics"),
    ),
    "model_weights": Query(
        lambda s, d: rounded(blend.model_weights(_metrics(s, d))),
        sql(f"select model, round(weight, 6) as weight from ({WEIGHTS_SQL}) y", "metrics"),
    ),
    "weighted_ensemble": Query(
        lambda s, d: rounded(blend.weighted_ensemble(tables.predictions(s, d))),
        sql(f"""select building_id, timestamp, round(actual, 6) as actual,
          round(prediction, 6) as prediction from ({BLEND_SQL}) b""", "metrics", "pairs"),
    ),
    "aligned_predictions": Query(
        lambda s, d: joins.align_models(tables.predictions(s, d), MODELS),
        sql("""select * from (select building_id, timestamp, max(actual) as actual,
            max(case when model = 'lag1' then prediction end) as lag1,
            max(case when model = 'lag24' then prediction end) as lag24,
            max(case when model = 'roll24' then prediction end) as roll24
          from predictions group by building_id, timestamp) x
          where lag1 is not null and lag24 is not null and roll24 is not null""", "predictions"),
    ),
    "scattered_predictions": Query(
        _scattered,
        sql("""select v.building_id, v.timestamp, v.meter_reading as actual,
            coalesce(p.prediction, 0) as prediction
          from (select *, row_number() over (order by timestamp, building_id)
                  > floor(count(*) over () * 0.8::double) as is_val from elec) v
          left join pairs p on v.building_id = p.building_id and v.timestamp = p.timestamp
            and p.model = 'lag24' where v.is_val""", "elec", "pairs"),
    ),
    "valid_models": Query(
        lambda s, d: filters.valid_models(tables.predictions(s, d)).groupBy("model").agg(
            F.count("prediction").alias("n")),
        sql("""select model, count(prediction) as n from predictions group by model
          having count(prediction) > 0 and (select count(distinct model) from pairs) >= 2""",
            "predictions", "pairs"),
    ),
    "pending_models": Query(
        _pending,
        sql("""select model from predictions group by model
          having count(prediction) <= count(*) * 0.9::double""", "predictions"),
    ),
    "stacked_results": Query(
        _stacked_tables,
        sql("""select building_id, timestamp, meter_reading as actual, 'naive1' as model,
            lag(meter_reading, 1) over (partition by building_id order by timestamp) as prediction
          from elec union all
          select building_id, timestamp, meter_reading, 'naive24',
            lag(meter_reading, 24) over (partition by building_id order by timestamp)
          from elec""", "elec"),
    ),
    "seasonal_naive": Query(
        lambda s, d: scores.model_metrics(seasonal_naive(tables.electricity(s, d)), []),
        sql("select r2, rmse, mae, mape, n from metrics where model = 'lag24'", "metrics"),
    ),
    "residuals": Query(
        lambda s, d: rounded(scores.add_residuals(_pairs(s, d))),
        sql("""select *, round(actual - prediction, 6) + 0.0 as residual,
          round(abs(actual - prediction), 6) as abs_residual from pairs""", "pairs"),
    ),
    "clamped_predictions": Query(
        lambda s, d: rounded(_pairs(s, d).select(
            "building_id", "timestamp", "model",
            clamp(2 * F.col("prediction") - F.col("actual")).alias("prediction"))),
        sql("""select building_id, timestamp, model,
          round(greatest(2 * prediction - actual, 0), 6) as prediction from pairs""", "pairs"),
    ),
    "residual_correction": Query(
        _corrected,
        sql("""select b.building_id, b.timestamp, round(b.actual, 6) as actual,
            round(greatest(b.prediction + coalesce(-(o.actual - o.prediction) / 2, 0), 0), 6)
              as prediction
          from pairs b join predictions o on b.building_id = o.building_id
            and b.timestamp = o.timestamp and o.model = 'lag24'
          where b.model = 'roll24'""", "pairs", "predictions"),
    ),
    "first_predictions": Query(
        lambda s, d: scores.first_predictions(_pairs(s, d)),
        sql("""select building_id, timestamp, actual, model, prediction from (select *,
            row_number() over (partition by model order by timestamp, building_id) as rn
          from pairs) x where rn <= 500""", "pairs"),
    ),
    "error_histogram": Query(
        lambda s, d: rounded(scores.error_histogram(tables.predictions(s, d))),
        sql("""with e as (select model, actual - prediction as error from pairs),
            m as (select model, min(error) as lo, max(error) as hi, avg(error) as mean_error
                  from e group by model),
            c as (select e.model, least(60, cast(floor((error - lo) / ((hi - lo) / 60)) as integer)
                    + 1) as bin, count(*) as n
                  from e join m on e.model = m.model group by 1, 2)
          select m.model, cast(b.bin as integer) as bin,
            round(lo + (hi - lo) / 60 * (b.bin - 1), 6) + 0.0 as bin_start,
            coalesce(c.n, 0) as n, round(mean_error, 6) + 0.0 as mean_error
          from m cross join (select unnest(range(1, 61)) as bin) b
          left join c on c.model = m.model and c.bin = b.bin""", "pairs"),
    ),
    "scatter_bounds": Query(
        lambda s, d: rounded(scores.scatter_bounds(tables.predictions(s, d))),
        sql("""select model, least(min(actual), min(prediction)) as low,
          greatest(max(actual), max(prediction)) as high from pairs group by model""", "pairs"),
    ),
    "error_threshold": Query(
        lambda s, d: rounded(scores.error_threshold(
            scores.add_residuals(_pairs(s, d)), "abs_residual", ["model"])),
        sql("""select model, round(avg(abs(actual - prediction))
            + 2 * stddev_pop(abs(actual - prediction)), 6) as threshold
          from pairs group by model""", "pairs"),
    ),
    "contiguous_folds": Query(
        _folds,
        sql("""select fold, count(*) as n, round(sum(meter_reading), 4) as total,
            min(timestamp) as first_ts, max(timestamp) as last_ts
          from (select *, cast(case when rn <= (size + 1) * extra
                    then floor((rn - 1) / (size + 1))
                    else extra + floor((rn - 1 - (size + 1) * extra) / size) end as integer) as fold
                from (select *, row_number() over (order by timestamp, building_id) as rn,
                        count(*) over () // 5 as size, count(*) over () % 5 as extra
                      from elec) x) y group by fold""", "elec"),
    ),
    "weighted_ensemble_metrics": Query(
        lambda s, d: rounded(scores.model_metrics(
            blend.weighted_ensemble(tables.predictions(s, d)), [], rounded=False)),
        sql(f"""select round(1 - sum((actual - prediction) * (actual - prediction))
              / (var_pop(actual) * count(*)), 6) as r2,
            round(sqrt(avg((actual - prediction) * (actual - prediction))), 6) as rmse,
            round(avg(abs(actual - prediction)), 6) as mae,
            round(avg(abs((actual - prediction) / actual)) * 100, 6) as mape, count(*) as n
          from ({BLEND_SQL}) b""", "metrics", "pairs"),
    ),
}
