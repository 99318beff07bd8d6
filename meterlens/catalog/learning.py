"""Queries that fit models. Most have no SQL counterpart; their tests are
invariants and comparisons with numpy on fixtures. Tree counts of most are small here:
the numbers of trees are parameters, the rows are always the whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from meterlens.catalog.base import Query, lodging_rooms, rounded, selected, sql
from meterlens.catalog.base import located as located_readings
from meterlens.config import (
    AnomalyParams, BoostParams, ForestParams, SeasonalParams, TreeParams,
)
from meterlens.functions.calendar import add_time_features
from meterlens.operators import blend, filters
from meterlens.operators.isolation import detect_isolation
from meterlens.operators.ranks import chronological_split
from meterlens.operators.reconstruction import detect_reconstruction
from meterlens.operators.scores import comparison_report, model_metrics, stack_results
from meterlens.operators.windows import add_history_features
from meterlens.plans import boosting, forecast, models
from meterlens.plans.detection import detect_anomalies
from meterlens.plans.features import feature_columns, run_pipeline
from meterlens.plans.load import run_load_plans
from meterlens.plans.registry import Registry, rescore_all
from meterlens.session import settle, shared_folder
from meterlens.sources import tables
from meterlens.sources.readers import stack
from meterlens.sources.sinks import hour_map

FEW_TREES = TreeParams(trees=8, depth=4)
DEEPER = TreeParams(trees=4, depth=6)
SMALL_FOREST = ForestParams(trees=16, depth=6)
FEW_ISOLATION = AnomalyParams(trees=50)
LEAFWISE = BoostParams()
PENALISED = BoostParams(early_stop=0, depth=8, leaves=None, min_rows=1)  # all 1000, never stopped early
SAVED_TREES = BoostParams(trees=4, early_stop=0, leaves=15)


def _matrix(s, d):
    """Feature matrix with split, written once for the many passes of a fit."""
    matrix = settle(run_pipeline(
        tables.readings(s, d), tables.buildings(s, d), tables.weather(s, d)
    ))
    return matrix, feature_columns(matrix)


def _fit(s, d, estimator):
    matrix, features = _matrix(s, d)
    return models.fit_tabular(matrix, features, estimator), matrix, features


def _predict(s, d, estimator):
    model, matrix, _ = _fit(s, d, estimator)
    return models.predict(model, matrix.filter("is_val"))


def _timed(s, d):
    return add_time_features(selected(s, d)).select(
        "building_id", "timestamp", "meter_reading", "hour", "day_of_week", "month", "is_weekend"
    )


def _importance(s, d):
    model, _, features = _fit(s, d, models.boosted_trees(FEW_TREES))
    return models.top_importance(models.feature_importance(model, features, s))


def _two_models(s, d):
    """Boosted trees and the regression, stacked into one prediction table."""
    matrix, features = _matrix(s, d)
    boosted = models.fit_tabular(matrix, features, models.boosted_trees(FEW_TREES))
    return settle(stack_results({
        "boosted": models.predict(boosted, matrix.filter("is_val")),
        "linear": models.standardised_regression(matrix, features),
    }))


def _learned_ensemble(s, d):
    return blend.best_ensemble(_two_models(s, d), ["boosted", "linear"])


def _suite(s, d):
    matrix, features = _matrix(s, d)
    members = {
        "boosted": lambda: models.predict(
            models.fit_tabular(matrix, features, models.boosted_trees(FEW_TREES)),
            matrix.filter("is_val")),
        "forest": lambda: models.predict(
            models.fit_tabular(matrix, features, models.random_forest(SMALL_FOREST)),
            matrix.filter("is_val")),
        "linear": lambda: models.standardised_regression(matrix, features),
    }
    results, status = models.train_suite(s, members)
    return status.join(model_metrics(stack_results(results)), "model", "left")


def _ablation(s, d):
    matrix, features = _matrix(s, d)
    return models.ablation(matrix, features, lambda: models.boosted_trees(TreeParams(4, 3)))


def _site_matrix(s, d):
    """Hours of whole sites with time, lag and rolling features: histories of more than a week."""
    sites = located_readings(s, d).groupBy(F.col("site_id").cast("long").alias("building_id"), "timestamp").agg(
        F.round(F.sum("meter_reading"), 6).alias("meter_reading"))
    matrix = settle(chronological_split(add_history_features(add_time_features(settle(sites)))))
    return matrix, feature_columns(matrix)


def _residual(s, d):
    matrix, features = _site_matrix(s, d)
    return models.residual_model(matrix, features, models.boosted_trees(FEW_TREES))


def _boost(s, d, p):
    """Predictions of boosted trees with penalties, by way of their table."""
    matrix, features = _matrix(s, d)
    model = boosting.fit_boosted(matrix, features, p)
    return boosting.predict_boosted(settle(model.table(s)), matrix.filter("is_val"))


def _rescored(s, d):
    """Three saved models and their ensembles, scored from the registry."""
    matrix = settle(chronological_split(add_time_features(tables.electricity(s, d))))
    train, val = models.parts(matrix)
    features = ["hour", "day_of_week", "month", "is_weekend"]
    registry = Registry(s, f"{shared_folder(s).rstrip('/')}/meterlens-registry-{uuid.uuid4().hex}")
    registry.publish([
        registry.save_pipeline("linear", models.fit_tabular(matrix, features, models.ridge()), features),
        registry.save_trees("trees", boosting.fit_boosted(matrix, features, SAVED_TREES)),
        registry.save_seasonal("seasonal", forecast.fit_orders(train, orders=[SeasonalParams().order])),
    ])
    return rescore_all(registry, val)


def _forecast_metrics(s, d):
    train, val = models.parts(settle(chronological_split(tables.electricity(s, d))))
    ahead = SeasonalParams(horizon=forecast.hours_ahead(val))
    pairs = forecast.align_forecast(forecast.seasonal_forecast(train, ahead), val)
    return model_metrics(pairs, ["building_id"])


def _plan_maps(s, d):
    """All results of a planning run per building: hourly ones as hour -> value maps."""
    plans = run_load_plans(located_readings(s, d), lodging_rooms(s, d), ["building_id"])
    rows = []
    for name, plan in plans.items():
        values = [c for c in plan.columns if c not in ("building_id", "hour")]
        by_hour = "hour" in plan.columns
        plan = plan.groupBy("building_id").agg(*(
            F.to_json(hour_map("hour", c)).alias(c) if by_hour else F.first(c).cast("string").alias(c)
            for c in values
        ))
        rows.append(plan.select("building_id", F.lit(name).alias("plan"), F.explode(
            F.create_map(*(x for c in values for x in (F.lit(c), F.col(c))))
        ).alias("value", "content")))
    return stack(rows)


STACK_SQL = """
  with w as (select building_id, timestamp, max(actual) as y,
        max(case when model = 'lag1' then prediction end) as a,
        max(case when model = 'roll24' then prediction end) as b
      from pairs where model <> 'lag24' group by 1, 2),
    o as (select *, row_number() over (order by timestamp, building_id) as rn,
        count(*) over () // 5 as size, count(*) over () % 5 as extra from w),
    f as (select *, case when rn <= (size + 1) * extra then (rn - 1) // (size + 1)
        else extra + (rn - 1 - (size + 1) * extra) // size end as fold from o),
    s as (select fold, count(*)::double as n, sum(a) as sa, sum(b) as sb, sum(y) as sy,
        sum(a * a) as aa, sum(a * b) as ab, sum(b * b) as bb, sum(a * y) as ay,
        sum(b * y) as by_, sum(y * y) as yy from f group by fold),
    t as (select sum(n) as n, sum(sa) as sa, sum(sb) as sb, sum(sy) as sy, sum(aa) as aa,
        sum(ab) as ab, sum(bb) as bb, sum(ay) as ay, sum(by_) as by_ from s),
    g as (select unnest([0.01, 0.1, 1.0, 10.0, 100.0])::double as alpha),
    c as (select s.*, g.alpha, t.n - s.n as tn, t.sa - s.sa as ta, t.sb - s.sb as tb,
        t.sy - s.sy as ty, t.aa - s.aa as taa, t.ab - s.ab as tab, t.bb - s.bb as tbb,
        t.ay - s.ay as tay, t.by_ - s.by_ as tby from s, t, g),
    e as (select *, taa - ta * ta / tn + alpha as p, tab - ta * tb / tn as q,
        tbb - tb * tb / tn + alpha as r, tay - ta * ty / tn as u, tby - tb * ty / tn as v from c),
    h as (select *, (r * u - q * v) / (p * r - q * q) as wa,
        (p * v - q * u) / (p * r - q * q) as wb from e),
    i as (select *, (ty - wa * ta - wb * tb) / tn as w0 from h),
    j as (select alpha, avg(1 - (yy + wa * wa * aa + wb * wb * bb + n * w0 * w0
          + 2 * wa * wb * ab + 2 * w0 * (wa * sa + wb * sb)
          - 2 * (wa * ay + wb * by_ + w0 * sy)) / (yy - sy * sy / n)) as score
        from i group by alpha),
    k as (select *, (select arg_max(alpha, score) from j) as alpha from t),
    l as (select *, aa - sa * sa / n + alpha as p, ab - sa * sb / n as q,
        bb - sb * sb / n + alpha as r, ay - sa * sy / n as u, by_ - sb * sy / n as v from k),
    m as (select *, (r * u - q * v) / (p * r - q * q) as wa,
        (p * v - q * u) / (p * r - q * q) as wb from l)
  select w.building_id, w.timestamp, w.y as actual,
    round(greatest((sy - wa * sa - wb * sb) / n + wa * w.a + wb * w.b, 0), 4) as prediction
  from w, m where w.a is not null and w.b is not null"""

LEARNING = {
    "stacked_ensemble": Query(
        lambda s, d: rounded(blend.stacked_ensemble(
            tables.predictions(s, d).filter(F.col("model") != "lag24"), ["lag1", "roll24"])[0], 4),
        sql(STACK_SQL, "pairs"),
    ),
    "best_ensemble": Query(
        lambda s, d: blend.best_ensemble(tables.predictions(s, d), ["lag1", "lag24", "roll24"])),
    "learned_ensemble": Query(_learned_ensemble),
    "comparison_report": Query(
        lambda s, d: comparison_report(model_metrics(tables.predictions(s, d)))),
    "boosted_trees": Query(lambda s, d: _predict(s, d, models.boosted_trees(FEW_TREES))),
    "boosted_trees_early_stop": Query(
        lambda s, d: _predict(s, d, models.boosted_trees(FEW_TREES, early_stop=True))),
    "boosted_trees_deep": Query(lambda s, d: _predict(s, d, models.boosted_trees(DEEPER))),
    "random_forest": Query(lambda s, d: _predict(s, d, models.random_forest(SMALL_FOREST))),
    "feature_importance": Query(_importance),
    "standardised_regression": Query(
        lambda s, d: models.standardised_regression(*_matrix(s, d))),
    "two_branch_regression": Query(lambda s, d: models.two_branch_regression(*_matrix(s, d))),
    "residual_model": Query(_residual),
    "sequence_regression": Query(lambda s, d: models.sequence_regression(_site_matrix(s, d)[0])),
    "leafwise_trees": Query(lambda s, d: _boost(s, d, LEAFWISE)),
    "penalised_trees": Query(lambda s, d: _boost(s, d, PENALISED)),
    "rescore_all": Query(_rescored),
    "feature_ablation": Query(_ablation),
    "training_suite": Query(_suite),
    "isolation_forest": Query(
        lambda s, d: detect_isolation(
            _timed(s, d), ["meter_reading", "hour", "day_of_week", "month"], p=FEW_ISOLATION)),
    "reconstruction_error": Query(
        lambda s, d: detect_reconstruction(
            _timed(s, d), ["meter_reading", "hour", "day_of_week", "month", "is_weekend"])),
    "anomaly_chain": Query(lambda s, d: detect_anomalies(_timed(s, d), FEW_ISOLATION)),
    "seasonal_forecast": Query(
        lambda s, d: forecast.seasonal_forecast(tables.electricity(s, d))),
    "searched_forecast": Query(
        lambda s, d: forecast.seasonal_forecast(tables.electricity(s, d), SeasonalParams(order=None))),
    "seasonal_forecast_metrics": Query(_forecast_metrics),
    "order_search": Query(
        lambda s, d: forecast.best_orders(forecast.order_scores(tables.electricity(s, d)))),
    "subsample": Query(
        lambda s, d: filters.subsample(selected(s, d), ["building_id", "timestamp"], 2000)),
    "load_plan_maps": Query(_plan_maps),
}
