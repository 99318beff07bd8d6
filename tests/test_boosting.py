import os
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from meterlens.catalog import learning
from meterlens.config import BoostParams
from meterlens.plans import boosting
from meterlens.plans.boosting import BINS, Tree, best_split, chance, chosen_columns, leaf_value
from meterlens.session import shared_folder

FEATURES = ["a", "b", "c", "d", "e"]


def _table(rows: int, seed: int = 0) -> pd.DataFrame:
    random = np.random.default_rng(seed)
    x = random.normal(size=(rows, len(FEATURES))).round(2)
    x[:, 3] = random.integers(0, 4, rows)
    y = 3 * x[:, 0] + np.where(x[:, 1] > 0.3, 5, 0) * x[:, 3] + random.normal(0, 0.5, rows) + 20
    df = pd.DataFrame(x, columns=FEATURES)
    df.loc[df.index % 11 == 5, "c"] = np.nan
    return df.assign(
        meter_reading=y, building_id=np.arange(rows) % 7,
        timestamp=pd.Timestamp("2016-01-01") + pd.to_timedelta(np.arange(rows), unit="h"),
        is_val=np.arange(rows) >= 0.8 * rows,
    )


SCHEMA = ", ".join(f"{f} double" for f in FEATURES) + \
    ", meter_reading double, building_id long, timestamp timestamp_ntz, is_val boolean"


def dense(df: pd.DataFrame, keys: np.ndarray, p: BoostParams):
    """The same trees, grown leaf by leaf on rows in memory, by one split at a time."""
    x, y, val = df[FEATURES].to_numpy(), df["meter_reading"].to_numpy(), df["is_val"].to_numpy()
    cuts = []
    for f in range(x.shape[1]):
        known = np.sort(x[~val, f][~np.isnan(x[~val, f])])
        ranks = np.ceil(np.arange(1, BINS) / BINS * len(known)).astype(int) - 1
        cuts.append(np.unique(known[np.maximum(ranks, 0)]))
    bins = np.column_stack([np.where(np.isnan(x[:, f]), 0, np.searchsorted(c, x[:, f])) for f, c in enumerate(cuts)])
    raw = np.full(len(y), y[~val].mean())
    trees, errors = [], []
    for number in range(p.trees):
        errors.append(((raw - y)[val] ** 2).mean())
        columns = chosen_columns(len(FEATURES), p, number)
        drawn = np.flatnonzero(~val & (chance(keys, p.seed, number) < p.row_fraction))
        g = raw - y
        tree, rows, depth = Tree(), {0: drawn}, {0: 0}
        tree.value[0] = leaf_value(g[drawn].sum(), len(drawn), p)

        def split_of(node):
            if depth[node] >= p.depth:
                return None
            sums = np.zeros((2, len(FEATURES), BINS))
            for f in columns:
                np.add.at(sums[0, f], bins[rows[node], f], g[rows[node]])
                np.add.at(sums[1, f], bins[rows[node], f], 1)
            return best_split(*sums, p)

        open_ = {0: split_of(0)}
        while sum(f < 0 for f in tree.feature) < (p.leaves or 10**9):
            ready = [k for k in open_ if open_[k]]
            if not ready:
                break
            node = max(ready, key=lambda k: open_[k][0])
            gain, f, cut, *sides = open_.pop(node)
            tree.feature[node], tree.bin[node], tree.gain[node] = f, cut, gain
            below = bins[rows[node], f] <= cut
            for side, part, k in (("left", below, 0), ("right", ~below, 2)):
                child = tree.add(leaf_value(sides[k], sides[k + 1], p))
                getattr(tree, side)[node] = child
                rows[child], depth[child] = rows[node][part], depth[node] + 1
                open_[child] = split_of(child)
        trees.append(tree)
        raw = raw + tree.values(bins)
    return cuts, trees, errors, raw


def _shape(tree: Tree, node: int = 0):
    """A tree without the numbers of its nodes."""
    if tree.feature[node] < 0:
        return round(tree.value[node], 9)
    return tree.feature[node], tree.bin[node], _shape(tree, tree.left[node]), _shape(tree, tree.right[node])


def _keys(spark_df):
    from pyspark.sql import functions as F

    return np.array([r[0] for r in spark_df.select(F.xxhash64("building_id", "timestamp")).collect()])


@pytest.mark.parametrize("p", [
    BoostParams(trees=10, early_stop=0, leaves=9, depth=6, min_rows=5, learning_rate=0.3),
    BoostParams(trees=3, early_stop=0, leaves=None, depth=4, min_rows=1, l1=2.0, l2=5.0, row_fraction=0.5),
    BoostParams(trees=2, early_stop=0),
], ids=["leaves", "depth", "defaults"])
def test_trees_are_those_of_rows_in_memory(spark, p):
    df = _table(500)
    rows = spark.createDataFrame(df, SCHEMA).repartition(3)
    in_order = rows.orderBy("timestamp")
    cuts, trees, errors, raw = dense(df, _keys(in_order), p)
    model = boosting.fit_boosted(rows, FEATURES, p)
    assert all(np.array_equal(a, b) for a, b in zip(model.cuts, cuts))
    assert [_shape(t) for t in model.trees] == [_shape(t) for t in trees]
    assert model.errors[:p.trees] == pytest.approx(errors)
    got = boosting.predict_boosted(model.table(spark), rows).orderBy("timestamp").collect()
    assert [r["prediction"] for r in got] == pytest.approx(np.maximum(raw, 0))
    assert len({sum(f < 0 for f in t.feature) for t in model.trees} - set(range(1, (p.leaves or 99) + 1))) == 0


def test_early_stop_keeps_the_trees_up_to_the_best(spark, tmp_path):
    rows = spark.createDataFrame(_table(400, 3), SCHEMA)
    p = BoostParams(trees=40, learning_rate=0.8, leaves=15, min_rows=2, early_stop=3)
    model = boosting.fit_boosted(rows, FEATURES, p)
    best = int(np.argmin(model.errors))
    assert len(model.trees) == best and len(model.errors) == best + 1 + 3
    model.table(spark).write.parquet(str(tmp_path / "m"))
    again = boosting.predict_boosted(spark.read.parquet(str(tmp_path / "m")), rows.filter("is_val"))
    off = np.array([r["actual"] - r["prediction"] for r in again.collect()])
    assert (off**2).mean() == pytest.approx(min(model.errors))
    shares = {r["feature"]: r["importance"] for r in model.importance(spark).collect()}
    assert sum(shares.values()) == pytest.approx(1) and max(shares, key=shares.get) in ("a", "b", "d")


def test_penalties_shrink_leaves():
    assert leaf_value(-10.0, 4, BoostParams(learning_rate=1, l1=0, l2=0)) == 2.5
    assert leaf_value(-10.0, 4, BoostParams(learning_rate=1, l1=2, l2=1)) == 1.6
    assert leaf_value(1.5, 4, BoostParams(l1=2)) == 0


def test_edges(spark):
    flat = _table(60).assign(meter_reading=5.0, a=np.nan)
    model = boosting.fit_boosted(spark.createDataFrame(flat, SCHEMA), FEATURES, BoostParams(trees=2, early_stop=0))
    assert model.start == 5 and all(len(t.feature) == 1 for t in model.trees)
    with pytest.raises(ValueError, match="training"):
        boosting.fit_boosted(spark.createDataFrame([], SCHEMA), FEATURES)


def test_a_task_makes_histograms_of_many_batches_at_once():
    batch = pa.RecordBatch.from_arrays([pa.array(range(100))], names=["a"])
    sizes = [b.num_rows for b in boosting.blocks([batch] * 25, rows=1000)]
    assert sizes == [1000, 1000, 500] and not list(boosting.blocks([]))
    again = pa.concat_batches(list(boosting.blocks([batch] * 25, rows=1000)))
    assert again.column("a").to_pylist() == list(range(100)) * 25


def _cuts(spark) -> set[str]:
    """Folders of lineages that were cut."""
    shared_folder(spark)
    top = urlparse(spark.sparkContext.getCheckpointDir()).path
    return {name for name in os.listdir(top) if name.startswith("rdd-")} if os.path.isdir(top) else set()


@pytest.mark.parametrize("p", [
    BoostParams(trees=6, early_stop=0, leaves=9, depth=6, min_rows=5),
    BoostParams(trees=3, early_stop=0, leaves=None, depth=7, min_rows=1),
], ids=["leaves", "depth"])
def test_trees_do_not_depend_on_the_shares(spark, monkeypatch, p):
    rows = spark.createDataFrame(_table(700, 5), SCHEMA)
    one = boosting.fit_boosted(rows, FEATURES, p)
    monkeypatch.setattr(boosting, "ONE_SHARE", 100)
    monkeypatch.setattr(boosting, "SHARE_ROWS", 150)
    monkeypatch.setattr(boosting, "AT_ONCE", 3)
    monkeypatch.setattr(boosting, "TOGETHER", 2)
    monkeypatch.setattr(boosting, "CUT", 2)
    before = _cuts(spark)
    many = boosting.fit_boosted(rows.repartition(4), FEATURES, p)
    assert _cuts(spark) == before
    assert [_shape(t) for t in many.trees] == [_shape(t) for t in one.trees]
    assert many.errors == pytest.approx(one.errors)


def test_trees_of_a_table_that_is_one_share_take_no_further_jobs(spark):
    rows = spark.createDataFrame(_table(300, 1), SCHEMA)
    context = spark.sparkContext
    jobs = []
    for trees in (2, 300):
        context.setJobGroup(f"fit {trees}", "")
        model = boosting.fit_boosted(rows, FEATURES, BoostParams(trees=trees, early_stop=0, depth=4, min_rows=5))
        assert len(model.trees) == trees
        jobs.append(len(context.statusTracker().getJobIdsForGroup(f"fit {trees}")))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]


def _params(monkeypatch, name: str) -> BoostParams:
    """Parameters that a registered query fits with."""
    class Asked(Exception):
        pass

    def fit(matrix, features, p=BoostParams()):
        raise Asked(p)

    monkeypatch.setattr(learning, "_matrix", lambda s, d: (None, []))
    monkeypatch.setattr(boosting, "fit_boosted", fit)
    with pytest.raises(Asked) as asked:
        learning.LEARNING[name].run(None, "")
    return asked.value.args[0]


def test_leafwise_trees_is_the_whole_model(monkeypatch):
    assert _params(monkeypatch, "leafwise_trees") == BoostParams()
    assert (BoostParams().trees, BoostParams().early_stop, BoostParams().leaves, BoostParams().depth) == (1000, 50, 63, 10)


def test_penalised_trees_is_the_whole_model(monkeypatch):
    assert _params(monkeypatch, "penalised_trees") == BoostParams(
        trees=1000, depth=8, leaves=None, early_stop=0, min_rows=1, row_fraction=0.8, column_fraction=0.8)
