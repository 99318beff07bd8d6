"""Isolation forest: sampled and grown per tree on executors, scored in batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlens.config import AnomalyParams
from meterlens.operators.ranks import exact_quantiles
from meterlens.session import is_small, settle

NODE_SCHEMA = "tree int, node int, feature int, threshold double, depth double"
OVERSAMPLE = 2
HASH_BITS, FINE_BITS = 30, 20


def average_path(n: int) -> float:
    """Mean path length of an unsuccessful search among ``n`` points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def _spread(hashed: Column) -> Column:
    """A whole number below 2 ** (HASH_BITS + FINE_BITS) from a hash."""
    fine = F.pmod(F.shiftright(hashed, HASH_BITS), F.lit(1 << FINE_BITS))
    return F.pmod(hashed, F.lit(1 << HASH_BITS)) * (1 << FINE_BITS) + fine


def tree_samples(df: DataFrame, keys: list[str], features: list[str], p: AnomalyParams) -> DataFrame:
    """(tree, features): for every tree the ``sample_size`` rows of the least hashes.

    A hash of row and tree decides, at every size alike. Only rows whose hash lies below
    twice the share that is needed are looked at, and Spark keeps the least of each tree in
    every task before they travel, so neither the table's size nor a key that many rows
    share makes a sample grow.
    """
    share = min(1.0, p.sample_size * OVERSAMPLE / max(df.count(), 1))
    limit = int(share * (1 << (HASH_BITS + FINE_BITS)))
    slot = F.xxhash64(F.lit(p.seed), *keys)
    trees = F.filter(
        F.sequence(F.lit(0), F.lit(p.trees - 1)),
        lambda t: _spread(F.xxhash64(slot, t)) < limit,
    )
    drawn = df.select(*features, slot.alias("_slot"), F.explode(trees).alias("tree")).select(
        *features, "tree", F.xxhash64("_slot", F.col("tree") + p.trees).alias("_order")
    )
    w = Window.partitionBy("tree").orderBy("_order", *features)
    return (
        drawn.withColumn("_rank", F.row_number().over(w))
        .filter(F.col("_rank") <= p.sample_size)
        .select("tree", *features)
    )


def _grow(features: list[str], p: AnomalyParams):
    limit = int(np.ceil(np.log2(max(p.sample_size, 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        # Fixed row order, so the random splits do not depend on the shuffle.
        points = pdf[features].sort_values(features).to_numpy(dtype=float)
        random = np.random.default_rng([p.seed, tree])
        nodes, waiting = [], [(0, points, 0)]
        while waiting:
            node, part, depth = waiting.pop()
            low, high = part.min(axis=0), part.max(axis=0)
            varying = np.flatnonzero(high > low)
            if depth >= limit or len(part) <= 1 or not len(varying):
                nodes.append((tree, node, -1, 0.0, depth + average_path(len(part))))
                continue
            feature = int(random.choice(varying))
            cut = float(random.uniform(low[feature], high[feature]))
            left = part[:, feature] <= cut
            nodes.append((tree, node, feature, cut, 0.0))
            waiting.append((2 * node + 1, part[left], depth + 1))
            waiting.append((2 * node + 2, part[~left], depth + 1))
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "depth"])

    return grow


class IsolationForest:
    """Fitted forest. At most ``trees * 2 * sample_size`` nodes, held as arrays."""

    def __init__(self, features: list[str], nodes: pd.DataFrame, p: AnomalyParams):
        self.features, self.p = features, p
        size = int(nodes["node"].max()) + 1
        trees = sorted(nodes["tree"].unique())
        shape = (len(trees), size)
        self.feature = np.full(shape, -1, dtype=np.int16)
        self.threshold, self.depth = np.zeros(shape), np.zeros(shape)
        place = nodes["tree"].map({t: i for i, t in enumerate(trees)}).to_numpy()
        at = nodes["node"].to_numpy()
        self.feature[place, at] = nodes["feature"]
        self.threshold[place, at] = nodes["threshold"]
        self.depth[place, at] = nodes["depth"]
        self.levels = int(np.ceil(np.log2(max(p.sample_size, 2))))

    def score(self, df: DataFrame, column: str = "score") -> DataFrame:
        """Add the anomaly score in (0, 1); only the features travel to Python."""
        context = df.sparkSession.sparkContext
        shared = context.broadcast((self.feature, self.threshold, self.depth))
        levels, base = self.levels, average_path(self.p.sample_size)

        @F.pandas_udf("double")
        def isolation(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            feature, threshold, depth = shared.value
            for batch in batches:
                x = batch.to_numpy(dtype=float)
                rows = np.arange(len(x))
                path = np.zeros(len(x))
                for t in range(len(feature)):
                    node = np.zeros(len(x), dtype=np.int64)
                    for _ in range(levels):
                        split = feature[t, node]
                        right = x[rows, np.maximum(split, 0)] > threshold[t, node]
                        node = np.where(split >= 0, 2 * node + 1 + right, node)
                    path += depth[t, node]
                yield pd.Series(2.0 ** (-path / len(feature) / base))

        return df.withColumn(column, isolation(F.struct(*self.features)))


def fit_isolation_forest(
    df: DataFrame, keys: list[str], features: list[str], p: AnomalyParams = AnomalyParams()
) -> IsolationForest:
    """Grow all trees in parallel; only the (bounded) forest reaches the driver."""
    nodes = (
        tree_samples(df, keys, features, p)
        .groupBy("tree")
        .applyInPandas(_grow(features, p), NODE_SCHEMA)
        .toPandas()
    )
    return IsolationForest(features, nodes, p)


def detect_isolation(
    df: DataFrame, features: list[str], keys: list[str] = ("building_id", "timestamp"),
    p: AnomalyParams = AnomalyParams(), **sizing,
) -> DataFrame:
    """Add ``anomaly_score_if`` (above 0 = anomalous) and ``anomaly_if``.

    The cut is the exact (1 - contamination) quantile of all scores. Splits
    are drawn between the minimum and maximum of a feature, so scaling the
    features would not change a tree and is left out.
    """
    scored = fit_isolation_forest(df, list(keys), features, p).score(df, "_score")
    if not is_small(df):
        # The cut and the flags both read the scores: score once.
        scored = settle(scored)
    cut = exact_quantiles(scored, ["_score"], 1 - p.contamination, **sizing)
    return scored.select("*", cut.alias("_cut")).select(
        *df.columns,
        (F.col("_score") - F.col("_cut._score")).alias("anomaly_score_if"),
    ).withColumn("anomaly_if", (F.col("anomaly_score_if") > 0).cast("int"))
