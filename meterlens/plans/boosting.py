"""Gradient-boosted trees with L1/L2 terms, grown leaf by leaf on binned histograms.

1. Features are cut into quantile bins once; a row keeps one byte per feature.
2. Rows are kept by columns, in shares. Each share adds up its rows by (leaf, feature, bin);
   the tree needs only the totals of all shares, however many rows there are.
3. The tree grows best-first: the leaf of the largest gain is split next. A leaf's gain does
   not depend on the order, so each round opens all leaves that the order known so far would
   split; a tree costs about as many rounds as it is deep. Of two sides only the smaller is
   added up; the other is what their leaf has besides.
4. Gradients are rounded to so many bits that their sums are exact: they do not depend on
   the order of rows or the number of shares, and a difference of sums is as good as a sum.
5. A table of up to ``ONE_SHARE`` rows is one share, and one task fits all trees without a
   further job. A larger table is cached in shares, and a round is one job over them.

Squared error. With gradient sum G and n rows, a leaf is worth -T(G) / (n + l2), where T
takes ``l1`` off the size of G, and a split gains the sum of T(G)^2 / (n + l2) of its sides
less that of the leaf.

A missing feature value is below all others. Rows with a NULL target are left out.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlens.config import TARGET, BoostParams
from meterlens.functions.scalars import clamp
from meterlens.session import shared_folder

BINS = 255
# Rows of a table that is one share: with fewer, the jobs of the rounds take longer than the sums.
ONE_SHARE = 2_000_000
# Rows of a share otherwise.
SHARE_ROWS = 500_000
# Leaves whose sums are made at once.
TOGETHER = 64
# Shares whose sums the driver adds up by itself.
AT_ONCE = 16
# Trees after which the lineage of the shares is cut.
CUT = 20
# Rows that are put into columns at once.
BLOCK_ROWS = 200_000


@dataclass
class Tree:
    """Nodes in order of their making; ``feature`` is -1 at leaves."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def add(self, value: float) -> int:
        for column, start in ((self.feature, -1), (self.bin, 0), (self.left, 0), (self.right, 0),
                              (self.value, value), (self.gain, 0.0)):
            column.append(start)
        return len(self.feature) - 1

    def leaves(self, columns: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, its rows) of (features, rows) bins."""
        stack = [(0, np.arange(columns.shape[1]))]
        while stack:
            node, rows = stack.pop()
            if self.feature[node] < 0:
                yield node, rows
                continue
            below = columns[self.feature[node]].take(rows) <= self.bin[node]
            stack += [(self.left[node], rows[below]), (self.right[node], rows[~below])]

    def values(self, bins: np.ndarray) -> np.ndarray:
        """Value of every row of binned features."""
        out = np.empty(len(bins))
        for leaf, rows in self.leaves(bins.T):
            out[rows] = self.value[leaf]
        return out


def shrunk(total, l1: float):
    return np.sign(total) * np.maximum(np.abs(total) - l1, 0.0)


def leaf_value(total: float, n: float, p: BoostParams) -> float:
    return float(-p.learning_rate * shrunk(total, p.l1) / (n + p.l2))


def best_split(g: np.ndarray, n: np.ndarray, p: BoostParams) -> tuple | None:
    """(gain, feature, bin, sums of both sides) of the best cut of (features, bins) histograms.

    Of equal gains the first feature and bin win; sides need ``min_rows`` rows.
    """
    left_g, left_n = g.cumsum(axis=1)[:, :-1], n.cumsum(axis=1)[:, :-1]
    all_g, all_n = g.sum(axis=1, keepdims=True), n.sum(axis=1, keepdims=True)
    right_g, right_n = all_g - left_g, all_n - left_n

    def worth(total, rows):
        return shrunk(total, p.l1) ** 2 / (rows + p.l2)

    gain = worth(left_g, left_n) + worth(right_g, right_n) - worth(all_g, all_n)
    gain = np.where((left_n >= p.min_rows) & (right_n >= p.min_rows), gain, -np.inf)
    feature, cut = np.unravel_index(gain.argmax(), gain.shape)
    if not gain[feature, cut] > p.min_gain:
        return None
    at = feature, cut
    return (float(gain[at]), int(feature), int(cut), float(left_g[at]), float(left_n[at]),
            float(right_g[at]), float(right_n[at]))


def grow(sums, p: BoostParams, columns: list[int]) -> Tree:
    """A tree from a function that adds up the rows of nodes of an explored tree.

    ``sums(tree, nodes)`` returns (2, nodes, columns, bins): gradients and rows.
    """
    explored = Tree()
    kept = {0: sums(explored, [0])[:, 0]}
    explored.value[0] = leaf_value(kept[0][0, 0].sum(), kept[0][1, 0].sum(), p)
    splits: dict[int, tuple | None] = {}
    depth, waiting = {0: 0}, [0]
    while waiting:
        for node in waiting:
            split = best_split(*kept[node], p) if depth[node] < p.depth else None
            splits[node] = split and (split[0], columns[split[1]], *split[2:])
        opened = []
        for node in _best_first(explored, splits, p.leaves):
            if explored.feature[node] < 0:
                gain, feature, cut, *sides = splits[node]
                children = [explored.add(leaf_value(sides[k], sides[k + 1], p)) for k in (0, 2)]
                explored.feature[node], explored.bin[node], explored.gain[node] = feature, cut, gain
                explored.left[node], explored.right[node] = children
                for child in children:
                    depth[child], splits[child] = depth[node] + 1, None
                if depth[node] + 1 < p.depth:
                    opened.append((node, *(children if sides[1] <= sides[3] else children[::-1])))
        waiting = []
        for some in (opened[k:k + TOGETHER] for k in range(0, len(opened), TOGETHER)):
            found = sums(explored, [small for _, small, _ in some])
            for k, (node, small, large) in enumerate(some):
                kept[small], kept[large] = found[:, k], kept.pop(node) - found[:, k]
                waiting += [small, large]
    return _kept(explored, _best_first(explored, splits, p.leaves))


def _best_first(tree: Tree, splits: dict[int, tuple | None], leaves: int | None) -> list[int]:
    """Nodes that are split, the largest gain first, as far as the gains are known."""
    chosen, open_ = [], [0]
    while leaves is None or len(chosen) < leaves - 1:
        ready = [node for node in open_ if splits.get(node)]
        if not ready:
            break
        node = max(ready, key=lambda k: (splits[k][0], -k))
        open_.remove(node)
        chosen.append(node)
        if tree.feature[node] >= 0:
            open_ += [tree.left[node], tree.right[node]]
    return chosen


def _kept(explored: Tree, chosen: list[int]) -> Tree:
    """The explored tree without the splits that were opened in vain."""
    tree, wanted = Tree(), set(chosen)
    tree.value[0] = explored.value[0]
    stack = [(0, 0)]
    while stack:
        old, new = stack.pop()
        if old not in wanted:
            continue
        tree.feature[new], tree.bin[new], tree.gain[new] = (
            explored.feature[old], explored.bin[old], explored.gain[old])
        sides = (explored.left[old], explored.right[old])
        tree.left[new], tree.right[new] = (tree.add(explored.value[side]) for side in sides)
        stack += list(zip(sides, (tree.left[new], tree.right[new])))
    return tree


def cut_points(rows: DataFrame, features: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Upper ends of all bins but the last of every feature, from one pass."""
    shares = [k / bins for k in range(1, bins)]
    # Aggregates of many columns at once would outgrow a compiled method.
    found = {}
    for start in range(0, len(features), 16):
        some = features[start:start + 16]
        value = [F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")) for f in some]
        row = rows.agg(*(F.percentile_approx(v, shares, 10_000).alias(f) for v, f in zip(value, some))).first()
        found.update({f: np.unique(np.array(row[f] or [], float)) for f in some})
    return [found[f] for f in features]


def binned(values: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bins of rows of features: the number of cut points below the value."""
    out = np.zeros(values.shape, np.uint8)
    for k, cut in enumerate(cuts):
        column = values[:, k]
        known = ~np.isnan(column)
        out[known, k] = np.searchsorted(cut, column[known], side="left")
    return out


def _matrix(batch: pa.RecordBatch, features: list[str]) -> np.ndarray:
    columns = [batch.column(f).to_numpy(zero_copy_only=False).astype(np.float64) for f in features]
    return np.column_stack(columns) if columns else np.empty((batch.num_rows, 0))


def chance(key: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """A number in [0, 1) for each row key and tree."""
    x = key.view(np.uint64) + np.uint64((seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / (1 << 53)


def chosen_columns(width: int, p: BoostParams, tree: int) -> list[int]:
    """Features that a tree may use."""
    order = np.argsort(chance(np.arange(width, dtype=np.int64), p.seed + 1, tree), kind="stable")
    return sorted(order[:max(1, int(np.ceil(p.column_fraction * width)))].tolist())


def blocks(batches: Iterable[pa.RecordBatch], rows: int = BLOCK_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``rows``."""
    some, count = [], 0
    for batch in batches:
        some.append(batch)
        count += batch.num_rows
        if count >= rows:
            yield pa.concat_batches(some)
            some, count = [], 0
    if some:
        yield pa.concat_batches(some)


def node_sums(columns: list[np.ndarray], gradient: np.ndarray, parts: list[np.ndarray]) -> np.ndarray:
    """Sums (2, nodes, columns, bins) of gradients and rows over the rows of every node."""
    out = np.zeros((2, len(parts), len(columns), BINS))
    rows, cells = np.concatenate(parts), len(parts) * BINS
    base, weight = np.repeat(np.arange(len(parts)) * BINS, [len(part) for part in parts]), gradient.take(rows)
    for k, column in enumerate(columns):
        at = base + column.take(rows)
        out[0, :, k] = np.bincount(at, weight, minlength=cells).reshape(-1, BINS)
        out[1, :, k] = np.bincount(at, minlength=cells).reshape(-1, BINS)
    return out


class Share:
    """Rows by columns, with their forecasts so far."""

    def __init__(self, batches: Iterable[pa.RecordBatch], width: int, start: float):
        kept = [[np.empty((width, 0), np.uint8)], [np.empty(0, np.int64)], [np.empty(0)], [np.empty(0, bool)]]
        for batch in blocks(batches):
            column = batch.column("bins")
            begin = np.frombuffer(column.buffers()[1], np.int32, 1, 4 * column.offset)[0] if len(column) else 0
            bins = np.frombuffer(column.buffers()[2] or b"", np.uint8, len(column) * width, begin)
            kept[0].append(np.ascontiguousarray(bins.reshape(-1, width).T))
            kept[1].append(batch.column("key").to_numpy())
            kept[2].append(batch.column("y").to_numpy())
            kept[3].append(batch.column("is_val").to_numpy(zero_copy_only=False).astype(bool))
        self.bins, self.key, self.y, self.is_val = (np.concatenate(part, axis=-1) for part in kept)
        self.raw = np.full(len(self.y), start)

    def state(self) -> tuple[float, int, float]:
        """Sum of squares and number of the validation rows, and the largest gradient of the others."""
        g = self.raw - self.y
        off, most = g[self.is_val], np.abs(g[~self.is_val]).max(initial=0.0)
        return float(off @ off), len(off), float(most)

    def draw(self, number: int, columns: list[int], bits: int | None, p: BoostParams) -> None:
        """Gradients, and the rows that a tree is grown on."""
        g = self.raw - self.y
        self.gradient = g if bits is None else np.ldexp(np.rint(np.ldexp(g, bits)), -bits)
        self.columns = [self.bins[f] for f in columns]
        self.parts = {0: np.flatnonzero(~self.is_val & (chance(self.key, p.seed, number) < p.row_fraction))}

    def sums(self, tree: Tree, nodes: list[int]) -> np.ndarray:
        """``node_sums`` of nodes of a tree; rows of nodes that were split go to their sides."""
        while split := [node for node in self.parts if tree.feature[node] >= 0]:
            for node in split:
                rows = self.parts.pop(node)
                below = self.bins[tree.feature[node]].take(rows) <= tree.bin[node]
                self.parts[tree.left[node]], self.parts[tree.right[node]] = rows[below], rows[~below]
        return node_sums(self.columns, self.gradient, [self.parts[node] for node in nodes])

    def add(self, tree: Tree) -> None:
        for leaf, rows in tree.leaves(self.bins):
            self.raw[rows] += tree.value[leaf]


class Shares:
    """Many shares, cached by Spark; what they say is added up."""

    def __init__(self, shares: RDD):
        self.shares, self.old, self.trees = shares.persist(StorageLevel.MEMORY_AND_DISK), None, 0
        self.saved = None

    def state(self) -> tuple[float, int, float]:
        off, rows, most = zip(*self.shares.map(Share.state).collect())
        if self.old:
            self.old.unpersist()
        if saved := self.shares.getCheckpointFile():
            self._remove()
            self.saved = saved
        return sum(off), sum(rows), float(np.max(most))

    def draw(self, *drawn) -> None:
        self.drawn = drawn

    def sums(self, tree: Tree, nodes: list[int]) -> np.ndarray:
        drawn = self.drawn

        def of(share: Share) -> np.ndarray:
            share.draw(*drawn)
            return share.sums(tree, nodes)

        said = self.shares.map(of)
        return said.reduce(np.add) if said.getNumPartitions() <= AT_ONCE else said.treeReduce(np.add)

    def add(self, tree: Tree) -> None:
        def grown(share: Share) -> Share:
            share.add(tree)
            return share

        self.trees += 1
        self.old, self.shares = self.shares, self.shares.map(grown).persist(StorageLevel.MEMORY_AND_DISK)
        if self.trees % CUT == 0:
            self.shares.checkpoint()

    def _remove(self) -> None:
        """Delete the files of the last cut, which nothing reads any more."""
        if self.saved:
            context = self.shares.context
            folder = context._jvm.org.apache.hadoop.fs.Path(self.saved)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
            self.saved = None

    def close(self) -> None:
        self.shares.unpersist()
        self._remove()


def boost(shares: Share | Shares, width: int, rows: int, p: BoostParams) -> Iterator[tuple[float, Tree]]:
    """(validation error before the tree, tree) of all trees; the last is an error alone.

    ``rows`` are those of all shares: the sum of so many gradients keeps within 52 bits.
    """
    errors = []
    for number in range(p.trees + 1):
        off, known, most = shares.state()
        errors.append(off / known if known else np.nan)
        if number == p.trees or p.early_stop and number - _best(errors) >= p.early_stop:
            yield errors[-1], Tree()
            return
        columns = chosen_columns(width, p, number)
        bits = 52 - rows.bit_length() - int(np.frexp(most)[1]) if np.isfinite(most) else None
        shares.draw(number, columns, bits, p)
        tree = grow(shares.sums, p, columns)
        yield errors[-1], tree
        shares.add(tree)


def _best(errors: list[float]) -> int:
    """Number of trees before which the validation error was smallest; all, if it is not known."""
    return len(errors) - 1 if np.isnan(errors).all() else int(np.nanargmin(errors))


@dataclass
class Boosted:
    """A fitted model: features, cut points, start value, trees and validation errors."""

    features: list[str]
    cuts: list[np.ndarray]
    start: float
    trees: list[Tree]
    errors: list[float]

    def table(self, spark: SparkSession) -> DataFrame:
        """(tree, node, feature, threshold, left, right, value, gain); tree -1 is the start value."""
        parts = [[(-1, 0, None, None, 0, 0, self.start, 0.0)]]
        for k, t in enumerate(self.trees):
            names = [self.features[f] if f >= 0 else None for f in t.feature]
            ends = [float(self.cuts[f][cut]) if f >= 0 else None for f, cut in zip(t.feature, t.bin)]
            parts.append(zip([k] * len(names), range(len(names)), names, ends, t.left, t.right, t.value, t.gain))
        columns = zip(*(row for part in parts for row in part))
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]
        return spark.createDataFrame(pa.table(
            [pa.array(column, kind) for column, kind in zip(columns, kinds)],
            names=[field.split()[0] for field in MODEL.split(", ")]))

    def importance(self, spark: SparkSession) -> DataFrame:
        """(feature, importance): each feature's share of all gains, the largest first."""
        gains = dict.fromkeys(self.features, 0.0)
        for t in self.trees:
            for f, gain in zip(t.feature, t.gain):
                if f >= 0:
                    gains[self.features[f]] += gain
        whole = sum(gains.values()) or 1.0
        return spark.createDataFrame(
            [(f, g / whole) for f, g in gains.items()], "feature string, importance double"
        ).orderBy(F.col("importance").desc(), "feature")


MODEL = ("tree int, node int, feature string, threshold double, left int, right int, "
         "value double, gain double")
BINNED = "key long, y double, is_val boolean, bins binary"
TREE = ("number int, error double, feature array<int>, bin array<int>, left array<int>, right array<int>, "
        "value array<double>, gain array<double>")


def fit_boosted(
    matrix: DataFrame, features: list[str], p: BoostParams = BoostParams(), target: str = TARGET,
    keys: list[str] = ("building_id", "timestamp"),
) -> Boosted:
    """Trees fitted on the rows with ``is_val`` false; stops when the others get no better.

    With ``early_stop`` rounds without a smaller validation error, the trees after the best
    are dropped; 0 keeps all. ``keys`` name a row, for the draw of rows per tree.
    """
    known = matrix.filter(F.col(target).isNotNull())
    train = known.filter(~F.col("is_val"))
    rows, start = known.agg(F.count("*"), F.avg(F.when(~F.col("is_val"), F.col(target)))).first()
    if start is None:
        raise ValueError("no training rows")
    cuts, width, start = cut_points(train, features), len(features), float(start)

    def prepare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = binned(_matrix(batch, features), cuts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("y"), batch.column("is_val"),
                 pa.array([row.tobytes() for row in bins], pa.binary())],
                names=["key", "y", "is_val", "bins"],
            )

    def fit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, (error, tree) in enumerate(boost(Share(batches, width, start), width, rows, p)):
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int32()), pa.array([error], pa.float64()),
                 *(pa.array([column], pa.list_(pa.int32()))
                   for column in (tree.feature, tree.bin, tree.left, tree.right)),
                 *(pa.array([column], pa.list_(pa.float64())) for column in (tree.value, tree.gain))],
                names=["number", "error", "feature", "bin", "left", "right", "value", "gain"],
            )

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays(
            [pa.array([pickle.dumps(Share(batches, width, start))], pa.binary())], names=["share"])

    state = known.select(
        F.xxhash64(*keys).alias("key"), F.col(target).cast("double").alias("y"), "is_val",
        *(F.col(f).cast("double").alias(f) for f in features),
    ).mapInArrow(prepare, BINNED).repartition(1 if rows <= ONE_SHARE else -(-rows // SHARE_ROWS))
    if rows <= ONE_SHARE:
        found = sorted(state.mapInArrow(fit, TREE).toArrow().to_pylist(), key=lambda row: row["number"])
        errors = [row["error"] for row in found]
        trees = [Tree(**{c: row[c] for c in row if c not in ("number", "error")}) for row in found]
    else:
        shared_folder(matrix.sparkSession)  # where lineages are cut
        shares = Shares(state.mapInArrow(pack, "share binary").rdd.map(lambda row: pickle.loads(row["share"])))
        errors, trees = (list(column) for column in zip(*boost(shares, width, rows, p)))
        shares.close()
    return Boosted(features, cuts, start, trees[:_best(errors)] if p.early_stop else trees[:-1], errors)


def load_boosted(table: DataFrame) -> tuple[float, list[dict]]:
    """(start value, trees as arrays) of a model table; a model is small."""
    start, trees = 0.0, {}
    for r in table.orderBy("tree", "node").collect():
        if r["tree"] < 0:
            start = r["value"]
        else:
            trees.setdefault(r["tree"], []).append(r)
    return start, [
        {c: [r[c] for r in nodes] for c in ("feature", "threshold", "left", "right", "value")}
        for _, nodes in sorted(trees.items())
    ]


def predict_boosted(
    table: DataFrame, rows: DataFrame, target: str = TARGET,
    keys: list[str] = ("building_id", "timestamp"),
) -> DataFrame:
    """(keys, actual, prediction) of a model table on rows with its features."""
    start, trees = load_boosted(table)
    features = sorted({f for t in trees for f in t["feature"] if f is not None})
    place = {f: k for k, f in enumerate(features)}
    ready = [
        (np.array([place.get(f, -1) for f in t["feature"]]), np.array([x if x is not None else 0.0 for x in t["threshold"]]),
         np.array(t["left"]), np.array(t["right"]), np.array(t["value"], float)) for t in trees
    ]

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, [f"f{k}" for k in range(len(features))])
            raw = np.full(batch.num_rows, start)
            for feature, threshold, left, right, value in ready:
                node = np.zeros(len(x), np.int64)
                inner = np.flatnonzero(feature[node] >= 0)
                while len(inner):
                    at = node[inner]
                    above = x[inner, feature[at]] > threshold[at]  # missing values stay below
                    node[inner] = np.where(above, right[at], left[at])
                    inner = inner[feature[node[inner]] >= 0]
                raw += value[node]
            yield batch.select([*keys, "actual"]).append_column("_raw", pa.array(raw))

    given = rows.select(*keys, F.col(target).cast("double").alias("actual"),
                        *(F.col(f).cast("double").alias(f"f{k}") for k, f in enumerate(features)))
    kinds = ", ".join(f"{c} {given.schema[c].dataType.simpleString()}" for c in keys)
    return given.mapInArrow(score, f"{kinds}, actual double, _raw double").select(
        *keys, "actual", clamp(F.col("_raw")).alias("prediction")
    )
