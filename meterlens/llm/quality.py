"""Quality from document statistics by a Gaussian kernel in random Fourier features.

Each text becomes ``NAMES`` statistics. They are standardised by the means and deviations
of the labelled training rows and mapped to ``WIDTH`` random Fourier features, whose inner
products approach a Gaussian kernel. Tasks sum the normal equations of their rows, in two
folds; the sums give ridge weights for all rows and for each fold alone. Scores that a
fold gets from the other fold's weights are calibrated by isotonic regression, and that
curve is applied to the scores of all documents.

Defined cases: null and empty texts have statistics of zero and are scored like others;
without labelled rows of both classes all get the share of good ones (0.5 if there is no
label); repeated rows get equal scores; a null id is scored and never learned from; an
empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlens.llm.labelled import decided, training_labels, with_labels
from meterlens.session import settle

NAMES = (
    "bytes", "words", "word_length", "word_deviation", "letters", "digits", "spaces", "capitals",
    "marks", "signs", "distinct_words", "top_word", "repeated_words", "lines", "distinct_lines",
    "line_length", "entropy", "wide_bytes",
)
WIDTH = 256
RIDGE = 1e-3
SEED = 9
FOLDS, HELD_OUT = 3, 1
GRID = 2000


def _kind(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256)
    for a, b in ranges:
        out[a:b + 1] = 1
    return out


# Kinds of bytes, as columns: letters, digits, spaces, capitals, marks, wide bytes.
KINDS = np.stack([
    _kind((65, 90), (97, 122), (128, 255)), _kind((48, 57)), _kind((32, 32), (9, 13)),
    _kind((65, 90)), _kind((33, 34), (39, 41), (44, 46), (58, 59), (63, 63)), _kind((128, 255)),
], axis=1)


def statistics(text: str | None) -> np.ndarray:
    """The statistics of one text, in the order of ``NAMES``."""
    if not text:
        return np.zeros(len(NAMES))
    raw = text.encode()
    n = len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters, digits, spaces, capitals, marks, wide = counts @ KINDS / n
    part = counts[counts > 0] / n
    words = raw.split()
    many = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    used = Counter(words)
    lines = raw.split(b"\n")
    return np.array([
        np.log1p(n), np.log1p(len(words)), np.log1p(sizes.mean()), np.log1p(sizes.std()), letters,
        digits, spaces, capitals, marks, max(0.0, 1 - letters - digits - spaces - marks),
        len(used) / many, max(used.values(), default=0) / many, sum(map(eq, words, words[1:])) / many,
        np.log1p(len(lines)), len(set(lines)) / len(lines), np.log1p(n / len(lines)),
        -(part * np.log2(part)).sum(), wide,
    ])


def _measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(t.as_py()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"]
        )


class Features:
    """Random Fourier features of standardised statistics, and a constant."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, width: int = WIDTH):
        random = np.random.default_rng(SEED)
        self.mean, self.scale = mean, 1 / np.maximum(deviation, 1e-9)
        self.scale[deviation < 1e-9] = 0.0
        self.turn = random.normal(size=(len(mean), width)) / np.sqrt(len(mean))
        self.phase = random.uniform(0, 2 * np.pi, width)

    def of(self, column: pa.Array) -> np.ndarray:
        x = column.flatten().to_numpy().reshape(-1, len(self.mean))
        z = np.clip((x - self.mean) * self.scale, -8, 8) @ self.turn + self.phase
        return np.hstack([np.cos(z) * np.sqrt(2 / len(self.phase)), np.ones((len(x), 1))])


def _sums(features: Features):
    """Sums of the normal equations of one task: a row per fold and line of the system."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(features.phase) + 1
        total = np.zeros((2, width, width + 1))
        for batch in batches:
            z, y = features.of(batch.column("x")), batch.column("label").to_numpy()
            fold = batch.column("fold").to_numpy()
            for f in (0, 1):
                own = z[fold == f]
                total[f] += own.T @ np.column_stack([own, y[fold == f]])
        part = TaskContext.get().partitionId()
        lines = total.reshape(2 * width, width + 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(2 * width), pa.int32()), pa.array(np.full(2 * width, part), pa.int32()),
             pa.array(list(lines), pa.list_(pa.float64()))],
            names=["line", "part", "values"],
        )

    return run


def _added(table: pa.Table) -> pa.Table:
    values = np.stack(table.column("values").to_pylist()).sum(axis=0)
    return pa.table({
        "line": table.column("line").slice(0, 1), "part": table.column("part").slice(0, 1),
        "values": pa.array([values], pa.list_(pa.float64())),
    })


def ridge(system: np.ndarray) -> np.ndarray:
    """Weights of a system [Z'Z, Z'y]; the constant is not held back."""
    left = system[:, :-1].copy()
    hold = np.full(len(left), RIDGE * max(left[-1, -1], 1.0))
    hold[-1] = 1e-9
    return np.linalg.solve(left + np.diag(hold), system[:, -1])


def isotonic(x: np.ndarray, good: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising curve through sorted ``x``: mean place and share of each pooled block."""
    blocks: list[list[float]] = []
    for place, g, m in zip(x, good, n):
        blocks.append([place * m, float(g), float(m)])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    pooled = np.array(blocks)
    return pooled[:, 0] / pooled[:, 2], pooled[:, 1] / pooled[:, 2]


def train(measured: DataFrame, labels: DataFrame):
    """(features, weights, curve) or the share of good rows, from statistics and labels."""
    rows = settle(with_labels(measured, labels).select(
        "x", "label", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("fold")
    ))
    k = len(NAMES)
    first = rows.agg(
        F.count("*").alias("n"), F.sum("label").alias("good"), F.countDistinct("fold").alias("folds"),
        *(F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(k)),
        *(F.stddev_pop(F.col("x")[i]).alias(f"d{i}") for i in range(k)),
    ).first()
    if not first["n"] or not 0 < first["good"] < first["n"]:
        return (first["good"] / first["n"]) if first["n"] else 0.5
    features = Features(*(np.array([first[f"{c}{i}"] for i in range(k)]) for c in "md"))
    schema = "line int, part int, values array<double>"
    # Tasks' sums are added in two rounds, so no task gets more than a root of them.
    lanes = max(1, int(rows.rdd.getNumPartitions() ** 0.5))
    lines = rows.mapInArrow(_sums(features), schema).withColumn("part", F.col("part") % lanes) \
        .groupBy("line", "part").applyInArrow(_added, schema) \
        .groupBy("line").applyInArrow(_added, schema).collect()  # two systems
    width = len(features.phase) + 1
    systems = np.stack([r["values"] for r in sorted(lines, key=lambda r: r["line"])]) \
        .reshape(2, width, width + 1)
    whole = ridge(systems.sum(axis=0))
    others = [ridge(systems[1 - f]) for f in (0, 1)] if first["folds"] == 2 else [whole, whole]

    def judged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z, fold = features.of(batch.column("x")), batch.column("fold").to_numpy()
            score = np.where(fold == 0, z @ others[0], z @ others[1])
            place = np.clip(np.rint(score * GRID), -GRID, 2 * GRID).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(place), batch.column("label")], names=["place", "label"]
            )

    curve = rows.mapInArrow(judged, "place int, label int").groupBy("place").agg(
        F.sum("label").alias("good"), F.count("*").alias("n")
    ).orderBy("place").collect()  # at most three times the grid
    return features, whole, isotonic(*(np.array([r[c] for r in curve], np.float64) / s for c, s in
                                       (("place", GRID), ("good", 1), ("n", 1))))


def _scores(model):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if isinstance(model, float):
                score = np.full(batch.num_rows, model)
            else:
                features, weights, curve = model
                raw = features.of(batch.column("x")) @ weights
                # A hundredth of the plain score keeps the order within a flat stretch.
                score = 0.99 * np.interp(raw, *curve) + 0.01 * np.clip(raw, 0, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(score, pa.float64())], names=["doc_id", "score"]
            )

    return run


def quality(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "quality",
) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document row."""
    texts = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    measured = settle(texts.mapInArrow(_measure, f"doc_id {kind}, x array<double>"))
    known = training_labels(labels, id_column, label_column, FOLDS, HELD_OUT)
    model = train(measured, known)
    return decided(
        measured.mapInArrow(_scores(model), f"doc_id {kind}, score double"), FOLDS, HELD_OUT
    )
