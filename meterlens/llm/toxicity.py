"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes ratios.

Every n-gram of bytes (ASCII in lower case) is hashed to one of ``BUCKETS``; a document
has a bucket or has it not. Over all labelled training rows Spark counts in how many toxic
and other documents a bucket occurs. The log ratio of the two shares scales the bucket's
feature; the ``FEATURES`` buckets that tell the classes apart best are kept. A logistic
regression with an L2 penalty is fitted on them, on at most ``FIT_ROWS`` labelled rows of
each class, drawn by hash of id and text and weighted back to their share. Rows that repeat
both id and text are learned from once. Whole texts are scored.

Defined cases: null and empty texts have no n-gram and get the score of the intercept;
without labelled rows of both classes all get the share of toxic ones (0.5 if there is
no label); repeated rows get equal scores; a null id is scored and never learned from;
an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlens.llm.labelled import decided, training_labels, with_labels
from meterlens.session import settle

GRAMS = (3, 4, 5)
BUCKET_BITS = 20
BUCKETS = 1 << BUCKET_BITS
FEATURES = 2048
FIT_ROWS = 10_000
FOLDS, HELD_OUT = 5, 0
PENALTY = 1.0
STEPS = 400
SLICE = 4 << 20


def gram_buckets(text: str | None, wanted: np.ndarray | None = None) -> np.ndarray:
    """Distinct buckets of the n-grams of a text, only those flagged in ``wanted`` if given."""
    raw = np.frombuffer(text.encode().lower() if text else b"", np.uint8)
    found = [np.zeros(0, np.int64)]
    for at in range(0, len(raw), SLICE):
        part = raw[at:at + SLICE + max(GRAMS) - 1].astype(np.uint32)
        rolled, size = part, 1
        for n in range(2, max(GRAMS) + 1):
            if len(rolled) < 2:
                break
            rolled = rolled[:-1] * np.uint32(0x01000193) + part[n - 1:] + np.uint32(n)
            if n not in GRAMS:
                continue
            hashed = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            bucket = (hashed >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)
            found.append(np.unique(bucket if wanted is None else bucket[wanted[bucket]]))
    return np.unique(np.concatenate(found))


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each bucket by label, of one task; rows by the number of buckets."""
    counts = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        for text, label in zip(batch.column("text"), batch.column("label").to_pylist()):
            counts[label, gram_buckets(text.as_py())] += 1
    some = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays(
        [pa.array(some, pa.int32()), pa.array(counts[0, some]), pa.array(counts[1, some])],
        names=["bucket", "clean", "toxic"],
    )


def _flags(buckets: np.ndarray) -> np.ndarray:
    wanted = np.zeros(BUCKETS, bool)
    wanted[buckets] = True
    return wanted


def _features(buckets: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = _flags(buckets)
        for batch in batches:
            rows = [gram_buckets(t.as_py(), wanted).astype(np.int32) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array(rows, pa.list_(pa.int32()))], names=["label", "found"]
            )

    return run


def fit_logistic(
    row: np.ndarray, column: np.ndarray, value: np.ndarray, label: np.ndarray, weight: np.ndarray,
    width: int,
) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L2-penalised fit, by accelerated gradients on sparse rows."""
    w, momentum, prior = np.zeros(width + 1), np.zeros(width + 1), 0.0

    def times(v: np.ndarray) -> np.ndarray:
        return np.bincount(row, value * v[column], len(label)) + v[width]

    def back(g: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(column, value * g[row], width), g.sum())

    top = np.ones(width + 1)
    for _ in range(20):  # largest curvature, by the power method
        image = back(weight * times(top))
        size = np.linalg.norm(image)
        top = image / size
    step = 1.0 / (0.26 * size + PENALTY)
    share = float((weight * label).sum() / weight.sum())
    w[width] = momentum[width] = np.log(share / (1 - share))
    for k in range(STEPS):
        slope = back(weight * (1 / (1 + np.exp(-np.clip(times(momentum), -35, 35))) - label))
        slope[:width] += PENALTY * momentum[:width]
        new = momentum - step * slope
        prior, w = w, new
        momentum = w + k / (k + 3) * (w - prior)
    return w[:width], float(w[width])


def _by_bucket(buckets: np.ndarray, weights: np.ndarray, intercept: float):
    """Scores of a column of texts."""
    wanted, by_bucket = _flags(buckets), np.zeros(BUCKETS)
    by_bucket[buckets] = weights

    def scores(texts: pa.Array) -> np.ndarray:
        total = np.array(
            [by_bucket[gram_buckets(t.as_py(), wanted)].sum() for t in texts], np.float64
        )
        return 1 / (1 + np.exp(-np.clip(total + intercept, -35, 35)))

    return scores


def _scores(model: tuple):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _by_bucket(*model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores(batch.column("text")), pa.float64())],
                names=["doc_id", "score"],
            )

    return run


def _below(model: tuple, text_column: str, limit: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _by_bucket(*model)
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column(text_column)) < limit))

    return run


def train(texts: DataFrame, labels: DataFrame, features: int = FEATURES, fit_rows: int = FIT_ROWS):
    """(buckets, weights, intercept) from texts (doc_id, text) and labels (doc_id, label)."""
    def of_each(rows: DataFrame) -> list[int]:
        sizes = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
        return [sizes.get(0, 0), sizes.get(1, 0)]

    n = of_each(labels)
    nothing = np.zeros(0, np.int64)
    share = (n[1] / sum(n)) if sum(n) else 0.5
    share = min(max(share, 1e-9), 1 - 1e-9)
    prior = (nothing, np.zeros(0), float(np.log(share / (1 - share))))
    if not all(n):
        return prior
    # An id may stand in many rows: from here on the rows count, not the labels.
    rows = settle(
        with_labels(texts, labels).select("doc_id", "text", "label").dropDuplicates(["doc_id", "text"])
    )
    n = of_each(rows)
    if not all(n):
        return prior
    clean, toxic = F.col("clean"), F.col("toxic")
    with_bucket, without = (clean + toxic) / sum(n), 1 - (clean + toxic) / sum(n)
    apart = F.abs(toxic / n[1] - clean / n[0]) / F.sqrt(F.greatest(with_bucket * without, F.lit(1e-12)))
    kept = (
        rows.select("text", "label").mapInArrow(_count, "bucket int, clean long, toxic long")
        .groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .filter(clean + toxic >= 2).orderBy(F.desc(apart), "bucket").limit(features).collect()
    )
    if not kept:
        return prior
    kept.sort(key=lambda r: r["bucket"])
    buckets = np.array([r["bucket"] for r in kept], np.int64)
    counts = np.array([[r["clean"], r["toxic"]] for r in kept], np.float64)
    ratio = np.log((counts[:, 1] + 1) / (n[1] + 2)) - np.log((counts[:, 0] + 1) / (n[0] + 2))
    # Rows to fit on, drawn by hash: about fit_rows of a class at most.
    parts = [min(1.0, fit_rows / c) for c in n]
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(4)), F.lit(1 << 20)) < F.when(
        F.col("label") == 1, int(parts[1] * (1 << 20))
    ).otherwise(int(parts[0] * (1 << 20)))
    found = rows.filter(draw).select("text", "label") \
        .mapInArrow(_features(buckets), "label int, found array<int>").toArrow()
    label = found.column("label").to_numpy().astype(np.float64)
    if len(set(label.tolist())) < 2:
        return prior
    lists = found.column("found").combine_chunks()
    column = np.searchsorted(buckets, lists.flatten().to_numpy())
    row = np.repeat(np.arange(len(label)), np.diff(lists.offsets.to_numpy()))
    weight = np.where(label == 1, 1 / parts[1], 1 / parts[0])
    weight *= len(weight) / weight.sum()
    scaled, intercept = fit_logistic(row, column, ratio[column], label, weight, len(buckets))
    return buckets, scaled * ratio, intercept


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
    features: int = FEATURES,
    fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document row."""
    texts = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    known = training_labels(labels, id_column, label_column, FOLDS, HELD_OUT)
    model = train(texts, known, features, fit_rows)
    kind = texts.schema["doc_id"].dataType.simpleString()
    return decided(
        texts.mapInArrow(_scores(model), f"doc_id {kind}, score double"), FOLDS, HELD_OUT
    )


def without_toxic(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
    limit: float = 0.5,
) -> DataFrame:
    """The rows of ``docs``, as they are, that score below ``limit``."""
    texts = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    known = training_labels(labels, id_column, label_column, FOLDS, HELD_OUT)
    return docs.mapInArrow(_below(train(texts, known), text_column, limit), docs.schema)
