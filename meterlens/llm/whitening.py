"""Embedding whitening from a polarised covariance.

Entries become whole numbers x = floor(64 * c) + 1000000. With n vectors and sums S, the
centred values z = n * x - S are whole as well, so their squares can be summed without
rounding. Tasks sum the squares of every dimension and of every sum of two dimensions; as
(z_i + z_j)^2 - z_i^2 - z_j^2 = 2 * z_i * z_j, the differences give all cross-covariances
exactly. Only the last division rounds. The matrix is decomposed on the driver, and tasks
project their own vectors.

Sums leave the tasks as digits of 60 bits, so they stay exact at any number of rows; the
driver holds one number per pair of dimensions.

Defined cases: a vector that is null, empty or holds a null or non-finite entry takes no
part and has no row; vectors of more than one length are an error; floor(64 * c) is held
within plus and minus 2**60; a direction without spread has ``whitened`` null and is left
out of ``identity_error``; ``deviation`` is null where it exceeds a long; repeated rows and
null ids count like others; without vectors the result is empty; other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
LIMIT = 1 << 60
ROWS = 2048  # rows handled at once
DIGIT = 60
LONG = (1 << 63) - 1


def whole(column: pa.Array, width: int) -> np.ndarray:
    """Rows of whole numbers from a list column without nulls."""
    c = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * c), -LIMIT, LIMIT).astype(np.int64) + SHIFT


def most(values: np.ndarray) -> int:
    """Largest absolute value, as a Python number."""
    return max(-int(values.min()), int(values.max())) if values.size else 0


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, as 64-bit numbers where they fit and Python numbers otherwise."""
    if n * most(x) < 1 << 61 and max(map(abs, sums)) < 1 << 61:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def totals(values: np.ndarray) -> list[int]:
    """Exact sums of the columns."""
    if most(values) * max(1, len(values)) <= LONG:
        return values.sum(axis=0).tolist()
    return values.astype(object).sum(axis=0).tolist()


def square_sums(values: np.ndarray) -> list[int]:
    """Exact sums of the squares of each column (at most ``ROWS`` rows)."""
    top = most(values)
    if top * top * max(1, len(values)) <= LONG and values.dtype != object:
        return np.einsum("ij,ij->j", values, values).tolist()
    if top < 1 << 47 and values.dtype != object:  # in two parts, each product below 2**48
        high, low = values >> 24, values & 0xFFFFFF
        parts = (np.einsum("ij,ij->j", a, b).tolist() for a, b in ((high, high), (high, low), (low, low)))
        return [(hh << 48) + (hl << 25) + ll for hh, hl, ll in zip(*parts)]
    return (values.astype(object) ** 2).sum(axis=0).tolist()


def _digits(sums: list[int]) -> pa.RecordBatch:
    """(place, digit, value): sums in digits of ``DIGIT`` bits; the last one holds the sign."""
    out: list[tuple[int, int, int]] = []
    for place, value in enumerate(sums):
        digit = 0
        while not -(1 << DIGIT) <= value < 1 << DIGIT:
            out.append((place, digit, value & (1 << DIGIT) - 1))
            value, digit = value >> DIGIT, digit + 1
        out.append((place, digit, value))
    columns = zip(*out) if out else ([], [], [])
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.int64()))],
        names=["place", "digit", "value"],
    )


def _exactly(vectors: DataFrame, width: int, of_rows) -> list[int]:
    """Sums over all vectors of the lists of whole numbers that ``of_rows`` gives for some rows."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: list[int] = []
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                found = of_rows(whole(batch.column("vector").slice(begin, ROWS), width))
                sums = [a + b for a, b in zip(sums, found)] if sums else found
        yield _digits(sums)

    added = vectors.select("vector").mapInArrow(run, "place int, digit int, value long") \
        .groupBy("place", "digit").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    total: dict[int, int] = {}
    for r in added.collect():  # a few digits per pair of dimensions
        total[r["place"]] = total.get(r["place"], 0) + (int(r["value"]) << DIGIT * r["digit"])
    return [total[k] for k in range(len(total))]


def polarised(z: np.ndarray) -> list[int]:
    """Sums of squares of every column, then of every sum of two columns."""
    out = square_sums(z)
    for k in range(z.shape[1] - 1):
        out += square_sums(z[:, k:k + 1] + z[:, k + 1:])
    return out


def covariance(sums: list[int], width: int, n: int) -> np.ndarray:
    """Covariance (divisor n) from the sums of ``polarised`` over n rows."""
    own, pairs = sums[:width], iter(sums[width:])
    out = np.empty((width, width))
    for i in range(width):
        out[i, i] = own[i] / n**3
        for j in range(i + 1, width):
            out[i, j] = out[j, i] = (next(pairs) - own[i] - own[j]) // 2 / n**3
    return out


def whiten(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding",
    components: int = COMPONENTS,
) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) per vector and component."""
    rows = vectors.select(
        F.col(id_column).alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector")
    ).filter(
        (F.size("vector") > 0)
        & F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    )
    kind = rows.schema["vec_id"].dataType.simpleString()
    result = (f"vec_id {kind}, component int, n long, deviation long, whitened double, "
              "explained double, identity_error double")
    size = rows.agg(
        F.count("*").alias("n"), F.min(F.size("vector")).alias("least"), F.max(F.size("vector")).alias("most")
    ).first()
    n, width = size["n"], size["most"]
    if not n:
        return vectors.sparkSession.createDataFrame([], result)
    if size["least"] != width:
        raise ValueError("vectors of more than one length cannot be whitened together")
    sums = _exactly(rows, width, totals)
    matrix = covariance(_exactly(rows, width, lambda x: polarised(centred(x, n, sums))), width, n)
    values, directions = np.linalg.eigh(matrix)
    values, directions = values[::-1][:components], directions[:, ::-1][:, :components]
    trace = float(np.trace(matrix))
    spread = values > max(values[0], 0.0) * width * np.finfo(float).eps
    project = directions[:, spread] / np.sqrt(values[spread])
    explained = np.maximum(values, 0.0) / trace if trace > 0 else np.zeros(len(values))

    def projected(z: np.ndarray) -> np.ndarray:
        return (z.astype(np.float64) / n) @ project

    def moments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = project.shape[1]
        total = np.zeros((many, many + 1))
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                w = projected(centred(whole(batch.column("vector").slice(begin, ROWS), width), n, sums))
                total += w.T @ np.column_stack([w, np.ones(len(w))])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(total.size), pa.int32()), pa.array(total.reshape(-1))],
            names=["place", "value"],
        )

    error = 0.0
    if spread.any():
        many = int(spread.sum())
        found = rows.select("vector").mapInArrow(moments, "place int, value double").groupBy("place") \
            .agg(F.sum("value").alias("value")).orderBy("place").collect()  # components squared
        total = np.array([r["value"] for r in found]).reshape(many, many + 1) / n
        error = float(np.abs(total[:, :-1] - np.outer(total[:, -1], total[:, -1]) - np.eye(many)).max())

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(values)
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                part = batch.slice(begin, ROWS)
                z = centred(whole(part.column("vector"), width), n, sums)
                whitened = np.full((len(z), k), np.nan)
                whitened[:, spread] = projected(z)
                far = square_sums(z.T)
                far = pa.array([d if d <= LONG else None for d in far], pa.int64())
                row = pa.array(np.repeat(np.arange(len(z)), k))
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id").take(row),
                     pa.array(np.tile(np.arange(1, k + 1), len(z)), pa.int32()),
                     pa.array(np.full(len(row), n, np.int64)), far.take(row),
                     pa.array(whitened.reshape(-1), from_pandas=True),
                     pa.array(np.tile(explained, len(z))), pa.array(np.full(len(row), error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained",
                           "identity_error"],
                )

    return rows.mapInArrow(score, result)
