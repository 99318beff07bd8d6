from math import floor, isfinite

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlens.llm.vectors import top_k

LONG = 1 << 63


def clip(x):
    return min(max(x, -LONG), LONG - 1)


def brute(rows, every, k=5):
    kept = [(n, i, [clip(floor(256 * float(np.float32(x)))) for x in v]) for n, (i, v) in enumerate(rows)
            if v and all(x is not None and isfinite(x) for x in v)]
    out = []
    for n, i, v in kept:
        if i is None or i % every:
            continue
        scores = sorted((-clip(sum(a * b for a, b in zip(v, w))), j is None, j or 0)
                        for m, j, w in kept if m != n and len(w) == len(v))[:k]
        out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(scores)]
    return sorted(out, key=str)


def rows():
    rng = np.random.default_rng(0)
    out = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(700)]
    out = [(i, [0.5] * 8) if i % 7 == 0 else (i, v) for i, v in out]  # many ties
    return out + [(800, None), (801, [1.0] * 7 + [None]), (802, [float("nan")] * 8), (803, []),
                  (850, [1.0, 2.0]), (851, [1.0, 1.0]), (100, out[100][1]), (100, out[1][1]), (None, out[9][1]),
                  (900, [3e38] * 8)]


@pytest.mark.parametrize("at_once", [4096, 3])
def test_results_are_those_of_brute_force(spark, at_once):
    df = spark.createDataFrame(rows(), "vec_id long, embedding array<float>").withColumn("row", F.lit("own"))
    got = top_k(df.repartition(3), F.col("vec_id") % 50 == 0, at_once=at_once).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows(), 50)


def test_few_vectors_are_fetched(spark):
    rng = np.random.default_rng(4)
    made = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(4000)]
    df = spark.createDataFrame(made, "vec_id long, embedding array<float>").repartition(4)
    tally = []
    got = top_k(df, F.col("vec_id") % 500 == 0, tally=tally).collect()
    assert sorted(map(tuple, got), key=str) == brute(made, 500)
    fetched, scored = (sum(t) for t in zip(*tally))
    assert fetched <= scored <= 8 * 30 and fetched < 0.06 * len(made)


def test_batches_go_on_to_the_rest(spark):
    """Nearly equal vectors share cells, so that bounds tell nothing and all must be fetched."""
    rng = np.random.default_rng(5)
    base = 100.0
    made = [(i, [base + float(x) / 256 for x in rng.integers(0, 2, 8)]) for i in range(900)]
    made += [(1000, [-9000.0] * 8), (1001, [9000.0] * 8), ((1 << 63) - 1, [9000.0] * 8)]
    df = spark.createDataFrame(made, "vec_id long, embedding array<float>")
    tally = []
    got = top_k(df, F.col("vec_id") % 300 == 0, tally=tally).collect()
    assert sorted(map(tuple, got), key=str) == brute(made, 300)
    assert len(tally) == 3


def test_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert top_k(df, F.col("vec_id") % 50 == 0).collect() == []
