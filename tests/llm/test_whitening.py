from fractions import Fraction
from math import floor, isfinite

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlens.llm import whitening
from meterlens.llm.whitening import whiten

KIND = "vec_id long, embedding array<float>"


def rows(width=6, n=300):
    rng = np.random.default_rng(5)
    mix = rng.normal(size=(width, width)) * np.arange(1, width + 1)
    out = [(i, [float(np.float32(x)) for x in rng.normal(size=width) @ mix]) for i in range(n)]
    out += [(7, out[3][1]), (None, out[4][1])] + [(1000 + k, [0.25] * width) for k in range(100)]
    return out + [(800, None), (801, [1.0] * (width - 1) + [None]), (802, [float("nan")] * width), (803, []),
                  (804, [float("inf")] * width), (805, [float("-inf")] + [0.0] * (width - 1))]


def exact(rows):
    """n, sums and covariance in fractions."""
    kept = [(i, [floor(64 * x) + 1_000_000 for x in v]) for i, v in rows
            if v and all(x is not None and isfinite(x) for x in v)]
    n, width = len(kept), len(kept[0][1])
    sums = [sum(x[k] for _, x in kept) for k in range(width)]
    dev = [(i, [n * x[k] - sums[k] for k in range(width)]) for i, x in kept]
    cov = [[Fraction(sum(z[a] * z[b] for _, z in dev), n**3) for b in range(width)] for a in range(width)]
    return n, dev, cov


@pytest.mark.parametrize("components", [32, 4])
def test_results_are_those_of_exact_sums(spark, components):
    n, dev, cov = exact(rows())
    df = spark.createDataFrame(rows(), KIND).withColumns({c: F.lit("own") for c in ("place", "vector", "n", "value")})
    got = whiten(df.repartition(4), components=components).collect()
    k = min(components, 6)
    assert len(got) == len(dev) * k and {r["n"] for r in got} == {n}
    assert sorted((str(r["vec_id"]), r["deviation"]) for r in got if r["component"] == 1) == sorted(
        (str(i), sum(x * x for x in z)) for i, z in dev)
    values, directions = np.linalg.eigh(np.array([[float(x) for x in row] for row in cov]))
    values, directions = values[::-1], directions[:, ::-1]
    for c in range(k):
        own = [r for r in got if r["component"] == c + 1]
        assert own[0]["explained"] == pytest.approx(values[c] / values.sum(), rel=1e-9)
        want = sorted((str(i), float(np.array(z, float) / n @ directions[:, c] / np.sqrt(values[c]))) for i, z in dev)
        have = sorted((str(r["vec_id"]), r["whitened"]) for r in own)
        a, b = (np.array(sorted(x[1] * s for x in want)) for s in (1, -1))
        h = np.array(sorted(x[1] for x in have))
        assert min(abs(h - a).max(), abs(h - b).max()) < 1e-8
    assert max(r["identity_error"] for r in got) < 1e-9


def test_covariance_is_exact_from_squares_alone():
    """Also where squares do not fit 64 bits, and where the values themselves do not."""
    rng = np.random.default_rng(1)
    for top in (10, 1 << 24, 1 << 40, 1 << 58):
        z = rng.integers(-top, top, (50, 4))
        big = z.astype(object)
        got = whitening.covariance(whitening.polarised(z), 4, 50)
        want = [[sum(a * b for a, b in zip(big[:, i], big[:, j])) / 50**3 for j in range(4)] for i in range(4)]
        assert got.tolist() == want
    x = rng.integers(-(1 << 60), 1 << 60, (5, 2))
    assert whitening.centred(x, 10, [3, 4]).tolist() == [[10 * int(v) - s for v, s in zip(row, (3, 4))] for row in x]
    assert whitening.totals(x) == [sum(map(int, x[:, 0])), sum(map(int, x[:, 1]))]


def test_digits_keep_any_whole_number():
    values = [0, -1, 5, 1 << 60, -(1 << 60), -(1 << 60) - 1, (1 << 200) + 17, -(1 << 190) - 3]
    back = [0] * len(values)
    for place, digit, value in zip(*(c.to_pylist() for c in whitening._digits(values).columns)):
        back[place] += value << 60 * digit
    assert back == values


def test_edges(spark):
    def run(data):
        return whiten(spark.createDataFrame(data, KIND)).collect()

    assert run([]) == [] and run([(1, None), (2, [])]) == []
    alone = run([(1, [1.0, 2.0]), (1, [1.0, 2.0])])
    assert [(r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in alone] == [(0, None, 0.0, 0.0)] * 4
    line = run([(k, [float(k), 2.0]) for k in range(9)])  # one direction without spread
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in line)
    far = run([(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 3.0])])
    assert len(far) == 6 and {r["deviation"] for r in far if r["vec_id"] != 3} == {None}
    with pytest.raises(ValueError, match="length"):
        run([(1, [1.0]), (2, [1.0, 2.0])])
