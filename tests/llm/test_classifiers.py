import random
import zlib

import numpy as np
import pytest

from meterlens.llm import quality, toxicity
from tests.llm.conftest import EDGE, make


def soup(rng, n):
    return " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    """Texts of which one in four holds a bad word, and one in three is junk."""
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        bad, junk = i % 4 == 0, i % 3 == 0
        text = soup(rng, rng.randint(20, 80))
        if bad:
            text = text.replace(" ", f" {rng.choice(['gudgex', 'vormwyk'])} ", 3)
        if junk:
            text = text.upper().replace(" ", "!! ")
        rows.append((i, text))
        labels.append((i, int(not junk), int(bad)))
    rows += [(i, t) for i, t in EDGE if i is None or i > 5] + [(None, soup(rng, 9))]
    return make(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


@pytest.mark.parametrize("run,label,of,kept", [
    (toxicity.toxicity, 2, 5, 0), (quality.quality, 1, 3, 1)])
def test_held_out_rows_are_told_apart(labelled, run, label, of, kept):
    docs, labels, rows = labelled
    truth = {r[0]: r[label] for r in labels.collect()}
    got = run(docs, labels).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    for r in got:
        out = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % of == kept
        assert r.held_out == out
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth and r.doc_id > 14]
    assert np.mean([a == b for a, b in held]) > 0.95


@pytest.mark.parametrize("run,column", [(toxicity.toxicity, "toxic"), (quality.quality, "quality")])
def test_without_labels(spark, edge, nothing, run, column):
    none = spark.createDataFrame([], f"doc_id long, {column} int")
    assert {r.score for r in run(edge, none).collect()} == {0.5}
    one = spark.createDataFrame([(7, 1), (9, 1), (None, 0), (12, None)], f"doc_id long, {column} int")
    assert {r.predicted for r in run(edge, one).collect()} == {1}
    assert run(nothing, one).collect() == []


def test_held_out_labels_change_nothing(spark, labelled):
    docs, labels, _ = labelled
    turned = labels.selectExpr(
        "doc_id", "quality", "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - toxic, toxic) as toxic")
    a, b = (sorted((str(r.doc_id), r.score) for r in toxicity.toxicity(docs, x).collect()) for x in (labels, turned))
    assert a == b


def test_isotonic_rises():
    x, y = quality.isotonic(np.arange(5.0), np.array([0, 3, 1, 4, 4.0]), np.array([4, 4, 4, 4, 4.0]))
    assert y.tolist() == [0, 0.5, 1.0] and x.tolist() == [0, 1.5, 3.5]


def test_very_long_text_has_the_buckets_of_its_parts(monkeypatch):
    text = soup(random.Random(1), 400)
    whole = toxicity.gram_buckets(text)
    monkeypatch.setattr(toxicity, "SLICE", 100)
    assert (toxicity.gram_buckets(text) == whole).all()


def test_repeated_ids_are_counted_as_rows(spark, labelled, monkeypatch):
    docs, labels, _ = labelled
    texts = docs.filter("doc_id > 14").select("doc_id", "text")
    known = labels.selectExpr("doc_id", "toxic as label")
    fitted, fit = [], toxicity.fit_logistic

    def seen(row, column, value, label, *more):
        fitted.append(np.bincount(label.astype(int), minlength=2))
        return fit(row, column, value, label, *more)

    monkeypatch.setattr(toxicity, "fit_logistic", seen)
    once = toxicity.train(texts, known, 64)
    again = texts.filter("doc_id = 16").crossJoin(spark.range(500).select()).unionByName(texts)
    buckets, weights, intercept = toxicity.train(again, known, 64)
    assert (buckets == once[0]).all() and np.allclose(weights, once[1]) and np.isclose(intercept, once[2])
    assert (fitted[0] == fitted[1]).all()
    # One id with many texts stays within the bound too.
    many = spark.range(3000).selectExpr("16L as doc_id", "concat('some text ', id) as text").unionByName(texts)
    toxicity.train(many, known, 64, fit_rows=100)
    assert (fitted[2] > 0).all() and (fitted[2] < 160).all()
