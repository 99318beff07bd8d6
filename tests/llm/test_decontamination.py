import hashlib
import re

import pyarrow.parquet as pq
import pytest

from meterlens.llm import decontamination as D
from meterlens.session import settle
from pyspark.sql import functions as F
from tests.llm.conftest import EDGE, SOME, make

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, window=10):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k:k + n]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in set(map(len, windows)):
            for k in range(len(w) - n + 1):
                for item in windows.get(tuple(w[k:k + n]), ()):
                    hit.update(range(k, k + n))
                    found.add(item)
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=str)


ITEMS = [(1, SOME), (10, "quick BROWN fox"), (2, None), (3, "!!"), (4, "lorem"), (11, SOME.replace("fox", "cat")),
         (5, "no such words at all in any of these documents here today"), (5, "over the lazy"),
         (6, "ÜNÏCODE"), (7, "Ünïcode ﬀ")]


@pytest.mark.parametrize("at_once", [D.TERMS_AT_ONCE, 3])
def test_hits_are_those_of_brute_force(spark, edge, at_once):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = D.contamination(edge, items, terms_at_once=at_once).collect()
    assert sorted(map(tuple, got), key=str) == brute(EDGE, ITEMS)


def test_empty_tables(spark, edge, nothing):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert D.contamination(nothing, items).collect() == []
    got = D.contamination(edge, items.limit(0)).collect()
    assert len(got) == len(EDGE) and not any(r.contaminated for r in got)


def test_proximity(spark):
    docs = make(spark, [(1, "alpha x x beta"), (2, "alpha beta"), (3, "beta alpha"), (4, "alpha x x x x beta")])
    items = spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")
    windows = D.prepared_windows(docs, items, "text", "item_id", "text", 10)
    keyed = settle(docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text"))
    index = D.positional_index(keyed, ["alpha", "beta"])
    near = D.proximity_matches(index, windows, 2).join(index.select("key", "doc_id"), "key")
    assert sorted(r.doc_id for r in near.collect()) == [1, 2, 3]


def test_index_holds_one_value_of_neighbours_for_each_posting(spark):
    docs = make(spark, [(1, SOME + " fox"), (2, None), (3, "no such word"), (4, "Füchse, FOX"), (5, "hill")])
    keyed = docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text").coalesce(1)
    index = D.positional_index(keyed, ["fox", "hill"], 4)
    rows = index.select("doc_id", "n_words", F.explode("postings").alias("p")).select("doc_id", "n_words", "p.*")
    want = []
    for doc, text in [(1, SOME + " fox"), (4, "Füchse, FOX"), (5, "hill")]:
        w = words(text)
        want += [(doc, len(w), term, k, max(k - 3, 0), " ".join(w[max(k - 3, 0):k + 4]))
                 for k, term in enumerate(w) if term in ("fox", "hill")]
    assert sorted(map(tuple, rows.collect())) == sorted(want)
    stored = 0  # values of neighbours in the files: one for each posting and each empty list
    for path in index.inputFiles():
        file = pq.ParquetFile(path.split(":", 1)[1].replace("///", "/")).metadata
        for group in range(file.num_row_groups):
            for c in (file.row_group(group).column(k) for k in range(file.num_columns)):
                stored += c.num_values if "near" in c.path_in_schema.split(".") else 0
    assert stored == len(want) + 2
