import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from meterlens.llm import interaction
from meterlens.llm.interaction import audit
from tests.llm.conftest import CLASHING, EDGE, SOME

DOCS = "doc_id long, text string, source string"
LABELS = "doc_id long, quality int, toxic int"

ROWS = [(i, t, f"src{n % 2}" if n % 5 else None) for n, (i, t) in enumerate(EDGE)] + [
    (100 + k, SOME if k % 3 else f"{SOME} {k}", "src0") for k in range(40)  # a hot text
] + [
    (200, "word " * 300, "src1"), (201, " ".join(map(str, range(300))), "src1"), (5, SOME, "src7"),
    (202, "ABC def " * 120, ""), (203, "a|b", "src1"), (203, "a|b", "src1"), (203, "other", "src1"),
    (-4, SOME, "src0"), (204, "É é" * 80, "src2"), (205, "Wort wort\x0bWORT\x0cx", "src2"),
]
MARKS = [(5, 1, 0), (100, 1, 1), (101, 0, 1), (203, None, 1), (203, 1, None), (200, 1, 0), (None, 1, 1),
         (104, 1, 0), (104, 0, 0), (9999, 1, 1)]


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    failed = []
    for i, text, part in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = set()
        if len(words) < 200:
            bad.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            bad.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t):
            bad.add("C")
        if set(t) & set("#$%&*|"):
            bad.add("D")
        if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows):
            bad.add("E")
        failed.append((i, part or "", bad))
    out = []
    for part in {p for _, p, _ in failed}:
        own = [(i, bad) for i, p, bad in failed if p == part]
        each = {}
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [x for x in left if letter in x[1]]
                earlier = [x for x in own if letter in x[1] and x not in left]
                left = [x for x in left if letter not in x[1]]
                each[order, step] = (
                    len(left), len(gone), len(earlier), sum(bad == {letter} for _, bad in own),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone))
        shapley = Counter()
        for (order, step), counts in each.items():
            shapley[order[step - 1]] += counts[1]
        out += [(part, order, step, *counts, shapley[order[step - 1]])
                for (order, step), counts in each.items()]
    return sorted(out)


def frames(spark, rows, labels):
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(f"own {c}") for c in [*CLASHING, "bits", "hash"]})
    return docs.repartition(5), spark.createDataFrame(labels, LABELS).withColumn("n", F.lit("own"))


@pytest.mark.parametrize("lane_rows", [1024, 2])
def test_counts_are_those_of_brute_force(spark, monkeypatch, lane_rows):
    monkeypatch.setattr(interaction, "LANE_ROWS", lane_rows)
    got = audit(*frames(spark, ROWS, MARKS))
    assert sorted(map(tuple, got.collect())) == brute(ROWS, MARKS)


def test_copies_are_found_across_hot_lanes(spark):
    """One text that holds most rows: its rows go to many lanes, and only the first is no copy."""
    rows = [(k, SOME, f"src{k % 3}") for k in range(3000)] + [(5000 + k, f"{SOME} {k}", "src0") for k in range(50)]
    got = audit(*frames(spark, rows, [])).filter("filter_order = 'EABCD' and step = 1")
    assert sum(r["removed"] for r in got.collect()) == 2999


def test_nothing(spark):
    docs, labels = frames(spark, [], [])
    assert audit(docs, labels).collect() == []
