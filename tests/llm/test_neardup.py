import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from meterlens.llm import neardup
from meterlens.llm.components import components
from tests.llm.conftest import EDGE, make

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, size, percent=80):
    """(set size, component) of each document, from all pairs that share a shingle."""
    sets = {}
    for i, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets[i] = {tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, own in sets.items():
        common = Counter(m for s in own for m in holders[s])
        for m, n in common.items():
            if 100 * n >= percent * (len(own) + len(sets[m]) - n):
                a, b = sorted((root(i), root(m)))
                parent[b] = a
        for s in own:
            holders[s].append(i)
    return {i: (len(sets[i]), root(i)) for i in sets}


def planted():
    """Chains of edits around 0.8, copies, short texts and a passage that many share."""
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(2000)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    base, shared, short, docs = words(120), words(40), words(9), []
    for _ in range(350):
        copy = list(base)
        for _ in range(rng.randint(0, 9)):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        docs.append(" ".join(copy))
    docs += [" ".join(base)] * 200
    docs += [" ".join(words(rng.randint(1, 40)) + shared + words(rng.randint(1, 40))) for _ in range(150)]
    docs += [" ".join(short[:k]) for k in range(10) for _ in range(3)]
    return list(enumerate(docs)) + [(900, None), (901, ""), (902, " \n")]


@pytest.mark.parametrize("size", [4, 5])
def test_components_are_those_of_all_pairs(spark, size, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 64)  # several blocks per bucket
    docs = planted()
    got = neardup.near_duplicates(make(spark, docs), shingle=size).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(docs, size)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_edge_cases(edge, nothing):
    got = neardup.near_duplicates(edge).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in EDGE)
    same = [r for r in got if r.component_id == 5]
    assert Counter(r.doc_id for r in same) == {5: 2, None: 1, 7: 1}
    assert {r.component_id for r in got if r.n_shingles == 0} == {1, 2, 3, None}
    assert neardup.near_duplicates(nothing).collect() == []


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(1000, 1200)] + [(3, 3)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    chain, star = {got[k] for k in range(100, 161)}, {got[k] for k in [7, *range(1000, 1200)]}
    assert len(chain) == len(star) == 1 and chain != star
    assert set(got) == {*range(100, 161), 7, *range(1000, 1200)}


def test_links_of_rows_whose_component_is_overtaken():
    """Rows 0 to 6 in components {0,1,2}, {3,4}, {5,6}; 3 and 5 are linked, and 0 and 4."""
    core, other = list(range(1000, 1040)), list(range(2000, 2040))
    sets = [core[:], [1], [2], [*other, 3, 4, 5], [*core, 7, 8], [*other, 6], [9] * 1]
    rows = pa.RecordBatch.from_pydict({
        "bucket": [1] * 7, "low": [0] * 7, "high": [0] * 7, "own": [0] * 7, "node": list(range(7)),
        "component": [0, 0, 0, 3, 3, 5, 5], "n": [len(s) for s in sets], "shingles": sets,
    })
    order = sorted(range(7), key=lambda r: len(sets[r]))
    assert [r for r in order if r in (0, 3, 4, 5)] == [0, 5, 4, 3]
    found = [pair for b in neardup._linked(80)([rows]) for pair in zip(*(c.to_pylist() for c in b.columns))]
    joined = {frozenset({0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5, 6: 5}[x] for x in pair) for pair in found}
    assert joined == {frozenset({0, 3}), frozenset({3, 5})}
