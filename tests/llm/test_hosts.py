import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlens.llm import hosts
from tests.llm.conftest import CLASHING, EDGE, SOME

DOCS = "doc_id long, text string, source string"


def slow_measures(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(words[k:k + 8]) for k in range(len(words) - 7)]
    count = Counter(windows)
    inside = {k + j for k, w in enumerate(windows) if count[w] > 1 for j in range(8)}
    lines = [line for line in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    dup = sum(line in lines[:k] for k, line in enumerate(lines))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines), dup, len(inside))


def slow_rules(rows):
    """(id, measures, base_failed, rejected, kept), with the prior worked out host by host."""
    seen = []
    for i, t, host in rows:
        m = slow_measures(t)
        short, repeats = m[0] < 20, 100 * m[5] > 30 * m[0]
        flags = [short, repeats, 100 * m[2] > 10 * m[0], 100 * m[4] > 30 * m[3]]
        seen.append((i, host, m, [*flags, any(flags)]))
    names = {h for _, h, _, _ in seen if h is not None}
    n = {h: sum(x[1] == h for x in seen) for h in names}
    total, bad = sum(n.values()), set()
    for r in range(5):
        f = {h: sum(x[3][r] for x in seen if x[1] == h) for h in names}
        mean = sum(f.values()) / total if total else 0
        weight = np.inf
        free = total - sum(v * v for v in n.values()) / total - (len(names) - 1) if total else 0
        if 0 < mean < 1 and free > 1e-9 * total:
            spread = sum(n[h] * (f[h] / n[h] - mean) ** 2 for h in names) / (mean * (1 - mean))
            share = min((spread - (len(names) - 1)) / free, 0.999)
            weight = 1 / share - 1 if share > 1e-12 else np.inf
        for h in names:
            rate = mean if np.isinf(weight) else (f[h] + weight * mean) / (n[h] + weight)
            if rate > 0.5:
                bad.add(h)
    return [(i, *m, flags[0] or flags[1], h in bad, not flags[4] and h not in bad)
            for i, h, m, flags in seen]


def rows():
    out = [(i, t, f"src{n % 2}" if n % 4 else None) for n, (i, t) in enumerate(EDGE)]
    clean = " ".join(f"word{k}" for k in range(40))
    out += [(100 + k, f"{clean} {k}", f"good{k % 4}") for k in range(60)]
    out += [(200 + k, "buy ### $$$ now " * 9 if k % 10 else clean, "spam") for k in range(50)]
    out += [(300, "x", "small"), (301, f"{clean} other", None), (302, clean, "")]
    out += [(303, "a\nb\na\n \n \r\na\r\n" + clean, "good1"), (304, "one two\none  two\none two\n" * 9, "good2"),
            (305, " ".join("abcdefgh") + " x " + " ".join("abcdefgh"), "good3"), (305, clean, "good3")]
    return out


def compared(df):
    return [(r["doc_id"], *(r[m] for m in hosts.MEASURES), r["short"] or r["repeats"], r["rejected"], r["kept"])
            for r in df.collect()]


@pytest.mark.parametrize("lanes", [1000, 2])
def test_verdicts_are_those_of_brute_force(spark, monkeypatch, lanes):
    plain = hosts.lanes_for_join
    monkeypatch.setattr(hosts, "lanes_for_join", lambda *a: plain(*a, share=lanes))
    docs = spark.createDataFrame(rows(), DOCS).withColumns({c: F.lit(f"own {c}") for c in [*CLASHING, "host", "any"]})
    got = compared(hosts.host_rules(docs.repartition(4)))
    assert sorted(got, key=str) == sorted(slow_rules(rows()), key=str)
    rejected = {h for (_, _, h), r in zip(rows(), slow_rules(rows())) if r[-2]}
    assert "spam" in rejected and not any(h.startswith("good") for h in rejected)


def test_small_host_is_held_by_the_rate_of_all(spark):
    """One failing document of one is no reason to reject a host; sixteen of twenty are."""
    failing = {**{f"good{k}": (2, 20) for k in range(30)}, "spam": (16, 20), "small": (1, 1), None: (5, 5)}
    flags = [(host, k < bad) for host, (bad, n) in failing.items() for k in range(n)]
    judged = spark.createDataFrame(flags, "host string, short boolean").withColumns(
        {r: F.col("short") for r in hosts.RULES[1:]})
    rates = {r["host"]: r for r in hosts.host_rates(judged).collect()}
    assert {h for h, r in rates.items() if r["rejected"]} == {"spam"} and len(rates) == 32
    assert 0.5 < rates["spam"]["any"] < 0.8 and 0.1 < rates["small"]["any"] < 0.4
    assert rates["good0"]["any"] == pytest.approx(0.1, abs=0.03)


def test_prior_follows_the_spread_of_rates():
    random = np.random.default_rng(3)
    n = random.integers(20, 200, 500)

    def prior(rates):
        f = random.binomial(n, rates)
        return hosts.beta_prior(500, n.sum(), f.sum(), (n * n).sum(), (f * f / n).sum())

    mean, weight = prior(random.beta(2, 8, 500))
    assert mean == pytest.approx(0.2, abs=0.02) and weight == pytest.approx(10, rel=0.25)
    assert prior(np.full(500, 0.2))[1] > 300
    assert hosts.beta_prior(1, 10, 4, 100, 1.6)[1] == np.inf
    assert hosts.beta_prior(3, 10, 0, 40, 0)[1] == np.inf


def test_windows_of_equal_hash_are_compared(monkeypatch):
    monkeypatch.setattr(hosts, "_MULTIPLIERS", np.zeros(8, np.uint64))  # all hashes equal
    words = [b"%d" % (k % 37) for k in range(30)]
    assert hosts.repeated_words(words) == 0
    assert hosts.repeated_words(words + words[:9]) == 18


def test_nothing(spark):
    assert hosts.host_rules(spark.createDataFrame([], DOCS)).collect() == []
